"""Ranking: import spreading, nearest candidates, fusion with cosine, grouped top n, localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, minmax, split_ident
from ..session import materialize

SPREAD = 0.3
POOL_LOW, POOL_HIGH = 200, 400
NOMINEES = 8
EMBED_WEIGHT = 1.0


def top(df: DataFrame, n: int, score: str = "score", key: str = "path") -> DataFrame:
    """The n best rows; equal scores in the order of the key."""
    return df.orderBy(F.desc(score), key).limit(n)


def top_per(df: DataFrame, groups: list[str], n: int, score: str = "score", key: str = "path") -> DataFrame:
    """The n best rows of each group, with their rank; kinds are never ranked together."""
    w = Window.partitionBy(*groups).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pool_size(n: int) -> int:
    return min(max(n, POOL_LOW), POOL_HIGH)


def spread(pool: DataFrame, edges: DataFrame, weight: float = SPREAD) -> DataFrame:
    """pool (path, score, ...) with bm25 = the old score and score = norm + weight x best neighbour's norm.

    Neighbours are the pool's rows that an edge of either direction joins to the row; one hop, the best
    one counts. norm is min-max over the pool, 1 where all are equal. A pool of one row keeps its score. The
    pool holds at most a few hundred rows, so both sides of its edges are met by broadcast.
    """
    ends = pool.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
    normed = pool.crossJoin(F.broadcast(ends)).withColumn("norm", minmax(F.col("score"), F.col("lo"), F.col("hi")))  # ends is one row
    small = F.broadcast(normed.select(F.col("path").alias("p"), F.col("norm").alias("pn")))
    pairs = edges.filter("src_path IS NOT NULL AND dst_path IS NOT NULL AND src_path <> dst_path").select("src_path", "dst_path")
    inside = pairs.join(small, pairs["src_path"] == F.col("p")).select("src_path", "dst_path", F.col("pn").alias("src_norm"))
    small2 = F.broadcast(normed.select(F.col("path").alias("p"), F.col("norm").alias("dst_norm")))
    inside = inside.join(small2, inside["dst_path"] == F.col("p")).drop("p")
    lift = inside.select(F.col("src_path").alias("to"), F.col("dst_norm").alias("nbr")).unionByName(inside.select(F.col("dst_path").alias("to"), F.col("src_norm").alias("nbr"))).groupBy("to").agg(F.max("nbr").alias("nbr"))
    out = normed.join(lift, normed["path"] == lift["to"], "left").drop("to")
    spreaded = F.col("norm") + weight * F.coalesce("nbr", F.lit(0.0))
    return out.withColumn("bm25", F.col("score")).withColumn("score", F.when(F.col("n") < 2, F.col("score")).otherwise(spreaded)).drop("lo", "hi", "n", "norm", "nbr")


def usable(vectors: DataFrame) -> DataFrame:
    """One valid unit vector per path: dim matches, no null, NaN or infinity, not all zero."""
    # the sum of squares is null, NaN, infinite or 0 exactly where the vector has no direction
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    ok = vectors.filter("path IS NOT NULL AND size(vec) = dim").select("path", "vec", square.alias("q")).filter((F.col("q") > 0) & (F.col("q") < float("inf")))
    one = ok.groupBy("path").agg(F.min_by(F.struct("vec", "q"), F.xxhash64("vec")).alias("r"))
    return one.select("path", F.transform("r.vec", lambda x: x.cast("double") / F.sqrt("r.q")).alias("vec"))


def similarity(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(path, cosine) of every vector to one query vector; other lengths give 0."""
    return vectors.select("path", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])).alias("cosine"))


def nominees(near: DataFrame, pool: DataFrame, k: int = NOMINEES) -> DataFrame:
    """The k paths with the largest positive cosine that are not in the pool."""
    return top(near.filter("cosine > 0").join(F.broadcast(pool.select("path")), "path", "left_anti"), k, "cosine")


def fuse(pool: DataFrame, near: DataFrame, extra: DataFrame | None = None, weight: float = EMBED_WEIGHT) -> DataFrame:
    """pool (path, score) and nominees with cosine and fused = norm(score) + weight x norm(cosine).

    A nominee's score is the pool's least, 0 if the pool is empty; a missing cosine counts 0. With fewer
    than two candidates fused is null. The score stays what it was.
    """
    least = pool.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("score"))
    rows = pool.select("path", "score")
    if extra is not None:
        rows = rows.unionByName(extra.select("path").crossJoin(F.broadcast(least)))  # least is one row
    rows = rows.join(near, "path", "left")
    filled = rows.withColumn("c", F.coalesce("cosine", F.lit(0.0)))
    ends = filled.agg(F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"))
    both = filled.crossJoin(F.broadcast(ends))  # ends is one row
    value = minmax(F.col("score"), F.col("s0"), F.col("s1")) + weight * minmax(F.col("c"), F.col("c0"), F.col("c1"))
    return both.select("path", "score", "cosine", F.when(F.col("n") >= 2, value).alias("fused"))


def weighted_ranks(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Ablation: the weighted sum of min-maxed signals; a signal that is equal for all counts 0."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    both = df.crossJoin(F.broadcast(ends))  # ends is one row
    total = sum((w * F.coalesce(minmax(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), 0.0), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return both.withColumn("total", total).drop(*[f"{n}_{c}" for c in weights for n in ("lo", "hi")])


def _contains(a: str, b: str) -> Column:
    span = lambda t: F.col(f"{t}.end_line") - F.col(f"{t}.start_line")
    return (F.col(f"{a}.start_line") <= F.col(f"{b}.start_line")) & (F.col(f"{a}.end_line") >= F.col(f"{b}.end_line")) & (span(a) > span(b))


def localize(hits: DataFrame, nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(path, symbol, node_type, start_line, end_line) of the chunk of each hit that fits the terms best.

    A chunk's score is how many distinct terms its symbol and body hold. Chunks that strictly contain
    another scoring chunk drop out; then score, named before unnamed, the smaller span, the smaller id. An
    unnamed winner takes the label of its smallest named container. Hits without a scoring chunk give none.
    """
    asked = F.array(*map(F.lit, terms)).cast("array<string>")
    rows = materialize(nodes.join(hits.select("path").distinct(), "path", "left_semi").dropDuplicates(["id"]).select(
        "id", "path", "symbol", "node_type", "start_line", "end_line",
        F.size(F.array_intersect(split_ident(F.concat_ws(" ", F.coalesce("symbol", F.lit("")), F.coalesce("body", F.lit("")))), asked)).alias("s"),
    ), "localized")  # only the chunks of the hits
    scoring = rows.filter("s > 0")
    outer = scoring.alias("x").join(scoring.alias("o"), (F.col("x.path") == F.col("o.path")) & _contains("x", "o"), "left_semi").select("id")
    leaf = scoring.join(outer, "id", "left_anti")
    pool = leaf.unionByName(scoring.join(leaf.select("path").distinct(), "path", "left_anti"))
    named = F.col("symbol").isNotNull()
    w = Window.partitionBy("path").orderBy(F.desc("s"), F.desc(named), F.col("end_line") - F.col("start_line"), "id")
    best = pool.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    holders = best.filter("symbol IS NULL").alias("c").join(rows.filter("symbol IS NOT NULL").alias("o"), (F.col("c.path") == F.col("o.path")) & _contains("o", "c"))
    v = Window.partitionBy("c.id").orderBy(F.col("o.end_line") - F.col("o.start_line"), "o.id")
    holder = holders.withColumn("n", F.row_number().over(v)).filter("n = 1").select(F.col("c.id").alias("id"), F.struct("o.symbol", "o.node_type", "o.start_line", "o.end_line").alias("h"))
    own = F.struct("symbol", "node_type", "start_line", "end_line")
    return best.join(holder, "id", "left").select("path", F.coalesce("h", own).alias("k")).select("path", "k.*")


def inline_bodies(hits: DataFrame, chunks: DataFrame, present: DataFrame, indexed: DataFrame, memory: DataFrame) -> DataFrame:
    """hits with body: verbatim memory; the chunk's body if the file is unchanged or gone; null if it has
    drifted; the whole file if nothing was localised.

    chunks (path, chunk_body), present (path, hash, body), indexed (path, hash), memory (path, text).
    """
    j = hits.join(memory.select("path", "text"), "path", "left").join(chunks.select("path", "chunk_body"), "path", "left")
    j = j.join(present.select("path", F.col("hash").alias("_now"), F.col("body").alias("_file")), "path", "left").join(indexed.select("path", F.col("hash").alias("_then")), "path", "left")
    state = chunk_state(F.col("_then"), F.col("_now"))
    body = F.when(F.col("text").isNotNull(), F.col("text")).when(F.col("chunk_body").isNull(), F.col("_file")).when(state != "drifted", F.col("chunk_body"))
    return j.withColumn("body", body).drop("text", "chunk_body", "_now", "_file", "_then")


def chunk_state(stored: Column, now: Column) -> Column:
    return F.when(now.isNull(), "missing").when(stored.eqNullSafe(now), "ok").otherwise("drifted")


def retrieval_quality(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of MRR and P@k from (query_id, rank of the target or null)."""
    return ranked.agg(
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"p_at_{k}") for k in ks]
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the curve, from positions among the distinct scores, ties shared.

    Distinct scores are laid out by range; a position is what lies in lower ranges plus the place in its own, so no task
    holds them all.
    """
    groups = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    laid = materialize(groups.repartitionByRange(F.col(score)).withColumn("part", F.spark_partition_id()), "scores")
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shares = laid.groupBy("part").agg(F.sum("n").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(lower), F.lit(0))).drop("m")
    below = Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    before = laid.join(F.broadcast(shares), "part").withColumn("under", F.col("ahead") + F.coalesce(F.sum("n").over(below), F.lit(0)))
    sums = before.agg(F.sum(F.col("pos") * (F.col("under") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))
