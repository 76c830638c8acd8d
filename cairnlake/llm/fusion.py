"""One ranking from several scores on different scales: reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Groups above this many rows are ranked in bins, so that no task sorts a whole hot group.
HOT_ROWS = 200_000
BINS = 256
#: More hot groups than this are joined by shuffle instead of broadcast.
HOT_BROADCAST = 50_000


def positions(df: DataFrame, group: list[str], values: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with a column for each of `values` (new name -> value column): 1 + the number of rows of the group
    with a larger value; null where the value is null or NaN.

    Groups of up to hot_rows rows are ranked by a window. Larger ones are cut into bins at approximate
    quantiles of their values: the exact position is the number of rows in higher bins plus the position
    among the distinct values of the row's bin.
    """
    spark = df.sparkSession
    clean = {v: F.when(~F.isnan(v), F.col(v)) for v in values.values()}
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = sizes.limit(HOT_BROADCAST + 1).collect()

    def plain(t: DataFrame) -> DataFrame:
        for name, v in values.items():
            w = Window.partitionBy(*group).orderBy(clean[v].desc_nulls_last())
            t = t.withColumn(name, F.when(clean[v].isNotNull(), F.rank().over(w)))
        return t

    if not hot:
        return plain(df)
    small = len(hot) <= HOT_BROADCAST
    keys = spark.createDataFrame([tuple(r[g] for g in group) for r in hot], df.select(*group).schema) if small else sizes.select(*group)
    keys = F.broadcast(keys) if small else keys
    same = reduce(lambda a, b: a & b, [df[g].eqNullSafe(keys[g]) for g in group])
    rest, big = plain(df.join(keys, same, "left_anti")), df.join(keys, same, "left_semi")
    for name, v in values.items():
        marks = [(i + 1) / BINS for i in range(BINS - 1)]
        ends = big.groupBy(*group).agg(F.percentile_approx(clean[v], marks, 10_000).alias("_ends"))
        ends = F.broadcast(ends) if small else ends
        counts = big.select(*group, clean[v].alias("_v")).filter("_v IS NOT NULL").groupBy(*group, "_v").agg(F.count("*").alias("_c"))
        binned = _join(counts, ends, group).withColumn("_bin", F.size(F.filter("_ends", lambda e: e > F.col("_v")))).drop("_ends")
        up = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        ahead = binned.groupBy(*group, "_bin").agg(F.sum("_c").alias("_c")).withColumn("_ahead", F.coalesce(F.sum("_c").over(up), F.lit(0))).drop("_c")
        within = Window.partitionBy(*group, "_bin").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
        ranks = _join(binned.withColumn("_in", F.coalesce(F.sum("_c").over(within), F.lit(0))), ahead, [*group, "_bin"])
        ranks = ranks.select(*group, "_v", (F.col("_ahead") + F.col("_in") + 1).cast("int").alias(name))
        big = _join(big.withColumn("_v", clean[v]), ranks, [*group, "_v"], "left").drop("_v")
    return rest.unionByName(big)


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys also match null with null."""
    renamed = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda x, y: x & y, [a[c].eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return a.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def fuse(
    hits: DataFrame, scores: tuple[str, ...] = ("score", "cosine"), group: str = "query_id", item: str = "path", newest: str = "hit_id",
    constant: float = 60.0, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(group, item, scores, pos_<score> for each, fused, position): the items of each group in one order.

    Of several rows of one (group, item) the one with the largest `newest` counts (nulls smallest; equal
    ones: the largest scores). A position by a score is 1 + the number of the group's items with a larger
    one; a null or NaN score gets no position and adds nothing. fused = sum of weight / (constant +
    position); a score that is the same for all items moves none of them. position is 1 + the number of
    items with a larger fused value; equal ones are ordered by item. Null groups and items form groups and
    items of their own. Columns other than these are ignored.
    """
    weights = weights or {}
    latest = F.max(F.struct(F.col(newest).alias("at"), *[F.col(s).alias(s) for s in scores])).alias("m")
    one = hits.groupBy(group, item).agg(latest).select(group, item, *[F.col(f"m.{s}").alias(s) for s in scores])
    placed = positions(one, [group], {f"pos_{s}": s for s in scores}, hot_rows)
    part: list[Column] = [F.coalesce(F.lit(weights.get(s, 1.0)) / (F.lit(constant) + F.col(f"pos_{s}")), F.lit(0.0)) for s in scores]
    fused = placed.withColumn("fused", reduce(lambda a, b: a + b, part))
    return positions(fused, [group], {"position": "fused"}, hot_rows)


def numbered(df: DataFrame, group: str, order: list[Column], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with the number of each row in the order of its group, from 1.

    Groups of up to hot_rows rows are numbered by a window. The rows of larger ones are sorted over all tasks by
    range; a row's number is what its group has in earlier partitions plus its place in its own.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(group)
    plain = _join(df, sizes, [group], "left_anti").withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    big = _join(df, sizes, [group], "left_semi")
    keys = [F.col(group).asc_nulls_first(), *order]
    laid = materialize(big.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # the upper bits of _at are the partition
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = laid.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    shares = shares.withColumn("_ahead", F.coalesce(F.sum("_many").over(before), F.lit(0))).drop("_many")
    out = _join(laid, shares, [group, "_part"]).withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_first") + 1)
    return plain.unionByName(out.drop("_at", "_part", "_first", "_ahead"))


def ranking(hits: DataFrame, **how) -> DataFrame:
    """(group, item, place): one order of the items of each group, from 1; the larger fused value first, equal ones by
    item, a null item before all others."""
    group, item = how.get("group", "query_id"), how.get("item", "path")
    fused = materialize(fuse(hits, **how).select(group, item, "fused"), "fused")  # numbered() reads it three times
    return numbered(fused, group, [F.desc("fused"), F.col(item).asc_nulls_first()], "place", how.get("hot_rows", HOT_ROWS)).drop("fused")


def agreed(hits: DataFrame, best: int = 3, **how) -> DataFrame:
    """(query_id, path) of the items among the `best` positions by every score."""
    scores = how.get("scores", ("score", "cosine"))
    cond = reduce(lambda a, b: a & b, [F.col(f"pos_{s}") <= best for s in scores])
    return fuse(hits, **how).filter(cond).select(how.get("group", "query_id"), how.get("item", "path"))
