"""Registered queries of the core and the SQL that states each of them independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem_postings
from ..operators import folds, graph, lexical, memory, rank
from ..operators.fences import GLOBAL, fence_of
from ..session import materialize

NOW = 1_790_000_000_000
QUERY = "compare the stack trace with the memory leak"
CODE_QUERY = "flush hot ledger cursor session"
TENANT = "team-03"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql_terms(text: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t in T.query_terms(text)) + "]"


#: Identifier parts in DuckDB.
_SPLIT = "list_filter(string_split(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _split(x: str) -> str:
    return _SPLIT.format(x)


# --- written rows: documents with a tenant (sources of teams), a time and an expiry


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """documents as written memory: the teams' rows have an owner, uploads expire after 90 days."""
    made = F.unix_millis(F.col("created_at").cast("timestamp"))
    return _t(spark, d, "documents").select(
        "doc_id", "path", F.col("path").alias("id"), "kind", "provenance", F.when(F.col("source").startswith("team-"), F.col("source")).alias("owner"),
        F.lit(None).cast("string").alias("session"), made.alias("created_at"), F.when(F.col("kind") == "episode", made).alias("occurred_at"),
        F.when(F.col("kind") == "doc", made + 90 * memory.DAY).alias("expires_at"), "text", F.col("doc_id").alias("seq"),
    )


_ROWS = f"""rows AS (
  SELECT doc_id, path, path AS id, kind, provenance, CASE WHEN starts_with(source, 'team-') THEN source END AS owner,
    epoch_ms(created_at) AS created_at, CASE WHEN kind = 'episode' THEN epoch_ms(created_at) END AS occurred_at,
    CASE WHEN kind = 'doc' THEN epoch_ms(created_at) + {90 * memory.DAY} END AS expires_at, text FROM documents
)"""
_LIVE = f"(expires_at IS NULL OR expires_at > {NOW})"
_OWN = f"(owner IS NULL OR owner = '{TENANT}')"

# --- lexical search

_corpus = lambda spark, d: _rows(spark, d).withColumn("tokens", T.split_ident(F.coalesce("text", F.lit(""))))
_words = lambda spark, d: _rows(spark, d).withColumn("words", T.ident_words(F.coalesce("text", F.lit(""))))


def recall_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best facts for a query; statistics over all rows."""
    hits = lexical.bm25(_words(spark, d), T.query_terms(QUERY), F.col("kind") == "fact")
    return rank.top(hits.withColumn("score", F.round("score", 6)), 10, key="doc_id").select("doc_id", "kind", "score")


def _bm25_sql(corpus: str, terms: str, key: str) -> str:
    return f"""
, c AS ({corpus}), q AS (SELECT unnest({terms}) AS term), st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM c),
tf AS (SELECT {key}, term, len(list_filter(tokens, lambda x: x = term)) AS tf, len(tokens) AS dl FROM c, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
s AS (
  SELECT {key}, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY {key}
)"""


_C = f"SELECT *, {_split('text')} AS tokens FROM rows"
_S = "WITH " + _ROWS + _bm25_sql(_C, _sql_terms(QUERY), "doc_id")
RECALL_BM25 = _S + " SELECT doc_id, kind, round(score, 6) AS score FROM s JOIN rows USING (doc_id) WHERE kind = 'fact' ORDER BY score DESC, doc_id LIMIT 10"


def recall_grouped_topn(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.bm25(_words(spark, d), T.query_terms(QUERY)).withColumn("score", F.round("score", 6))
    return rank.top_per(hits, ["kind"], 5, key="doc_id").select("kind", "rank", "doc_id", "score")


RECALL_GROUPED = _S + """ SELECT kind, CAST(n AS INTEGER) AS rank, doc_id, score FROM (
  SELECT kind, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY kind ORDER BY round(score, 6) DESC, doc_id) AS n FROM s JOIN rows USING (doc_id)) WHERE n <= 5"""


def recall_fenced(spark: SparkSession, d: str) -> DataFrame:
    """What one tenant and the shared tier hold of live rows, best first."""
    from ..operators.fences import live, owned

    f = fence_of(TENANT, now=NOW)
    keep = owned(F.col("owner"), f) & live(F.col("expires_at"), f.now)
    hits = lexical.bm25(_words(spark, d), T.query_terms(QUERY), keep).withColumn("score", F.round("score", 6))
    return rank.top(hits, 20, key="doc_id").select("doc_id", "kind", "owner", "score")


RECALL_FENCED = _S + f" SELECT doc_id, kind, owner, round(score, 6) AS score FROM s JOIN rows USING (doc_id) WHERE {_OWN} AND {_LIVE} ORDER BY round(score, 6) DESC, doc_id LIMIT 20"


def recall_many(spark: SparkSession, d: str) -> DataFrame:
    """Every shared memory as a query over an inverted index of the documents: its three best rows."""
    corpus = materialize(_corpus(spark, d).select("doc_id", "tokens"), "tokens")  # texts are cut into words once
    asked = _t(spark, d, "mem_text").select(F.col("path").alias("query_id"), T.keywords(F.col("text")).alias("terms"))
    index = lexical.postings(corpus, ["doc_id"], asked.select(F.explode("terms").alias("term")))
    scored = lexical.bm25_many(index, lexical.corpus_stats(corpus), asked, ["doc_id"])
    return rank.top_per(scored.withColumn("score", F.round("score", 6)), ["query_id"], 3, key="doc_id").select("query_id", "rank", "doc_id", "score")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
RECALL_MANY = f"""WITH {_ROWS}, c AS ({_C}), st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM c),
q AS (SELECT DISTINCT path AS query_id, unnest(list_filter({_split('text')}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))) AS term FROM mem_text),
p AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM c), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 3"""


def recall_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The memory domain: facts and episodes with stemmed terms and statistics of their own."""
    mem = _corpus(spark, d).filter(F.col("kind").isin(*memory.MEM_KINDS))
    index = stem_postings(lexical.postings(mem, ["doc_id"]))
    from ..functions.stem import stem

    asked = spark.createDataFrame([("q", sorted({stem(t) for t in T.query_terms(QUERY)}))], "query_id string, terms array<string>")
    scored = lexical.bm25_many(index, lexical.corpus_stats(mem), asked, ["doc_id"])
    return rank.top(scored.withColumn("score", F.round("score", 6)), 20, key="doc_id").select("doc_id", "score")


#: The forms of the query's words and the stem they share.
_STEMS = {"compar": "compar(e|es|ed|er|ers|ing)", "stack": "stack(s|ed|ing|er|ers)?", "trace": "trac(e|es|ed|ing)", "memori": "memor(y|ies)", "leak": "leak(s|ed|ing)?"}
_STEMMED = "CASE " + " ".join(f"WHEN regexp_full_match(w, '{p}') THEN '{s}'" for s, p in _STEMS.items()) + " ELSE w END"
RECALL_STEMMED = (
    "WITH " + _ROWS + _bm25_sql(f"SELECT doc_id, list_transform({_split('text')}, lambda w: {_STEMMED}) AS tokens FROM rows WHERE kind IN ('fact', 'episode')", str(list(_STEMS)), "doc_id")
    + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20"
)


def tokenize_ident(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nodes").select("id", "symbol").distinct().select("id", F.array_join(T.split_ident(F.coalesce("symbol", F.lit(""))), " ").alias("parts"))


TOKENIZE = f"SELECT id, array_to_string({_split('symbol')}, ' ') AS parts FROM (SELECT DISTINCT id, symbol FROM nodes)"


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "mem_text").select("path", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("terms"))


KEYWORDS = f"SELECT path, array_to_string(list_sort(list_distinct(list_filter({_split('text')}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)))), ' ') AS terms FROM mem_text"

# --- code recall with spreading, cosine and localisation


def _code(spark: SparkSession, d: str) -> DataFrame:
    one = _t(spark, d, "docs").select("path", "kind", F.coalesce("body", F.lit("")).alias("body")).groupBy("path").agg(F.max("kind").alias("kind"), F.max("body").alias("body"))
    return one.withColumn("words", T.ident_words(F.concat("path", F.lit(" "), "body")))


_CODE = f"""WITH one AS (SELECT path, max(kind) AS kind, max(coalesce(body, '')) AS body FROM docs GROUP BY path)
""" + _bm25_sql(f"SELECT path, kind, list_concat({_split('path')}, {_split('body')}) AS tokens FROM one", _sql_terms(CODE_QUERY), "path")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.bm25(_code(spark, d), T.query_terms(CODE_QUERY), F.col("kind") == "code")
    return materialize(rank.top(hits.select("path", F.round("score", 6).alias("score")), rank.pool_size(10)), "pool")  # at most 400 rows


_POOL = _CODE + """, pool AS (SELECT path, round(score, 6) AS score FROM s JOIN one USING (path) WHERE kind = 'code' ORDER BY round(score, 6) DESC, path LIMIT 200)"""


def recall_spread(spark: SparkSession, d: str) -> DataFrame:
    out = rank.spread(_pool(spark, d), _t(spark, d, "edges"))
    return out.select("path", "bm25", F.round("score", 6).alias("score"))


_SPREAD = _POOL + """, nm AS (SELECT path, score AS bm25, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS norm FROM pool, (SELECT min(score) AS lo, max(score) AS hi FROM pool)),
und AS (SELECT src_path AS a, dst_path AS b FROM edges WHERE src_path <> dst_path UNION SELECT dst_path, src_path FROM edges WHERE src_path <> dst_path),
nb AS (SELECT a AS path, max(nm.norm) AS nbr FROM und JOIN nm ON nm.path = und.b GROUP BY a),
sp AS (SELECT nm.path, bm25, CASE WHEN (SELECT count(*) FROM pool) < 2 THEN bm25 ELSE norm + 0.3 * coalesce(nbr, 0) END AS score FROM nm LEFT JOIN nb USING (path))"""
RECALL_SPREAD = _SPREAD + " SELECT path, bm25, round(score, 6) AS score FROM sp"


def _query_vector(vectors: DataFrame) -> list[float]:
    """The vector of the first path of the larger length stands for the query's."""
    first = vectors.filter(F.size("vec") == 128).orderBy("path").limit(1).collect()
    return first[0]["vec"] if first else [0.0] * 128


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = rank.usable(_t(spark, d, "file_embeddings"))
    near = rank.similarity(vectors, _query_vector(vectors)).filter("cosine > 0").withColumn("cosine", F.round("cosine", 6))
    return rank.top(near, 20, "cosine")


_VEC = """u AS (SELECT path, min(vec::DOUBLE[]) AS v FROM file_embeddings WHERE path IS NOT NULL AND len(vec) = dim
  AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY path),
qv AS (SELECT v AS q FROM u WHERE len(v) = 128 ORDER BY path LIMIT 1),
near AS (SELECT path, CASE WHEN len(v) = 128 THEN list_cosine_similarity(v, q) ELSE 0 END AS cosine FROM u, qv)"""
KNN = f"WITH {_VEC} SELECT path, round(cosine, 6) AS cosine FROM near WHERE cosine > 0 ORDER BY round(cosine, 6) DESC, path LIMIT 20"


def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    """Lexical pool and nearest nominees fused with cosine."""
    spreaded = rank.spread(_pool(spark, d), _t(spark, d, "edges")).select("path", F.round("score", 6).alias("score"))
    pool = materialize(rank.top(spreaded, 200), "pool")
    vectors = rank.usable(_t(spark, d, "file_embeddings"))
    near = materialize(rank.similarity(vectors, _query_vector(vectors)).withColumn("cosine", F.round("cosine", 6)), "near")
    out = rank.fuse(pool, near, rank.nominees(near, pool))
    return out.select("path", "score", "cosine", F.round("fused", 5).alias("fused"))


RECALL_FUSED = _SPREAD + f""", {_VEC}, p AS (SELECT path, round(score, 6) AS score FROM sp), c AS (SELECT path, round(cosine, 6) AS cosine FROM near),
nom AS (SELECT path FROM c WHERE cosine > 0 AND path NOT IN (SELECT path FROM p) ORDER BY cosine DESC, path LIMIT 8),
al AS (SELECT * FROM p UNION ALL SELECT path, coalesce((SELECT min(score) FROM p), 0) FROM nom), j AS (SELECT al.*, cosine FROM al LEFT JOIN c USING (path)),
e AS (SELECT min(score) AS s0, max(score) AS s1, min(coalesce(cosine, 0)) AS c0, max(coalesce(cosine, 0)) AS c1 FROM j)
SELECT path, score, cosine, round(CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 1 END + CASE WHEN c1 > c0 THEN (coalesce(cosine, 0) - c0) / (c1 - c0) ELSE 1 END, 5) AS fused FROM j, e""".replace(", c AS (SELECT path, round", ", cn AS (SELECT path, round").replace("FROM c WHERE cosine", "FROM cn WHERE cosine").replace("LEFT JOIN c USING", "LEFT JOIN cn USING")


def localize(spark: SparkSession, d: str) -> DataFrame:
    hits = rank.top(_pool(spark, d), 50)
    return rank.localize(hits, _t(spark, d, "nodes").filter("start_line IS NOT NULL AND end_line IS NOT NULL"), T.query_terms(CODE_QUERY))


LOCALIZE = _POOL + f""", h AS (SELECT path FROM pool ORDER BY score DESC, path LIMIT 50),
r AS (SELECT id, path, any_value(symbol) AS symbol, any_value(node_type) AS node_type, any_value(start_line) AS start_line, any_value(end_line) AS end_line,
    max(len(list_intersect(list_distinct({_split("concat_ws(' ', coalesce(symbol, ''), coalesce(body, ''))")}), {_sql_terms(CODE_QUERY)}))) AS sc
  FROM nodes WHERE path IN (SELECT path FROM h) AND start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY id, path),
x AS (SELECT * FROM r WHERE sc > 0),
lf AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x o WHERE o.path = x.path AND x.start_line <= o.start_line AND x.end_line >= o.end_line AND x.end_line - x.start_line > o.end_line - o.start_line)),
pl AS (SELECT * FROM lf UNION ALL SELECT * FROM x WHERE path NOT IN (SELECT path FROM lf)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sc DESC, symbol IS NULL, end_line - start_line, id) AS n FROM pl) WHERE n = 1),
hd AS (SELECT * FROM (SELECT b.id AS bid, r.symbol AS hs, r.node_type AS ht, r.start_line AS h0, r.end_line AS h1, row_number() OVER (PARTITION BY b.id ORDER BY r.end_line - r.start_line, r.id) AS n
  FROM b JOIN r ON r.path = b.path AND b.symbol IS NULL AND r.symbol IS NOT NULL AND r.start_line <= b.start_line AND r.end_line >= b.end_line AND r.end_line - r.start_line > b.end_line - b.start_line) WHERE n = 1)
SELECT path, CASE WHEN bid IS NULL THEN symbol ELSE hs END AS symbol, CASE WHEN bid IS NULL THEN node_type ELSE ht END AS node_type,
  CASE WHEN bid IS NULL THEN start_line ELSE h0 END AS start_line, CASE WHEN bid IS NULL THEN end_line ELSE h1 END AS end_line FROM b LEFT JOIN hd ON hd.bid = b.id"""


def vectorless(spark: SparkSession, d: str) -> DataFrame:
    """Indexed paths without a vector."""
    return _t(spark, d, "file_index").select("path").filter("path IS NOT NULL").distinct().join(_t(spark, d, "file_embeddings").select("path"), "path", "left_anti")


VECTORLESS = "SELECT DISTINCT path FROM file_index WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM file_embeddings WHERE path IS NOT NULL)"


def ablation_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each query by a weighted sum of min-maxed signals."""
    one = _t(spark, d, "hits").groupBy("query_id", "path").agg(F.max(F.struct("hit_id", "score", "cosine")).alias("m")).select("query_id", "path", "m.score", "m.cosine")
    w = Window.partitionBy("query_id")
    z = lambda c: F.coalesce(T.minmax(F.col(c), F.min(c).over(w), F.max(c).over(w), 0.0), F.lit(0.0))
    return one.select("query_id", "path", F.round(0.6 * z("score") + 0.4 * z("cosine"), 6).alias("total"))


ABLATION = """WITH o AS (SELECT query_id, path, score, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY hit_id DESC, score DESC NULLS LAST, cosine DESC NULLS LAST) AS n FROM hits) WHERE n = 1),
e AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(cosine) OVER w AS c0, max(cosine) OVER w AS c1 FROM o WINDOW w AS (PARTITION BY query_id))
SELECT query_id, path, round(0.6 * coalesce(CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 0 END, 0) + 0.4 * coalesce(CASE WHEN c1 > c0 THEN (cosine - c0) / (c1 - c0) ELSE 0 END, 0), 6) AS total FROM e"""

# --- counts, lists, demand


def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return memory.count_by_kind(_rows(spark, d), fence_of(TENANT, now=NOW))


COUNT_BY_KIND = f"WITH {_ROWS} SELECT kind, count(*) AS n FROM rows WHERE kind IN ('fact', 'episode', 'doc') AND {_OWN} AND {_LIVE} GROUP BY kind"


def count_shared(spark: SparkSession, d: str) -> DataFrame:
    return memory.count_by_kind(_rows(spark, d), fence_of(GLOBAL, now=NOW))


COUNT_SHARED = f"WITH {_ROWS} SELECT kind, count(*) AS n FROM rows WHERE kind IN ('fact', 'episode', 'doc') AND owner IS NULL AND {_LIVE} GROUP BY kind"


def totals(spark: SparkSession, d: str) -> DataFrame:
    return memory.totals(_t(spark, d, "nodes"), _t(spark, d, "edges"), _t(spark, d, "file_embeddings"), memory.demand(_t(spark, d, "recall_log")))


_LOG = "lg AS (SELECT id, path, kind, symbol, lower(coalesce(action, 'recall')) AS action, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END AS ts FROM (SELECT DISTINCT * FROM recall_log))"
TOTALS = f"WITH {_LOG} SELECT (SELECT count(DISTINCT id) FROM nodes) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src_path, dst_path FROM edges)) AS edges, (SELECT count(DISTINCT path) FROM file_embeddings) AS vectors, (SELECT count(*) FROM lg WHERE action = 'recall') AS recalls"


def recent_memory(spark: SparkSession, d: str) -> DataFrame:
    return memory.recent_memory(_rows(spark, d), fence_of(TENANT)).select("path", "kind", "at")


RECENT_MEMORY = f"""WITH {_ROWS} SELECT path, kind, coalesce(occurred_at, created_at) AS "at" FROM rows WHERE kind IN ('fact', 'episode') AND {_OWN} ORDER BY "at" DESC NULLS LAST, path LIMIT 20"""


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return memory.recent_docs(_rows(spark, d), fence_of(TENANT, now=NOW)).select("path", "created_at")


RECENT_DOCS = f"WITH {_ROWS} SELECT path, created_at FROM rows WHERE kind = 'doc' AND {_OWN} AND {_LIVE} ORDER BY created_at DESC NULLS LAST, path LIMIT 20"


def enumerate_page(spark: SparkSession, d: str) -> DataFrame:
    facts = _rows(spark, d).filter("kind = 'fact'")
    return memory.enumerate_page(facts, 100, 50).select("doc_id", "path")


ENUMERATE = f"WITH {_ROWS} SELECT doc_id, path FROM rows WHERE kind = 'fact' ORDER BY doc_id LIMIT 50 OFFSET 100"


def use_counts(spark: SparkSession, d: str) -> DataFrame:
    """Recalls of every document and shared memory."""
    rows = _t(spark, d, "docs").select("path").unionByName(_t(spark, d, "mem_text").select("path")).distinct()
    return memory.use_counts(rows, memory.demand(_t(spark, d, "recall_log")))


USE_COUNTS = f'WITH {_LOG} SELECT r.path, count(lg.id) AS "use" FROM (SELECT path FROM docs UNION SELECT path FROM mem_text) r LEFT JOIN lg ON lg.path = r.path AND lg.action = \'recall\' GROUP BY r.path'


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Memories that have a vector, as written by an agent when they were first used."""
    first = memory.demand(_t(spark, d, "recall_log")).groupBy("path").agg(F.min("ts").alias("occurred_at"))
    rows = _t(spark, d, "file_embeddings").select("path").distinct().withColumn("kind", F.substring_index("path", ":", 1)).filter(F.col("kind").isin(*memory.MEM_KINDS))
    return rows.join(first, "path", "left").withColumns({"provenance": F.lit("agent"), "owner": F.lit(None).cast("string")})


def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are recalled often."""
    return memory.review_candidates(_written(spark, d), memory.demand(_t(spark, d, "recall_log")), 12)


_HITS = "h AS (SELECT path, count(*) AS hits FROM lg WHERE action = 'recall' GROUP BY path), fi AS (SELECT path, min(ts) AS occurred_at FROM lg GROUP BY path)"
REVIEW = f"WITH {_LOG}, {_HITS} SELECT DISTINCT path, hits FROM file_embeddings JOIN h USING (path) JOIN fi USING (path) WHERE split_part(path, ':', 1) = 'fact' AND hits >= 12"
WINDOW_DAYS = 60


def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of the last days that are recalled often."""
    return memory.promotion_candidates(_written(spark, d), memory.demand(_t(spark, d, "recall_log")), NOW, 8, WINDOW_DAYS)


PROMOTION = REVIEW.replace("'fact'", "'episode'").replace("hits >= 12", f"hits >= 8 AND occurred_at >= {NOW - WINDOW_DAYS * memory.DAY}")


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return memory.recent_activity(memory.demand(_t(spark, d, "recall_log")), NOW, 7, 100)


RECENT_ACTIVITY = f"WITH {_LOG} SELECT path, symbol, max(ts) AS last, count(DISTINCT ts) AS edits, arg_max(kind, ts) AS kind FROM lg WHERE ts BETWEEN {NOW - 7 * memory.DAY} AND {NOW} GROUP BY path, symbol ORDER BY last DESC, path, symbol NULLS FIRST LIMIT 100"


def activation(spark: SparkSession, d: str) -> DataFrame:
    """Base-level activation of every path from its accesses, in days."""
    log = memory.demand(_t(spark, d, "recall_log")).filter(F.col("ts") <= NOW)
    age = F.greatest((NOW - F.col("ts")) / memory.DAY, F.lit(1.0))
    return log.groupBy("path").agg(F.round(F.ln(F.sum(F.pow(age, F.lit(-0.5)))), 5).alias("activation"))


ACTIVATION = f"WITH {_LOG} SELECT path, round(ln(sum(pow(greatest(({NOW} - ts) / {memory.DAY}.0::DOUBLE, 1.0), -0.5))), 5) AS activation FROM lg WHERE ts <= {NOW} GROUP BY path"


def expire_purge(spark: SparkSession, d: str) -> DataFrame:
    return memory.purge(_rows(spark, d), NOW, 1).select("id", "kind")


EXPIRE = f"WITH {_ROWS} SELECT id, kind FROM rows WHERE expires_at <= {NOW}"


def prune_episodes(spark: SparkSession, d: str) -> DataFrame:
    return memory.prune_episodes(_rows(spark, d), NOW, 1).select("id")


PRUNE = f"WITH {_ROWS} SELECT id FROM rows WHERE kind = 'episode' AND occurred_at < {NOW - 30 * memory.DAY}"


def forget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return memory.forget(_rows(spark, d), 1, prefix="fact:0000", scope=TENANT).select("id", "owner")


FORGET = f"WITH {_ROWS} SELECT id, owner FROM rows WHERE kind IN ('fact', 'episode') AND starts_with(id, 'fact:0000') AND owner = '{TENANT}'"


def op_log_state(spark: SparkSession, d: str) -> DataFrame:
    """Index rows as a log of puts (the last write of a path wins)."""
    ops = _t(spark, d, "file_index").filter("path IS NOT NULL").select(F.col("indexed_at").alias("seq"), F.lit("put").alias("op"), F.lit(None).cast("string").alias("owner"), F.col("path").alias("id"), "size")
    return memory.current(ops).select("id", "seq", "size")


OP_LOG = "SELECT path AS id, indexed_at AS seq, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS n FROM file_index WHERE path IS NOT NULL) WHERE n = 1"


def peek_stash(spark: SparkSession, d: str) -> DataFrame:
    p = T.peek(F.col("text"))
    return _t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", p.alias("p")).select("doc_id", "p.head", "p.tail", "p.chars", "p.bytes", "p.truncated")


PEEK = "SELECT doc_id, substr(text, 1, 160) AS head, CASE WHEN length(text) > 240 THEN right(text, 80) END AS tail, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes, length(text) > 160 AS truncated FROM documents WHERE text IS NOT NULL"


def evict_keep_n(spark: SparkSession, d: str) -> DataFrame:
    return memory.evict(_rows(spark, d), older_than=NOW - 300 * memory.DAY, keep_newest=500)


EVICT = f"WITH {_ROWS}, r AS (SELECT id, created_at FROM rows), y AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM r WHERE created_at >= {NOW - 300 * memory.DAY}) SELECT id FROM r WHERE created_at < {NOW - 300 * memory.DAY} UNION ALL SELECT id FROM y WHERE n > 500"

# --- graph


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_t(spark, d, "edges"))


DEGREE = """WITH e AS (SELECT DISTINCT type, src_path, dst_path FROM edges), p AS (SELECT src_path AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_path, 0, 1 FROM e)
SELECT path, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(i) AS BIGINT) AS imported_by FROM p GROUP BY path"""


def related_2hop(spark: SparkSession, d: str) -> DataFrame:
    """What every repository's most imported path reaches in two steps."""
    w = Window.partitionBy("repo").orderBy(F.desc("imported_by"), "path")
    seeds = graph.degrees(_t(spark, d, "edges")).withColumn("repo", F.substring_index("path", "/", 1)).withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("path").alias("seed"))
    return graph.related(_t(spark, d, "edges"), seeds, 2)


RELATED = """WITH e AS (SELECT DISTINCT src_path, dst_path FROM edges WHERE type = 'import' AND src_path <> dst_path),
arc AS (SELECT src_path AS f, dst_path AS t, 0 AS d FROM e UNION ALL SELECT dst_path, src_path, 1 FROM e),
deg AS (SELECT dst_path AS path, count(*) AS c FROM (SELECT DISTINCT src_path, dst_path FROM edges) GROUP BY 1),
seeds AS (SELECT path AS seed FROM (SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY c DESC, path) AS n FROM deg) WHERE n = 1),
h1 AS (SELECT seed, t AS id, min(d) AS d FROM seeds JOIN arc ON f = seed WHERE t <> seed GROUP BY 1, 2),
h2 AS (SELECT h1.seed, t AS id, min(arc.d) AS d FROM h1 JOIN arc ON f = h1.id WHERE t <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = t) GROUP BY 1, 2)
SELECT seed, id, 1 AS hops, CASE WHEN d = 0 THEN 'out' ELSE 'in' END AS via FROM h1 UNION ALL SELECT seed, id, 2, CASE WHEN d = 0 THEN 'out' ELSE 'in' END FROM h2"""


def symbol_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of every class outside its own definitions."""
    defs = _t(spark, d, "nodes").filter("symbol IS NOT NULL AND node_type IN ('class_declaration', 'class_definition') AND start_line IS NOT NULL AND end_line IS NOT NULL").dropDuplicates(["id"])
    return graph.mention_counts(_t(spark, d, "docs"), defs)


MENTIONS = r"""WITH df AS (SELECT DISTINCT symbol, path, start_line, end_line FROM nodes WHERE symbol IS NOT NULL AND node_type IN ('class_declaration', 'class_definition') AND start_line IS NOT NULL AND end_line IS NOT NULL),
b AS (SELECT DISTINCT path, body FROM docs WHERE path IS NOT NULL AND body IS NOT NULL),
l AS (SELECT path, unnest(list_zip(range(len(string_split(body, chr(10)))), string_split(body, chr(10)))) AS z FROM b),
w AS (SELECT path, z[1] AS line, unnest(regexp_extract_all(z[2], '[A-Za-z0-9_$]+')) AS symbol FROM l),
u AS (SELECT * FROM w WHERE symbol IN (SELECT symbol FROM df))
SELECT symbol, count(*) AS mentions FROM u WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.symbol = u.symbol AND df.path = u.path AND u.line BETWEEN df.start_line AND df.end_line) GROUP BY symbol"""

# --- folds: documents of one source are a conversation, in order of doc_id


def _units(spark: SparkSession, d: str) -> DataFrame:
    """documents as transcripts: 25 consecutive ids of a kind of rows form one."""
    return _t(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 25).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("doc_id").cast("string").alias("id"), F.lit("user").alias("role"), F.col("text").alias("content"),
        "kind", F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("symbol"), (F.col("doc_id") % 11 == 0).alias("pinned"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("g")).alias("atomic"), F.lit(None).cast("double").alias("tokensApprox"),
    )


BUDGET = 1500


def assemble_fit(spark: SparkSession, d: str) -> DataFrame:
    return folds.assemble(_units(spark, d), BUDGET).select("conv_id", "turn", "kept")


ASSEMBLE = f"""WITH RECURSIVE u AS (SELECT doc_id // 25 AS conv_id, doc_id AS turn, ceil(length(coalesce(text, '')) / 4.0) AS tok, doc_id % 11 = 0 AS pin,
    CASE WHEN doc_id % 7 = 0 THEN 'g' ELSE 'u' || doc_id END AS item FROM documents),
it AS (SELECT conv_id, item, sum(tok) FILTER (NOT pin) AS tok, max(turn) FILTER (NOT pin) AS pos, bool_or(pin) AS forced FROM u GROUP BY conv_id, item),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS n FROM it WHERE pos IS NOT NULL),
p AS (SELECT conv_id, coalesce(sum(tok) FILTER (pin), 0) AS pre FROM u GROUP BY conv_id),
f(conv_id, n, used, item, ok) AS (
  SELECT conv_id, 0::BIGINT, pre::DOUBLE, ''::VARCHAR, false FROM p
  UNION ALL
  SELECT f.conv_id, o.n, CASE WHEN o.forced OR f.used + o.tok <= {BUDGET} THEN f.used + o.tok ELSE f.used END, o.item, o.forced OR f.used + o.tok <= {BUDGET} FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1
)
SELECT u.conv_id, u.turn, u.pin OR coalesce(f.ok, false) AS kept FROM u LEFT JOIN f ON f.conv_id = u.conv_id AND f.item = u.item"""


def trim_last_n(spark: SparkSession, d: str) -> DataFrame:
    return folds.trim(_units(spark, d), keep_last=8).select("conv_id", "turn", "kept")


TRIM = """WITH u AS (SELECT doc_id // 25 AS conv_id, doc_id AS turn, doc_id % 11 = 0 AS pin, CASE WHEN doc_id % 7 = 0 THEN 'g' ELSE 'u' || doc_id END AS item FROM documents),
it AS (SELECT conv_id, item, max(turn) FILTER (NOT pin) AS pos, bool_or(pin) AS forced FROM u GROUP BY conv_id, item), o AS (SELECT *, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC NULLS LAST) END AS n FROM it)
SELECT u.conv_id, u.turn, u.pin OR o.forced OR coalesce(o.n <= 8, false) AS kept FROM u JOIN o USING (conv_id, item)"""


def pack_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's sentences-per-line packed to segments of 800 characters."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(folds.pack_paragraphs(lines)).alias("segment", "text"))


PACK = """WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS a FROM documents),
f(doc_id, n, seg, open) AS (
  SELECT doc_id, 1::BIGINT, 0::BIGINT, a[1] FROM p WHERE len(a) > 0
  UNION ALL
  SELECT f.doc_id, f.n + 1, CASE WHEN length(open) + 1 + length(a[f.n + 1]) <= 800 THEN seg ELSE seg + 1 END,
    CASE WHEN length(open) + 1 + length(a[f.n + 1]) <= 800 THEN open || chr(10) || a[f.n + 1] ELSE a[f.n + 1] END FROM f JOIN p USING (doc_id) WHERE f.n < len(a)
)
SELECT doc_id, CAST(seg AS INTEGER) AS segment, arg_max(open, n) AS text FROM f GROUP BY doc_id, seg"""


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    md = _t(spark, d, "docs").filter("format = 'md' AND body IS NOT NULL").groupBy("path").agg(F.max("body").alias("body"))
    return folds.sections(md, ["path"]).select("path", "node_type", "start_line", "end_line")


SECTIONS = r"""WITH b AS (SELECT path, max(body) AS body FROM docs WHERE format = 'md' AND body IS NOT NULL GROUP BY path), s AS (SELECT path, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM b),
l AS (SELECT path, unnest(list_zip(range(len(a)), a)) AS z FROM s), r AS (SELECT path, z[1] AS line, z[2] AS t, sum(CASE WHEN regexp_matches(z[2], '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY z[1]) AS sec FROM l),
g AS (SELECT path, sec, min(line) AS l0, max(line) AS l1, bool_or(regexp_matches(t, '\S')) AS ink FROM r GROUP BY path, sec), x AS (SELECT *, max(sec) OVER (PARTITION BY path) AS last FROM g)
SELECT path, CASE WHEN sec > 0 THEN 'section' WHEN last > 0 THEN 'preamble' ELSE 'file' END AS node_type, CAST(l0 AS INTEGER) AS start_line, CAST(l1 AS INTEGER) AS end_line FROM x WHERE sec > 0 OR last = 0 OR ink"""

QUERIES = {
    recall_bm25: RECALL_BM25, recall_grouped_topn: RECALL_GROUPED, recall_fenced: RECALL_FENCED, recall_many: RECALL_MANY, recall_stemmed: RECALL_STEMMED, tokenize_ident: TOKENIZE, keywords: KEYWORDS,
    recall_spread: RECALL_SPREAD, knn_topk: KNN, recall_fused: RECALL_FUSED, localize: LOCALIZE, vectorless: VECTORLESS, ablation_ranks: ABLATION,
    count_by_kind: COUNT_BY_KIND, count_shared: COUNT_SHARED, totals: TOTALS, recent_memory: RECENT_MEMORY, recent_documents: RECENT_DOCS, enumerate_page: ENUMERATE,
    use_counts: USE_COUNTS, review_candidates: REVIEW, promotion_candidates: PROMOTION, recent_activity: RECENT_ACTIVITY, activation: ACTIVATION,
    expire_purge: EXPIRE, prune_episodes: PRUNE, forget_prefix: FORGET, op_log_state: OP_LOG, peek_stash: PEEK, evict_keep_n: EVICT,
    node_degree: DEGREE, related_2hop: RELATED, symbol_mentions: MENTIONS, assemble_fit: ASSEMBLE, trim_last_n: TRIM, pack_segments: PACK, markdown_sections: SECTIONS,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: s for f, s in QUERIES.items() if s}
