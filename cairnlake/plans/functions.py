"""Registered queries over functions and operators that no other query reaches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, memory, rank
from ..operators.fences import fence_of
from ..session import materialize
from ..sources import files
from .queries import _LIVE, _OWN, _ROWS, NOW, TENANT, _rows, _split, _t


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "docs").filter("path IS NOT NULL AND body IS NOT NULL").select("path", "body").distinct()


_BODIES = "b AS (SELECT DISTINCT path, body FROM docs WHERE path IS NOT NULL AND body IS NOT NULL)"
_UNICODE = f"list_filter(string_split(regexp_replace(translate(lower({{0}}), '{T._MARKED}', '{T._PLAIN}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g'), ' '), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")


def _unicode(x: str) -> str:
    return _UNICODE.replace("{0}", x)


def unicode_terms(spark: SparkSession, d: str) -> DataFrame:
    """How often each document has each word of any script."""
    docs = _t(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(T.unicode_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


UNICODE_TERMS = f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_unicode('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL"


def camel_terms(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the camel-case names of each file."""
    return _bodies(spark, d).select("path", F.explode(T.camel_parts(F.col("body"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("n"))


_CAMEL = "list_filter(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: regexp_matches(x, '^[a-z_$]') AND regexp_matches(x, '[a-z][A-Z]'))"
CAMEL_TERMS = f"WITH {_BODIES}, n AS (SELECT path, unnest({_CAMEL.format('body')}) AS name FROM b), t AS (SELECT path, unnest({_split('name')}) AS term FROM n) SELECT path, term, count(*) AS n FROM t GROUP BY ALL"


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """What each file is found by: how many terms, and how many different ones."""
    names = _t(spark, d, "nodes").filter("path IS NOT NULL AND symbol IS NOT NULL").groupBy("path").agg(F.collect_set("symbol").alias("symbols"))
    terms = _bodies(spark, d).join(names, "path", "left").select("path", T.index_tokens(F.col("path"), F.col("symbols"), F.col("body")).alias("t"))
    return terms.select("path", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("different"))


INDEX_TERMS = f"""WITH {_BODIES}, s AS (SELECT path, unnest({_split('symbol')}) AS term FROM (SELECT DISTINCT path, symbol FROM nodes WHERE path IS NOT NULL AND symbol IS NOT NULL)),
i AS (SELECT row_number() OVER () AS r, path, body FROM b),
t AS (
  SELECT r, unnest({_split('path')} || {_split('path')} || {_unicode('body')}) AS term FROM i
  UNION ALL SELECT r, term FROM i JOIN s USING (path)
  UNION ALL SELECT r, unnest({_split('name')}) FROM (SELECT r, unnest({_CAMEL.format('body')}) AS name FROM i)
)
SELECT path, coalesce(n, 0)::INTEGER AS terms, coalesce(u, 0)::INTEGER AS different FROM i LEFT JOIN (SELECT r, count(*) AS n, count(DISTINCT term) AS u FROM t GROUP BY r) USING (r)"""


def lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    """What a tenant finds under each path: own memory, shared memory, a live document, a file, a parked text."""
    rows = _rows(spark, d)
    mem, direct = rows.filter(F.col("kind").isin(*memory.MEM_KINDS)), rows.filter("kind = 'doc'")
    shared = _t(spark, d, "mem_text").select("path", F.col("path").alias("id"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("session"), "text")
    mem = mem.select(*shared.columns).unionByName(shared)
    kept = _bodies(spark, d).select(F.col("path").alias("id"), F.col("body").alias("text"))
    ids = mem.select("id").union(direct.select("id")).union(kept.select("id"))
    found = memory.lookup(ids, mem, direct, kept, kept.limit(0), fence_of(TENANT, now=NOW))
    return found.select("id", "tier", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


LOOKUP = f"""WITH {_ROWS}, {_BODIES}, c AS (
  SELECT id, CASE WHEN owner IS NOT NULL THEN 0 ELSE 1 END AS p, text FROM rows WHERE kind IN ('fact', 'episode') AND {_OWN}
  UNION ALL SELECT path, 1, text FROM mem_text
  UNION ALL SELECT id, 2, text FROM rows WHERE kind = 'doc' AND {_OWN} AND {_LIVE}
  UNION ALL SELECT path, 3, body FROM b
), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, text NULLS FIRST) AS n FROM c WHERE id IS NOT NULL)
SELECT id, ['own memory', 'shared memory', 'document', 'file'][p + 1] AS tier, md5(coalesce(text, '')) AS digest FROM r WHERE n = 1"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Hits once per (query, path), with their position by score; the nearest by cosine is the target of a query."""
    hits = _t(spark, d, "hits").filter("query_id IS NOT NULL AND path IS NOT NULL").groupBy("query_id", "path").agg(F.max(F.struct("hit_id", "score", "cosine")).alias("r"))
    return hits.select("query_id", "path", "r.score", "r.cosine")


_TARGETS = """h AS (SELECT query_id, path, score, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY hit_id DESC, score DESC NULLS LAST, cosine DESC NULLS LAST) AS n FROM hits WHERE query_id IS NOT NULL AND path IS NOT NULL) WHERE n = 1),
t AS (SELECT query_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, path) AS n FROM h WHERE cosine IS NOT NULL) WHERE n = 1),
g AS (SELECT t.query_id, CASE WHEN max(h.score) FILTER (h.path = t.path) IS NOT NULL THEN 1 + count(*) FILTER (h.score > ts.score) END AS rank
  FROM t JOIN h USING (query_id) JOIN h ts ON ts.query_id = t.query_id AND ts.path = t.path GROUP BY t.query_id)"""


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank and precision of the score, if the nearest by cosine is what was sought."""
    hits = _targets(spark, d)
    aim = hits.filter("cosine IS NOT NULL").groupBy("query_id").agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("cosine"), "path")).alias("a"))
    both = hits.join(aim, "query_id").groupBy("query_id").agg(F.count(F.when(F.col("score") > F.col("a.score"), 1)).alias("above"), F.first("a.score").alias("own"))
    ranked = both.select("query_id", F.when(F.col("own").isNotNull(), F.col("above") + 1).alias("rank"))
    return rank.retrieval_quality(ranked).select(*[F.round(c, 9).alias(c) for c in ("mrr", "p_at_1", "p_at_3", "p_at_5")])


QUALITY = f"WITH {_TARGETS} SELECT round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 9) AS p_at_{k}" for k in (1, 3, 5)) + " FROM g"


def score_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the score tells hits with a positive cosine from others, as the area under the curve."""
    rows = _targets(spark, d).filter("score IS NOT NULL AND cosine IS NOT NULL")
    return rank.auc(rows.withColumn("good", F.col("cosine") > 0.5), "score", "good").select(F.round("auc", 9).alias("auc"))


AUC = f"""WITH {_TARGETS}, x AS (SELECT score, cosine > 0.5 AS good FROM h WHERE score IS NOT NULL AND cosine IS NOT NULL),
r AS (SELECT good, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT round((sum(r) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0::DOUBLE) / (count(*) FILTER (good) * count(*) FILTER (NOT good))::DOUBLE, 9) AS auc FROM r"""


def trace_chain(spark: SparkSession, d: str) -> DataFrame:
    """The log of each kind as a chain of calls."""
    log = _t(spark, d, "recall_log").select(F.col("kind").alias("session"), F.col("id").alias("seq"), F.col("path").alias("id")).distinct()
    return memory.trace_edges(log)


TRACE = "SELECT *, lag(id) OVER (PARTITION BY session ORDER BY seq) AS prev FROM (SELECT DISTINCT kind AS session, id AS seq, path AS id FROM recall_log)"


def line_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of direct documents laid on pages of 40 lines, blank ones as gaps, put together to paragraphs again."""
    docs = _t(spark, d, "docs").filter("source = 'direct' AND body IS NOT NULL").groupBy("path").agg(F.max("body").alias("body"))
    lines = docs.select(F.col("path").alias("doc_id"), F.posexplode(F.split("body", "\n", -1)).alias("nth", "text")).filter(F.trim(F.translate("text", "\r\t", "  ")) != "")
    items = lines.select("doc_id", F.floor(F.col("nth") / 40).cast("int").alias("page"), (F.col("nth") % 40 * 12.0).alias("y"), "nth", "text")
    return files.lines_to_paragraphs(items).select("doc_id", "paragraph", F.md5("text").alias("digest"))


PARAGRAPHS = r"""WITH b AS (SELECT path, max(body) AS body FROM docs WHERE source = 'direct' AND body IS NOT NULL GROUP BY path),
l AS (SELECT path AS doc_id, unnest(range(len(string_split(body, chr(10))))) AS nth, unnest(string_split(body, chr(10))) AS text FROM b),
i AS (SELECT *, nth // 40 AS page, nth % 40 * 12.0::DOUBLE AS y FROM l WHERE trim(translate(text, chr(13) || chr(9), '  ')) <> ''),
g AS (SELECT *, abs(lag(y) OVER (PARTITION BY doc_id, page ORDER BY nth) - y) AS gap FROM i),
m AS (SELECT doc_id, page, list_sort(list(gap) FILTER (gap > 0)) AS gaps FROM g GROUP BY doc_id, page),
n AS (SELECT g.*, CASE WHEN gap IS NULL OR gap > 1.5 * gaps[len(gaps) // 2 + 1] THEN 1 ELSE 0 END AS begins FROM g JOIN m USING (doc_id, page)),
p AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY page, nth) - 1 AS paragraph FROM n)
SELECT doc_id, paragraph::BIGINT AS paragraph, md5(string_agg(text, ' ' ORDER BY page, nth)) AS digest FROM p GROUP BY doc_id, paragraph"""


def inline_bodies(spark: SparkSession, d: str) -> DataFrame:
    """What a hit brings along: its chunk if the file is as it was indexed or gone, nothing if it has drifted."""
    last = lambda t, at: _t(spark, d, t).filter("path IS NOT NULL AND content_hash IS NOT NULL").groupBy("path").agg(F.max(F.struct(at, F.lower("content_hash").alias("hash"))).alias("r")).select("path", "r.hash")
    docs = _bodies(spark, d).groupBy("path").agg(F.max("body").alias("body"))
    hits = docs.select("path")
    chunks = _t(spark, d, "nodes").filter("path IS NOT NULL AND body IS NOT NULL").groupBy("path").agg(F.min_by("body", F.struct("id", "body")).alias("chunk_body"))
    memory_ = _t(spark, d, "mem_text").groupBy("path").agg(F.max("text").alias("text"))
    present = last("file_scan", "scanned_at").join(docs, "path", "left")
    out = rank.inline_bodies(hits, chunks, present, last("file_index", "indexed_at"), memory_)
    return out.select("path", F.md5("body").alias("digest"))


INLINE = f"""WITH {_BODIES}, d AS (SELECT path, max(body) AS body FROM b GROUP BY path),
s AS (SELECT path, hash FROM (SELECT path, lower(content_hash) AS hash, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, lower(content_hash) DESC) AS n FROM file_scan WHERE path IS NOT NULL AND content_hash IS NOT NULL) WHERE n = 1),
f AS (SELECT path, hash FROM (SELECT path, lower(content_hash) AS hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, lower(content_hash) DESC) AS n FROM file_index WHERE path IS NOT NULL AND content_hash IS NOT NULL) WHERE n = 1),
c AS (SELECT path, body AS chunk FROM (SELECT path, body, row_number() OVER (PARTITION BY path ORDER BY id, body) AS n FROM nodes WHERE path IS NOT NULL AND body IS NOT NULL) WHERE n = 1),
m AS (SELECT path, max(text) AS text FROM mem_text GROUP BY path)
SELECT d.path, md5(CASE WHEN m.text IS NOT NULL THEN m.text WHEN c.chunk IS NULL THEN CASE WHEN s.path IS NOT NULL THEN d.body END WHEN s.hash IS NULL OR s.hash = f.hash THEN c.chunk END) AS digest
FROM d LEFT JOIN s USING (path) LEFT JOIN f USING (path) LEFT JOIN c USING (path) LEFT JOIN m USING (path)"""


def scalar_signals(spark: SparkSession, d: str) -> DataFrame:
    """Age, decay and context boost of every path of the log."""
    used = memory.demand(_t(spark, d, "recall_log")).groupBy("path").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    age = F.lit(NOW) - F.col("last")
    query = F.array(F.lit("fact"), F.lit("style"), F.lit("src"))
    return used.select(
        "path", T.relative_age(age).alias("age"), F.round(T.activation_decay(F.col("n"), age / memory.DAY), 9).alias("decay"), F.round(T.context_boost(query, T.split_ident(F.col("path"))), 9).alias("boost"),
    )


SIGNALS = f"""WITH lg AS (SELECT DISTINCT id, path, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END AS ts FROM recall_log),
u AS (SELECT path, {NOW} - max(ts) AS age, count(*) AS n FROM lg GROUP BY path), m AS (SELECT *, age // 60000 AS minutes, {_split('path')} AS parts FROM u)
SELECT path, CASE WHEN minutes < 60 THEN minutes || 'm' WHEN minutes < 1440 THEN (minutes // 60) || 'h' ELSE (minutes // 1440) || 'd' END AS age,
  round((0.4 + 0.1 * log10(n + 1)) * log10(greatest(age / {memory.DAY}, 1)), 9) AS decay,
  round(len(list_filter(['fact', 'style', 'src'], lambda x: list_contains(parts, x))) / 3.0::DOUBLE * 0.5, 9) AS boost FROM m"""


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """JavaScript imports of one line each, resolved: the specifiers are those of the text, aliases are not known."""
    code = _bodies(spark, d).filter(F.col("path").rlike(r"\.(ts|js)$"))
    said = code.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"import \{[^}\n]*\} from '([^'\n]+)'"), F.lit(1))).alias("specifier"))
    return graph.resolve_imports(materialize(said.distinct(), "said"), _t(spark, d, "docs").select("path")).select("src_path", "dst_path")


IMPORT_EDGES = f"""WITH {_BODIES}, k AS (SELECT DISTINCT path FROM docs WHERE path IS NOT NULL),
s AS (SELECT DISTINCT path AS src, unnest(regexp_extract_all(body, 'import \\{{[^}}\\n]*\\}} from ''([^''\\n]+)''', 1)) AS spec FROM b WHERE regexp_matches(path, '\\.(ts|js)$')),
p AS (SELECT src, spec, regexp_replace(src, '/?[^/]*$', '') AS dir FROM s WHERE starts_with(spec, './')),
e AS (SELECT src, spec, dir || '/' || substr(spec, 3) AS base FROM p),
y AS (SELECT src, spec, base, unnest(range(20)) AS nth, unnest([base || x for x in {list(graph.JS_FILE + graph.JS_INDEX)}] || [regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', '') || x for x in {list(graph.JS_FILE[1:])}]) AS path FROM e),
f AS (SELECT src, spec, path, row_number() OVER (PARTITION BY src, spec ORDER BY nth) AS n FROM y JOIN k USING (path))
SELECT DISTINCT src AS src_path, path AS dst_path FROM f WHERE n = 1 AND src <> path"""



def word_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every line that names a class, and how often."""
    classes = _t(spark, d, "nodes").filter("symbol IS NOT NULL AND node_type IN ('class_declaration', 'class_definition')")
    return graph.mentions(_t(spark, d, "docs"), classes).withColumn("line", F.col("line").cast("long"))


MATCHES = r"""WITH b AS (SELECT DISTINCT path, body FROM docs WHERE path IS NOT NULL AND body IS NOT NULL),
l AS (SELECT path, unnest(range(len(string_split(body, chr(10))))) AS line, unnest(string_split(body, chr(10))) AS text FROM b),
w AS (SELECT path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS symbol FROM l)
SELECT symbol, path, line, count(*) AS n FROM w WHERE symbol IN (SELECT symbol FROM nodes WHERE symbol IS NOT NULL AND node_type IN ('class_declaration', 'class_definition')) GROUP BY ALL"""

QUERIES = {
    unicode_terms: UNICODE_TERMS, camel_terms: CAMEL_TERMS, index_terms: INDEX_TERMS, lookup_tiers: LOOKUP, retrieval_quality: QUALITY, score_auc: AUC, trace_chain: TRACE, line_paragraphs: PARAGRAPHS,
    inline_bodies: INLINE, scalar_signals: SIGNALS, import_edges: IMPORT_EDGES, word_matches: MATCHES,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: s for f, s in QUERIES.items()}
