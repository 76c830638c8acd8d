"""Registered queries over source code, snapshots of files, uploads and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from ..operators import folds, graph, memory
from ..operators.incremental import indexed_state, present_content
from ..session import fresh_dir, materialize
from ..sources import files
from ..streaming import logs


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "docs").filter("kind = 'code' AND path IS NOT NULL").groupBy("path").agg(F.max(F.struct("format", "body")).alias("r")).select("path", "r.format", "r.body")


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return parse.chunk_files(_code(spark, d)).select("path", "nth", "symbol", "node_type", "start_line", "end_line", "complexity")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return parse.call_sites(_code(spark, d))


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return parse.import_specifiers(_code(spark, d))


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    docs = _code(spark, d)
    return graph.resolve_imports(parse.import_specifiers(docs), docs.select("path"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of the index as their signatures, with what that saves."""
    n = _t(spark, d, "nodes").filter("symbol IS NOT NULL AND body IS NOT NULL AND format IN ('py', 'js', 'ts')").dropDuplicates(["id"])
    sig = parse.signature_column(F.struct(F.col("body").alias("content"), "format", "symbol"))
    return n.select("id", "body", sig.alias("signature")).select("id", "signature", (F.length("body") - F.length("signature")).alias("saved"))


def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a change of each defined symbol would touch, callers under re-exported names included."""
    docs = materialize(_code(spark, d), "code")
    chunks = materialize(parse.chunk_files(docs).withColumn("id", F.xxhash64("path", "nth")), "chunks")
    calls = materialize(parse.call_sites(docs), "calls")
    placed = lambda df: df.join(graph.resolve_targets(df.select("path", "specifier"), docs.select("path")), ["path", "specifier"])
    barrels = placed(parse.reexports(docs)).select(F.col("path").alias("barrel"), "symbol", "alias")
    bindings = placed(parse.import_bindings(docs)).select("path", F.col("target").alias("barrel"), "alias", "local")
    out = graph.impact(chunks, docs, calls, chunks.select("id", "complexity"), alias_calls=graph.alias_callers(barrels, bindings, calls))
    return out.select("symbol", "defs", "mentions", "confirmed", "ref_count", "risk", "complexity", F.array_join("callees", " ").alias("callees"), F.array_join("hedges", "; ").alias("hedges"))


def classify_paths(spark: SparkSession, d: str) -> DataFrame:
    c = T.classify_path(F.col("path"))
    return _t(spark, d, "file_index").select("path").distinct().select("path", c.alias("c")).select("path", "c.kind", "c.format")


CLASSIFY = """SELECT path, CASE WHEN f = 'md' THEN 'doc' ELSE 'code' END AS kind, f AS format FROM (
  SELECT DISTINCT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'ts' WHEN 'js' THEN 'js' WHEN 'mjs' THEN 'js' WHEN 'cjs' THEN 'js' WHEN 'jsx' THEN 'js' WHEN 'py' THEN 'py' WHEN 'md' THEN 'md' END AS f FROM file_index)"""


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The status of each path of the listing and of the index; files of equal time and size aren't hashed."""
    stored = indexed_state(_t(spark, d, "file_index"), _t(spark, d, "index_runs"))
    last = _t(spark, d, "file_index").groupBy("path").agg(F.max(F.struct("indexed_at", "mtime", "size")).alias("m")).select("path", "m.mtime", "m.size")
    scan = _t(spark, d, "file_scan").filter("content_hash IS NOT NULL")
    seen = scan.groupBy("path").agg(F.max(F.struct("scanned_at", "mtime", "size")).alias("m")).select("path", "m.mtime", "m.size")
    return files.snapshot_diff(seen.join(present_content(scan), "path"), last.join(stored, "path", "left"))


SNAPSHOT = """WITH h AS (SELECT path, regexp_extract(lower(content_hash), '([0-9a-f]{64})', 1) AS hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, lower(content_hash) DESC) AS n
  FROM file_index f WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.status = 'ok' AND f.indexed_at BETWEEN r.started_at AND r.finished_at)),
l AS (SELECT path, mtime, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, mtime DESC, size DESC) AS n FROM file_index) WHERE n = 1),
s AS (SELECT path, mtime, size, regexp_extract(lower(content_hash), '([0-9a-f]{64})', 1) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, mtime DESC, size DESC) AS n FROM file_scan WHERE content_hash IS NOT NULL) WHERE n = 1)
SELECT coalesce(s.path, l.path) AS path, CASE WHEN s.path IS NULL THEN 'deleted' WHEN s.mtime = l.mtime AND s.size = l.size THEN 'unchanged' WHEN s.hash = h.hash THEN 'touch' ELSE 'upsert' END AS status
FROM s FULL JOIN l ON s.path = l.path LEFT JOIN h ON h.path = s.path AND h.n = 1"""


def edited_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that parsing finds and the index doesn't hold, of files that it knows."""
    new = parse.chunk_files(_code(spark, d)).withColumn("kind", F.lit("code"))
    return files.edited_chunks(new, _t(spark, d, "nodes"))


def git_activity(spark: SparkSession, d: str) -> DataFrame:
    """Index runs as commits: how often a path was written and when last."""
    log = _t(spark, d, "file_index").select("path", F.col("indexed_at").cast("string").alias("commit"), F.floor(F.col("indexed_at") / 1000).alias("ts"))
    return files.git_activity(log)


GIT = "SELECT path, count(DISTINCT indexed_at) AS commits, max(indexed_at // 1000) AS last_commit FROM file_index GROUP BY path"


def stale_stamps(spark: SparkSession, d: str) -> DataFrame:
    common = _t(spark, d, "nodes").groupBy("stamp").count().orderBy(F.desc("count"), "stamp").first()
    return files.stale_stamps(_t(spark, d, "nodes"), common["stamp"] if common else 0)


STALE = "SELECT DISTINCT path FROM nodes WHERE stamp IS DISTINCT FROM (SELECT stamp FROM nodes GROUP BY stamp ORDER BY count(*) DESC, stamp LIMIT 1)"


def ingest_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Directly written documents as uploads, cut into segments."""
    up = _t(spark, d, "docs").filter("source = 'direct'").groupBy("path").agg(F.max(F.struct("format", "body")).alias("r"))
    named = up.select(F.concat(F.substring("path", 5, 10_000), F.lit("."), F.coalesce("r.format", F.lit("bin"))).alias("name"), F.encode(F.coalesce("r.body", F.lit("")), "UTF-8").alias("content"))
    return files.ingest(named).select("name", "id", "format", F.length("text").alias("chars"), F.octet_length("bytes").alias("bytes"), "error")


def assemble_rescued(spark: SparkSession, d: str) -> DataFrame:
    """Files of a repository as a transcript: what doesn't fit comes back as signatures."""
    n = _t(spark, d, "nodes").filter("symbol IS NOT NULL AND body IS NOT NULL AND format IN ('py', 'js', 'ts')").dropDuplicates(["id"])
    none = lambda t: F.lit(None).cast(t)
    units = n.select(
        F.concat_ws("|", F.substring_index("path", "/", 1), F.floor(F.col("id") / 200).cast("string")).alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("id"), F.lit("tool").alias("role"), F.col("body").alias("content"),
        "kind", "format", "symbol", none("boolean").alias("pinned"), none("string").alias("atomic"), none("double").alias("tokensApprox"),
    )
    return folds.assemble(units, 4000, parse.signature_column).select("conv_id", "turn", "kept", "compressed", "tokens")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/recall_log.parquet"
    return logs.timed(spark.readStream.schema(_t(spark, d, "recall_log").schema).option("recursiveFileLookup", "true").parquet(path))


def streaming_demand(spark: SparkSession, d: str) -> DataFrame:
    """Recalls by day and path of the log as a stream, days that are still open included."""
    rows = logs.demand_windows(logs.deduplicated(_stream(spark, d)), "1 day")
    day = F.unix_millis("window.start").alias("day")
    return logs.gathered(rows.select(day, "path", "recalls"), fresh_dir(spark, "stream"), ["day", "path"])


_LOG = """lg AS (SELECT id, path, kind, lower(coalesce(action, 'recall')) AS action, CASE WHEN ts < 100000000000 THEN ts * 1000 ELSE ts END AS ts FROM (SELECT DISTINCT * FROM recall_log))"""
STREAM_DEMAND = f"WITH {_LOG} SELECT ts // 86400000 * 86400000 AS day, path, count(*) AS recalls FROM lg WHERE action = 'recall' GROUP BY ALL"


def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of activity of each kind, rows delivered twice counted once, the last bursts included."""
    rows = logs.sessions(logs.deduplicated(_stream(spark, d)))
    ends = [F.unix_millis(f"window.{c}").alias(c) for c in ("start", "end")]
    return logs.gathered(rows.select(*ends, "kind", "n"), fresh_dir(spark, "stream"), ["kind", "start"], "complete")


SESSIONS = f"""WITH {_LOG}, o AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + 1800000 THEN 1 ELSE 0 END AS begins FROM lg WINDOW w AS (PARTITION BY kind ORDER BY ts, id)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY kind ORDER BY ts, id) AS session FROM o)
SELECT min(ts) AS "start", max(ts) + 1800000 AS "end", kind, count(*) AS n FROM s GROUP BY kind, session"""


def demand_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Demand by kind and action as a cube, with the number of different paths."""
    log = memory.demand(_t(spark, d, "recall_log"))
    return log.cube("kind", "action").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


CUBE = """WITH lg AS (SELECT id, path, kind, lower(coalesce(action, 'recall')) AS action FROM (SELECT DISTINCT * FROM recall_log))
SELECT kind, action, count(*) AS n, count(DISTINCT path) AS paths FROM lg GROUP BY CUBE (kind, action)"""

QUERIES = {
    code_chunks: None, code_calls: None, code_imports: None, resolved_imports: None, signatures: None, change_impact: None, classify_paths: CLASSIFY, snapshot_diff: SNAPSHOT, edited_chunks: None,
    git_activity: GIT, stale_stamps: STALE, ingest_uploads: None, assemble_rescued: None, streaming_demand: STREAM_DEMAND, streaming_sessions: SESSIONS, demand_thresholds: CUBE,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: s for f, s in QUERIES.items() if s}
