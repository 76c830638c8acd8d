"""Queries pN_... of the operators in this subpackage, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import fusion, handwritten, neighbours, packing, splitting, subjects, tokens


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_read(spark, d, "file_embeddings"))


P1_SQL = """
WITH u AS (
  SELECT path, min(dim) AS dim, min(vec::DOUBLE[]) AS v FROM file_embeddings
  WHERE path IS NOT NULL AND len(vec) = dim
    AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
  GROUP BY path
), s AS (
  SELECT a.path AS p, b.path AS q, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.dim = b.dim AND a.path <> b.path
), r AS (SELECT p, q, c, row_number() OVER (PARTITION BY p ORDER BY c DESC, q) AS n FROM s WHERE c >= 0.88)
SELECT DISTINCT least(p, q) AS path_a, greatest(p, q) AS path_b FROM r WHERE n <= 10
"""


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces_of(_read(spark, d, "nodes"), _read(spark, d, "docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("pieces > 1").select("path", "node_id").distinct()


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each item put together again from its pieces without their overlaps, and whether every piece keeps the rules."""
    overlap = splitting.OVERLAP
    own = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substring("text", F.lit(overlap + 1), F.length("text")))
    before = Window.partitionBy("path", "node_id", "start_line", "end_line").orderBy("piece")
    kept = (F.length("text") == F.col("end") - F.col("start")) & (F.length("text") <= splitting.LIMIT)
    joined = (F.col("piece") == 0) & (F.col("start") == 0) | (F.col("start") == F.lag("end").over(before) - overlap)
    rows = p3_pieces(spark, d).select("path", "node_id", "start_line", "end_line", "piece", "pieces", "end", own.alias("own"), (kept & joined).alias("ok"))
    whole = rows.groupBy("path", "node_id", "start_line", "end_line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "").alias("text"),
        (F.min("ok") & (F.count("*") == F.max("pieces"))).alias("kept"),
    )  # one item a group
    return whole.select("path", "node_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "kept").distinct()


P3_SQL = r"""
WITH b AS (SELECT path, max(body) AS body FROM docs WHERE path IS NOT NULL AND body IS NOT NULL GROUP BY path),
l AS (SELECT path, list_transform(string_split(body, chr(10)), lambda x: CASE WHEN right(x, 1) = chr(13) THEN left(x, length(x) - 1) ELSE x END) AS lines FROM b),
t AS (
  SELECT n.path, n.id AS node_id, array_to_string(l.lines[greatest(n.start_line, 0) + 1 : n.end_line + 1], chr(10)) AS text
  FROM nodes n JOIN l USING (path) WHERE n.start_line <= n.end_line AND n.end_line >= 0
  UNION ALL
  SELECT path, CAST(-1 AS BIGINT), array_to_string(lines, chr(10)) FROM l WHERE path NOT IN (SELECT path FROM nodes WHERE path IS NOT NULL)
)
SELECT DISTINCT path, node_id FROM t WHERE length(text) > 4000
"""
P3_REJOINED_SQL = P3_SQL.replace("SELECT DISTINCT path, node_id FROM t", "SELECT DISTINCT path, node_id, length(text) AS chars, md5(text) AS digest, true AS kept FROM t")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.agreed(_read(spark, d, "hits"))


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    """The whole fused ranking of every query."""
    out = fusion.fuse(_read(spark, d, "hits"))
    return out.withColumn("fused", F.round("fused", 9)).drop("score", "cosine")


def p4_order(spark: SparkSession, d: str) -> DataFrame:
    """Every path of a query at its place in the one order."""
    return fusion.ranking(_read(spark, d, "hits"))


_P4_ONE = """
WITH one AS (
  SELECT query_id, path, score, cosine FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY hit_id DESC NULLS LAST, score DESC NULLS LAST, cosine DESC NULLS LAST) AS n FROM hits
  ) WHERE n = 1
), pos AS (
  SELECT query_id, path,
    CASE WHEN score IS NOT NULL THEN CAST(rank() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST) AS INTEGER) END AS pos_score,
    CASE WHEN cosine IS NOT NULL THEN CAST(rank() OVER (PARTITION BY query_id ORDER BY cosine DESC NULLS LAST) AS INTEGER) END AS pos_cosine
  FROM one
)
"""
P4_SQL = _P4_ONE + "SELECT query_id, path FROM pos WHERE pos_score <= 3 AND pos_cosine <= 3"
P4_FUSED_SQL = _P4_ONE + """
, f AS (SELECT *, coalesce(1.0::DOUBLE / (60.0::DOUBLE + pos_score), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + pos_cosine), 0.0::DOUBLE) AS fused FROM pos)
SELECT query_id, path, pos_score, pos_cosine, round(fused, 9) AS fused, CAST(rank() OVER (PARTITION BY query_id ORDER BY fused DESC) AS INTEGER) AS position FROM f
"""
P4_ORDER_SQL = _P4_ONE + """
, f AS (SELECT *, coalesce(1.0::DOUBLE / (60.0::DOUBLE + pos_score), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + pos_cosine), 0.0::DOUBLE) AS fused FROM pos)
SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, path NULLS FIRST) AS place FROM f
"""


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """The margin of every path by each kind."""
    return handwritten.score_files(_read(spark, d, "file_index"), _read(spark, d, "docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_scores(spark, d).filter("kind IS NOT NULL").select("path")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_read(spark, d, "documents"))


CONTAINER = 2048


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return packing.fill_containers(tokens.token_counts(_read(spark, d, "documents")), CONTAINER)


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """One row on the containers: documents placed, documents split though they fit, containers beyond their capacity,
    gaps in their numbers, and whether they take at most a hundredth and one container more than the texts need."""
    rows = materialize(p7_containers(spark, d), "containers")
    fill = rows.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("size").alias("fill"))
    total = fill.agg(
        F.count(F.when(F.col("fill") > CONTAINER, 1)).alias("overfull"), (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count("*")).alias("gaps"),
        (F.count("*") <= F.coalesce(F.sum("fill"), F.lit(0)) / CONTAINER * 1.01 + 1).alias("tight"),
    )
    size = rows.groupBy("doc_id").agg(F.sum("size").alias("size"), F.max("pieces").alias("pieces"), F.count("*").alias("n"))
    docs = size.agg(F.count("*").alias("documents"), F.count(F.when((F.col("n") != F.col("pieces")) | (F.col("pieces") > F.greatest(F.ceil(F.col("size") / CONTAINER), F.lit(1))), 1)).alias("broken"))
    return docs.crossJoin(total)  # one row each


P7_FILLED_SQL = "SELECT count(*) AS documents, 0::BIGINT AS broken, 0::BIGINT AS overfull, 0::BIGINT AS gaps, true AS tight FROM documents"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).filter("pieces > 1").select("doc_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), _read(spark, d, "subjects"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p3_found, p3_pieces, p3_rejoined, p4_found, p4_fused, p4_order, p5_found, p6_ids, p7_found, p7_containers, p7_filled, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p3_rejoined": P3_REJOINED_SQL, "p4_found": P4_SQL, "p4_fused": P4_FUSED_SQL, "p4_order": P4_ORDER_SQL, "p7_filled": P7_FILLED_SQL}
