"""Query p2: which paths the next index run has to process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import paths_to_process
from ..session import fresh_dir


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("file_index", "index_runs", "file_scan")}
    return paths_to_process(t["file_index"], t["index_runs"], t["file_scan"], fresh_dir(spark, "file-state"))


P2_SQL = """
WITH h AS (
  SELECT f.path, regexp_extract(lower(f.content_hash), '([0-9a-f]{64})', 1) AS hash,
    row_number() OVER (PARTITION BY f.path ORDER BY f.indexed_at DESC, lower(f.content_hash) DESC) AS n
  FROM file_index f WHERE EXISTS (SELECT 1 FROM index_runs r WHERE r.status = 'ok' AND f.indexed_at BETWEEN r.started_at AND r.finished_at)
), s AS (
  SELECT path, regexp_extract(lower(content_hash), '([0-9a-f]{64})', 1) AS hash,
    row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, lower(content_hash) DESC) AS n
  FROM file_scan WHERE content_hash IS NOT NULL
)
SELECT s.path FROM s LEFT JOIN h ON s.path = h.path AND h.n = 1 WHERE s.n = 1 AND s.hash IS DISTINCT FROM h.hash
"""


def queries() -> dict:
    return {"p2_found": p2_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
