"""Structured Streaming forms of the append-only logs, of expiry and of incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def timed(log: DataFrame, late: str = LATE) -> DataFrame:
    """The access log with a timestamp column at and its watermark; actions in lower case, seconds read as such.

    The other operators here take such a log: a stream has one watermark, however many of them follow."""
    ms = F.when(F.col("ts") < 100_000_000_000, F.col("ts") * 1000).otherwise(F.col("ts"))
    return log.withColumn("at", F.timestamp_millis(ms)).withColumn("action", F.lower(F.coalesce("action", F.lit("recall")))).withWatermark("at", late)


def deduplicated(log: DataFrame) -> DataFrame:
    """One row per id within the watermark."""
    return log.dropDuplicatesWithinWatermark(["id"])


def demand_windows(log: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window, path, recalls) in tumbling or sliding windows of event time."""
    span = F.window("at", width, slide) if slide else F.window("at", width)
    return log.filter("action = 'recall'").groupBy(span.alias("window"), "path").agg(F.count("*").alias("recalls"))


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(window, kind, n): bursts of activity of a kind."""
    return log.groupBy(F.session_window("at", gap).alias("window"), "kind").agg(F.count("*").alias("n"))


def threshold_crossings(log: DataFrame, threshold: int, ttl_ms: int | None = None) -> DataFrame:
    """(path, recalls): a row at the moment a path's recalls reach the threshold, once; a path that stays
    silent for ttl_ms is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        now = before + sum(int((f["action"] == "recall").sum()) for f in frames)
        state.update((now,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if before < threshold <= now:
            yield pd.DataFrame({"path": [key[0]], "recalls": [now]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return log.select("path", "action").groupBy("path").applyInPandasWithState(step, "path string, recalls long", "n long", "append", timeout)


def gathered(stream: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """What a stream of aggregates has come to when everything that has arrived is read, open windows included.

    Each micro-batch writes the groups it changed (mode update) or all of them (complete, for what can't be updated)
    under its number, so a repeated batch replaces its own rows; of each group the row of the last batch counts.
    """
    spark, rest = stream.sparkSession, [c for c in stream.columns if c not in keys]

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "long")
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
        return rows.drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def into(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Apply work to every micro-batch of what has arrived, then stop; work must be idempotent per batch id."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(files: DataFrame, checkpoint: str, upsert: Callable[[DataFrame], None]):
    """Incremental indexing: new files of a binaryFile stream are hashed and handed to upsert."""

    def batch(df: DataFrame, _: int) -> None:
        upsert(df.select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("hash"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")))

    return into(files, checkpoint, batch)
