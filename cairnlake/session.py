"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (tests, bench)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("cairnlake")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Only where that setting is missing (tests, a laptop) is a temporary folder made, once a session.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(sc, "_cairnlake_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
        sc._cairnlake_dir = made
        sc.setCheckpointDir(made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; release() deletes it."""
    path = f"{shared_dir(spark)}/cairnlake/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders handed out by this process, by application.
_made: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete what fresh_dir() has handed out; call it when results are written, as DataFrames read these tables.
    Returns the number of folders."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a compressed table to the shared folder and read it again.

    The result no longer depends on the plan of df, survives the loss of an executor and is the same at
    every later read.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
