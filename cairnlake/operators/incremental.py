"""Versioned tables and the processing of only what is new or changed.

A table is a folder of immutable data files and manifests. The manifest of a version lists its live data
files and its deletion vectors (tables of file and row position). A version exists once its manifest has
been renamed into place, which fails if that version is taken; files of a commit that did not get so far are
never read. The difference of two versions follows from their manifests: rows of added files, rows of
removed files, and rows whose position a new deletion vector names; of the files that stayed only those that
a new vector names are opened. compact() rewrites small files and applies old vectors; it changes no row, and
differences that span it are made of the spans before and after.

A consumer stores the version it has processed in the manifest of its own output, so output and progress
become visible in one step: an interrupted run leaves no trace, a repeated one finds nothing to do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, POS, CHANGE = "_file", "_pos", "_change"
#: The property that lists the versions made by compact().
COMPACTED = "compacted"
#: More run intervals than this are joined by shuffle instead of broadcast.
RUNS_BROADCAST = 100_000


@dataclass(frozen=True)
class Manifest:
    version: int
    files: tuple[str, ...] = ()
    vectors: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)


class VersionConflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema):
        """A table under root with the given columns (StructType or DDL); it begins as version 0, empty."""
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    # --- manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return [0]
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def latest(self) -> int:
        return self.versions()[-1]

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.latest() if version is None else version
        if version == 0:
            return Manifest(0)
        stream = self._fs().open(self._path(f"_versions/{version:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        m = json.loads(text)
        return Manifest(m["version"], tuple(m["files"]), tuple(m["vectors"]), m["properties"])

    def _publish(self, m: Manifest) -> int:
        text = json.dumps({"version": m.version, "files": m.files, "vectors": m.vectors, "properties": m.properties})
        fs = self._fs()
        draft, final = self._path(f"_versions/.draft-{uuid.uuid4().hex}"), self._path(f"_versions/{m.version:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if fs.getScheme() in self.root else fs.getUri()).rename(
                fs.makeQualified(draft), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise VersionConflict(f"version {m.version} of {self.root} exists") from e
            raise
        return m.version

    def _store(self, df: DataFrame, kind: str) -> list[str]:
        """Write df below the table and give the names of its files, relative to the table."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return [f"{folder}/{s.getPath().getName()}" for s in self._fs().listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet") and s.getLen() > 0]

    # --- reading

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema).withColumn(FILE, F.lit("")).withColumn(POS, F.lit(0).cast("long"))

    def _rows(self, files) -> DataFrame:
        """All rows of the files with their file (relative) and position, deleted ones too."""
        if not files:
            return self._empty()
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in files])
        tail = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+/[^/]+)$", 1)
        return df.select(*self.schema.names, tail.alias(FILE), F.col("_metadata.row_index").alias(POS))

    def _deleted(self, vectors) -> DataFrame | None:
        return self.spark.read.schema(f"{FILE} string, {POS} long").parquet(*[f"{self.root}/{v}" for v in vectors]) if vectors else None

    def _live(self, files, vectors) -> DataFrame:
        rows, gone = self._rows(files), self._deleted(vectors)
        return rows if gone is None else rows.join(gone, [FILE, POS], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._live(m.files, m.vectors).select(*self.schema.names)

    # --- writing

    def append(self, df: DataFrame, properties: dict | None = None, base: int | None = None) -> int:
        """Commit the rows of df on top of version base (the latest); returns the new version."""
        m = self.manifest(base)
        added = self._store(df.select(*self.schema.names), "data")
        return self._publish(Manifest(m.version + 1, (*m.files, *added), m.vectors, m.properties | (properties or {})))

    def replace(self, df: DataFrame, properties: dict | None = None, base: int | None = None) -> int:
        """Commit df as the whole content: all files are removed and new ones added."""
        m = self.manifest(base)
        added = self._store(df.select(*self.schema.names), "data")
        return self._publish(Manifest(m.version + 1, tuple(added), (), m.properties | (properties or {})))

    def merge(self, snapshot: DataFrame, keys: list[str], same: Callable[[Callable, Callable], Column], properties: dict | None = None, base: int | None = None) -> int:
        """Commit the change from the live rows to the rows of a snapshot with one row per key.

        same(old, new) states, given two functions from column name to column, whether a row is unchanged.
        Unchanged rows stay in their files. Rows that changed or are not in the snapshot get into a deletion
        vector; changed and new ones into new files. Without any difference no version is made.
        """
        m = self.manifest(base)
        old = self._live(m.files, m.vectors).withColumnsRenamed({c: f"o_{c}" for c in self.schema.names})
        new = snapshot.select(*self.schema.names).withColumn("_in", F.lit(True))
        cond = [old[f"o_{k}"].eqNullSafe(new[k]) for k in keys]
        both = old.join(new, cond, "full_outer")
        kept = F.coalesce(F.col(FILE).isNotNull() & F.col("_in") & same(lambda c: F.col(f"o_{c}"), F.col), F.lit(False))
        diff = both.filter(~kept)
        folder = f"{self.root}/staging/{uuid.uuid4().hex}"  # the join runs once; both halves are cut from its result
        diff.select(*self.schema.names, "_in", FILE, POS).write.option("compression", "zstd").parquet(folder)
        staged = self.spark.read.schema(diff.select(*self.schema.names, "_in", FILE, POS).schema).parquet(folder)
        counts = staged.agg(F.count("_in").alias("fresh"), F.count(FILE).alias("gone")).first()
        added = self._store(staged.filter("_in").select(*self.schema.names), "data") if counts["fresh"] else []
        vectors = self._store(staged.filter(f"{FILE} IS NOT NULL").select(FILE, POS), "deleted") if counts["gone"] else []
        self._fs().delete(self._path(folder[len(self.root) + 1 :]), True)
        if not added and not vectors:
            return m.version
        return self._publish(Manifest(m.version + 1, (*m.files, *added), (*m.vectors, *vectors), m.properties | (properties or {})))

    def rewrite(self, gone: DataFrame, df: DataFrame, keys: list[str], properties: dict | None = None, base: int | None = None) -> int:
        """Commit in one step: live rows whose keys are in gone (with exactly these columns) are deleted, the rows of df added."""
        m = self.manifest(base)
        marked = self._live(m.files, m.vectors).join(gone.select(*keys).distinct(), keys, "left_semi").select(FILE, POS)
        vectors = self._store(marked, "deleted")
        added = self._store(df.select(*self.schema.names), "data")
        return self._publish(Manifest(m.version + 1, (*m.files, *added), (*m.vectors, *vectors), m.properties | (properties or {})))

    # --- differences

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """(_change, columns): rows deleted from version `since` and inserted up to version `until`, step by step over
        each compaction between the two."""
        until = self.latest() if until is None else until
        whole = [v for v in self.manifest(until).properties.get(COMPACTED, []) if since < v <= until]
        out = None
        for a, b in zip([since, *whole], [*(v - 1 for v in whole), until]):
            if a < b or out is None and b == until:
                out = self._difference(a, b) if out is None else out.unionByName(self._difference(a, b))
        return out

    def _difference(self, since: int, until: int) -> DataFrame:
        a, b = self.manifest(since), self.manifest(until)
        came = [f for f in b.files if f not in set(a.files)]
        went = [f for f in a.files if f not in set(b.files)]
        stayed = [f for f in a.files if f in set(b.files)]
        inserted = self._live(came, b.vectors)
        removed = self._live(went, a.vectors)
        fresh = self._deleted([v for v in b.vectors if v not in set(a.vectors)])
        if fresh is not None and stayed:
            named = {r[FILE] for r in fresh.select(FILE).distinct().collect()}  # no more than the manifest has
            touched = [f for f in stayed if f in named]
            if touched:
                removed = removed.unionByName(self._rows(touched).join(fresh, [FILE, POS], "left_semi"))
        mark = lambda df, what: df.select(F.lit(what).alias(CHANGE), *self.schema.names)
        return mark(inserted, "insert").unionByName(mark(removed, "delete"))

    def compact(self, files: int | None = None, base: int | None = None) -> int:
        """Commit the live rows in `files` new files (as many as Spark makes of them) without deletion vectors; no row
        changes. Old files stay for readers of older versions."""
        m = self.manifest(base)
        live = self._live(m.files, m.vectors).select(*self.schema.names)
        added = self._store(live.coalesce(files) if files else live, "data") if m.files else []
        mark = {COMPACTED: [*m.properties.get(COMPACTED, []), m.version + 1]}
        return self._publish(Manifest(m.version + 1, tuple(added), (), m.properties | mark))


def process_new(source: VersionedTable, target: VersionedTable, work: Callable[[DataFrame], DataFrame], name: str = "source") -> int | None:
    """Apply work to what changed in source since target last did, and commit its rows to target.

    Returns the version of source that is now processed, None if there was nothing new. The version goes
    into the manifest that publishes the rows: a run that dies before has processed nothing, and of two
    that run at once the second fails with VersionConflict.
    """
    base = target.latest()
    done = int(target.manifest(base).properties.get(f"processed.{name}", 0))
    upto = source.latest()
    if upto <= done:
        return None
    target.append(work(source.changes(done, upto)), {f"processed.{name}": upto}, base)
    return upto


# --- the state of an index of files


def sha256_of(col: Column) -> Column:
    """The 64 hexadecimal digits in a spelling of a SHA-256, in lower case; null if there are none."""
    found = F.regexp_extract(F.lower(col), "([0-9a-f]{64})", 1)
    return F.when(found != "", found)


def indexed_state(file_index: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, hash): what the last successful run that touched a path has stored of it.

    A row counts if it was written while a run with status ok went on, ends included; rows with null path or
    time and runs without an end don't. Runs are met by time slots as long as the longest run, so that the
    join is one on equality. Of rows of one time the larger hash counts.
    """
    ok = runs.filter("status = 'ok' AND started_at <= finished_at").select("started_at", "finished_at").distinct()
    width = ok.agg(F.max(F.col("finished_at") - F.col("started_at")).alias("w")).first()["w"]
    width = max(int(width or 0), 1)
    slot = lambda c: F.floor(F.col(c) / width)
    slots = ok.withColumn("slot", F.explode(F.sequence(slot("started_at"), slot("finished_at"))))
    few = slots.limit(RUNS_BROADCAST + 1).count() <= RUNS_BROADCAST
    rows = file_index.filter("path IS NOT NULL AND indexed_at IS NOT NULL").select("path", sha256_of(F.col("content_hash")).alias("hash"), "indexed_at").withColumn("slot", slot("indexed_at"))
    within = rows.join(F.broadcast(slots) if few else slots, "slot").filter("indexed_at BETWEEN started_at AND finished_at")
    return within.groupBy("path").agg(F.max(F.struct("indexed_at", "hash")).alias("m")).select("path", "m.hash")


def present_content(scan: DataFrame) -> DataFrame:
    """(path, hash) of the last row of each path in a listing that has a content hash."""
    rows = scan.filter("path IS NOT NULL AND content_hash IS NOT NULL").select("path", sha256_of(F.col("content_hash")).alias("hash"), "scanned_at")
    return rows.groupBy("path").agg(F.max(F.struct("scanned_at", "hash")).alias("m")).select("path", "m.hash")


def paths_to_process(file_index: DataFrame, runs: DataFrame, scan: DataFrame, root: str) -> DataFrame:
    """(path) that the next index run has to process: present content unlike the stored one, or none stored.

    Two tables are kept under root. The first version of `content` is the state that successful runs have stored; each
    listing is merged into it as a further version. process_new() carries what a listing inserted into the table
    `todo`, whose manifest holds the version of content that is processed: a listing that changes nothing adds
    nothing, and a call that died is made up for by the next one. The rows of todo wait there for the index run, which
    takes them by process_new() as well. A path that is only in the state is a deletion in content.
    """
    content = VersionedTable(file_index.sparkSession, f"{root}/content", "path string, hash string")
    todo = VersionedTable(file_index.sparkSession, f"{root}/todo", "path string")
    if content.latest() == 0:
        content.append(indexed_state(file_index, runs))
    if todo.latest() == 0:  # what is stored already is processed
        todo.append(todo.read(0), {"processed.content": 1})
    content.merge(present_content(scan), ["path"], lambda old, new: old("hash").eqNullSafe(new("hash")))
    process_new(content, todo, lambda changes: changes.filter(F.col(CHANGE) == "insert").select("path"), "content")
    return todo.read().distinct()
