"""The index of a folder of source files: incremental building, code recall, graph and impact."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse
from .functions import text as T
from .operators import folds, graph, lexical, memory, rank
from .operators.incremental import VersionedTable
from .session import materialize
from .sources import files
from .sources.files import load_ts_paths

FILES = "path string, kind string, format string, hash string, mtime long, size long, body string"
NODES = "id long, path string, kind string, format string, nth int, symbol string, node_type string, start_line int, end_line int, complexity int, body string"
CALLS = "path string, line int, callee string, enclosing string"
IMPORTS = "path string, specifier string"
EDITS = "build long, path string, symbol string, kind string, ts long"


class StalePointer(LookupError):
    """The file has changed since the chunk was indexed."""


def engine_stamp() -> str:
    """A number that changes with the code that makes chunks; another one means building anew."""
    here = Path(__file__).parent
    code = b"".join((here / p).read_bytes() for p in ("functions/parse.py", "functions/text.py", "operators/folds.py", "index.py"))
    return str(int.from_bytes(hashlib.sha256(code).digest()[:4], "big") & 0x7FFFFFFF)


class SourceIndex:
    """Tables of files, chunks, calls and imports under `root`, kept in step with the folder `source`."""

    def __init__(self, spark: SparkSession, root: str, source: str, include: tuple[str, ...] = T.INCLUDED, embed: Callable[[str], list[float]] | None = None, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.source, self.include, self.embed, self.clock = spark, source, include, embed, clock
        table = lambda name, schema: VersionedTable(spark, f"{root}/{name}", schema)
        self.files, self.nodes, self.calls = table("files", FILES), table("nodes", NODES), table("calls", CALLS)
        self.imports, self.edits, self.vectors = table("imports", IMPORTS), table("edits", EDITS), table("vectors", "path string, dim int, vec array<float>")

    def build(self, pathspecs: list[str] | None = None, force: bool = False) -> dict[str, int]:
        """Index what is new or changed; counts by status. Files of equal time and size are not read, equal
        contents only get their new time, a pass limited to pathspecs deletes nothing. Files go last: if a
        build is interrupted, the next one does the same files again."""
        stamp, base = engine_stamp(), self.files.latest()
        fresh = force or self.files.manifest().properties.get("stamp") != stamp
        tracked = files.git_paths(self.source, pathspecs) if pathspecs else None
        now = materialize(files.listing(self.spark, self.source, self.include, tracked), "listing")
        stored = self.files.read() if not fresh else self.files.read().limit(0)
        first = materialize(files.diff_listing(now, stored, scoped=pathspecs is not None), "diff")
        read = materialize(files.contents(self.spark, self.source, first.filter("status = 'check'")).join(now, "path"), "read")
        status = files.diff_hashed(read.select("path", "hash"), stored.select("path", "hash"))
        changed = materialize(read.join(status, "path"), "changed")
        upserts = changed.filter("status = 'upsert'")
        gone = upserts.select("path").unionByName(first.filter("status = 'deleted'").select("path"))
        if fresh:
            gone = gone.unionByName(self.files.read().select("path")).distinct()
        code = upserts.filter("kind = 'code'").select("path", "format", "body")
        chunks = parse.chunk_files(code).withColumn("kind", F.lit("code"))
        sections = folds.sections(upserts.filter("kind = 'doc'"), ["path", "format"]).select(
            "path", F.lit("doc").alias("kind"), "format", F.col("section").cast("int").alias("nth"), "symbol", "node_type", "start_line", "end_line", F.lit(0).alias("complexity"), F.col("text").alias("body")
        )
        new = materialize(chunks.unionByName(sections).withColumn("id", F.xxhash64("path", "nth", "symbol", "start_line")), "chunks")
        if not fresh:
            # a build that died and is done again has the same base, so its edits count once (edit_log)
            edited = files.edited_chunks(new, self.nodes.read()).withColumn("ts", F.lit(self.clock())).withColumn("build", F.lit(base).cast("long"))
            self.edits.append(materialize(edited, "edited"))
        self.nodes.rewrite(gone, new, ["path"])
        self.calls.rewrite(gone, parse.call_sites(code), ["path"])
        self.imports.rewrite(gone, parse.import_specifiers(code), ["path"])
        if self.embed is not None:
            self._embed(upserts, gone)
        replaced = changed.select("path").unionByName(gone).distinct()
        self.files.rewrite(replaced, changed.select("path", "kind", "format", "hash", "mtime", "size", "body"), ["path"], {"stamp": stamp})
        counts = {r["status"]: r["count"] for r in first.filter("status <> 'check'").unionByName(changed.select("path", "status")).groupBy("status").count().collect()}
        return {k: counts.get(k, 0) for k in ("upsert", "touch", "unchanged", "deleted")}

    def _embed(self, upserts: DataFrame, gone: DataFrame) -> None:
        """Vectors of changed files and of those that have none."""
        embed = self.embed
        missing = self.files.read().join(self.vectors.read().select("path"), "path", "left_anti").join(gone, "path", "left_anti").select("path", "body")
        run = F.pandas_udf(lambda s: s.map(lambda t: [float(x) for x in embed((t or "")[:6000])]), "array<float>")
        made = upserts.select("path", "body").unionByName(missing).select("path", run("body").alias("vec")).select("path", F.size("vec").alias("dim"), "vec")
        self.vectors.rewrite(gone, made, ["path"])

    # --- reading

    def aliases(self) -> list[tuple[str, str]]:
        """The path aliases of the folder's tsconfig.json."""
        config = Path(self.source, "tsconfig.json")
        return load_ts_paths(config.read_text()) if config.is_file() else []

    def edges(self) -> DataFrame:
        return graph.resolve_imports(self.imports.read(), self.files.read().select("path"), self.aliases())

    def edit_log(self) -> DataFrame:
        """(path, symbol, kind, ts) of every edited chunk, once a build."""
        return self.edits.read().groupBy("build", "path", "symbol", "kind").agg(F.min("ts").alias("ts")).drop("build")

    def recent_activity(self, days: int = 7, limit: int = 20) -> DataFrame:
        return memory.recent_activity(self.edit_log(), self.clock(), days, limit)

    def vectors_of(self, *paths: str) -> DataFrame:
        """(path, dim, vec) of the paths that have a vector."""
        return self.vectors.read().filter(F.col("path").isin(*paths))

    def files_with(self, text: str) -> DataFrame:
        """(path) of the files whose body holds a text, in order."""
        return self.files.read().filter(F.contains("body", F.lit(text))).select("path").orderBy("path")

    def recall(self, query: str, kind: str = "code", n: int = 10, spread: bool = True, chunks: bool = True) -> DataFrame:
        """(path, score, bm25, chunk columns) of the best files: lexical pool, import spreading, fusion with
        cosine where there are vectors, localisation of the final hits."""
        terms = T.query_terms(query)
        names = self.nodes.read().filter("symbol IS NOT NULL").groupBy("path").agg(F.collect_set("symbol").alias("symbols"))
        docs = self.files.read().select("path", "kind", "body").join(names, "path", "left")
        corpus = docs.select("path", "kind", T.index_tokens(F.col("path"), F.col("symbols"), F.col("body")).alias("tokens"))
        pool = materialize(rank.top(lexical.bm25(corpus, terms, F.col("kind") == kind).select("path", "score"), rank.pool_size(n)), "pool")
        scored = rank.spread(pool, self.edges()) if spread else pool.withColumn("bm25", F.col("score"))
        if self.embed is not None:
            near = materialize(rank.similarity(rank.usable(self.vectors.read()), self.embed(query)), "near")
            fused = rank.fuse(scored.select("path", "score"), near).select("path", "fused", "cosine")
            scored = scored.join(fused, "path").withColumn("order", F.coalesce("fused", "score"))
        else:
            scored = scored.withColumn("order", F.col("score"))
        hits = materialize(rank.top(scored, n, "order"), "hits")
        if not chunks or not terms:
            return hits.orderBy(F.desc("order"), "path")
        return hits.join(rank.localize(hits, self.nodes.read(), terms), "path", "left").orderBy(F.desc("order"), "path")

    def chunk(self, path: str, start: int, end: int) -> str | None:
        """The lines of an indexed chunk; None if the file is gone, an error if it has changed since."""
        row = self.files.read().filter(F.col("path") == path).select("hash", "body").first()
        if row is None:
            return None
        try:
            data = Path(self.source, path).read_bytes()
        except OSError:
            return None
        if hashlib.sha256(data).hexdigest() != row["hash"]:
            raise StalePointer(path)
        return "\n".join(row["body"].split("\n")[start : end + 1])

    def related(self, path: str, hops: int = 1, direction: str = "both") -> DataFrame:
        seeds = self.spark.createDataFrame([(path,)], "seed string")
        found = graph.related(self.edges(), seeds, hops, direction)
        return found.join(self.files.read().select(F.col("path").alias("id"), "kind", "format"), "id", "left")

    def node(self, path: str) -> DataFrame:
        mine = self.nodes.read().filter(F.col("path") == path)
        return graph.node_views(mine, self.edges().filter((F.col("src_path") == path) | (F.col("dst_path") == path)))

    def impact(self, *symbols: str) -> DataFrame:
        """Impact of the symbols, callers under re-exported names included."""
        want = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
        nodes, docs, calls = self.nodes.read(), self.files.read(), self.calls.read()
        known = docs.select("path")
        code = docs.filter("format IN ('js', 'ts')")
        placed = lambda df: df.join(graph.resolve_targets(df.select("path", "specifier"), known, self.aliases()), ["path", "specifier"])
        re = placed(parse.reexports(code)).select(F.col("path").alias("barrel"), "symbol", "alias")
        bind = placed(parse.import_bindings(code)).select("path", F.col("target").alias("barrel"), "alias", "local")
        return graph.impact(nodes, docs, calls, nodes.select("id", "complexity"), want, graph.alias_callers(re, bind, calls))
