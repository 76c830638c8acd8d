"""Files as tables: listings, contents, uploads; and what changed between two listings."""

from __future__ import annotations

import io
import json
import re
import subprocess
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import INCLUDED, classify_path, classify_upload, derive_doc_id
from ..operators.folds import SEGMENT, segments

# Directories that are never indexed, and the bounds of an upload.
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", ".venv", "__pycache__")
MAX_BYTES, MAX_PAGES = 10 * 1024 * 1024, 2000
GAP = 1.5


class UploadRejected(ValueError):
    """An upload is too large, broken, encrypted or without text; nothing of it is stored."""


def listing(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDED, tracked: list[str] | None = None) -> DataFrame:
    """(path, mtime, size) of the source files under root, paths relative to it; contents are not read.

    tracked limits them to the paths git lists (see git_paths). Skipped directories are left out.
    """
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    rows = df.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rows = rows.filter(F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).isin(*include))
    rows = rows.filter(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    if tracked is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in tracked], "path string"), "path", "left_semi")
    return rows


def git_paths(root: str, pathspecs: list[str] | None = None) -> list[str] | None:
    """What git tracks under root, None without a repository."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--", *(pathspecs or [])], capture_output=True, check=True, text=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.splitlines()


#: Up to so many wanted files are opened by name; more are met in a pass over the folder.
NAMED_FILES = 10_000


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, kind, format, body, hash) of the wanted paths only; up to NAMED_FILES of them, no other file is opened."""
    base = root.rstrip("/")
    named = [r["path"] for r in paths.select("path").distinct().limit(NAMED_FILES + 1).collect()]
    if not named:
        return spark.createDataFrame([], "path string, kind string, format string, body string, hash string")
    reader = spark.read.format("binaryFile")
    if len(named) <= NAMED_FILES:
        df = reader.load([f"{base}/" + re.sub(r"([\\*?{}\[\]])", r"\\\1", p) for p in named])
    else:
        df = reader.option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    rows = df.select(rel.alias("path"), "content").join(paths.select("path").distinct(), "path", "left_semi")
    return rows.select("path", classify_path(F.col("path")).alias("c"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("hash")).select("path", "c.kind", "c.format", "body", "hash")


def diff_listing(now: DataFrame, stored: DataFrame, scoped: bool = False) -> DataFrame:
    """(path, status) of a listing (path, mtime, size) against the stored rows: check where time or size
    differ or nothing is stored, unchanged, and deleted (not on a pass limited to some paths)."""
    n, s = now.select("path", "mtime", "size").alias("n"), stored.select("path", "mtime", "size").alias("s")
    j = n.join(s, F.col("n.path") == F.col("s.path"), "left" if scoped else "full_outer")
    same = (F.col("n.mtime") == F.col("s.mtime")) & (F.col("n.size") == F.col("s.size"))
    status = F.when(F.col("n.path").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("check")
    return j.select(F.coalesce("n.path", "s.path").alias("path"), status.alias("status"))


def diff_hashed(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status) of files that had to be read: touch if the hash (path, hash) is the stored one, else upsert."""
    s = stored.select("path", F.col("hash").alias("_old"))
    return checked.join(s, "path", "left").select("path", F.when(F.col("hash") == F.col("_old"), "touch").otherwise("upsert").alias("status"))


def snapshot_diff(now: DataFrame, stored: DataFrame, scoped: bool = False) -> DataFrame:
    """(path, status) for listings that carry hashes: touch, upsert, unchanged or deleted."""
    first = diff_listing(now, stored, scoped)
    todo = now.select("path", "hash").join(first.filter("status = 'check'").select("path"), "path", "left_semi")
    return first.filter("status <> 'check'").unionByName(diff_hashed(todo, stored))


def stale_stamps(nodes: DataFrame, current: int) -> DataFrame:
    """(path) of files with chunks that another format of the index wrote."""
    return nodes.filter(~F.col("stamp").eqNullSafe(current)).select("path").distinct()


def edited_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, symbol, kind) of chunks whose symbol and body were not among the file's chunks before; files
    that had none are new, not edited."""
    known = old.select(F.col("path").alias("p"), F.col("symbol").alias("s"), F.xxhash64(F.coalesce("body", F.lit(""))).alias("h")).distinct()
    fresh = new.withColumn("_h", F.xxhash64(F.coalesce("body", F.lit("")))).join(old.select("path").distinct(), "path", "left_semi")
    cond = (F.col("path") == F.col("p")) & F.col("symbol").eqNullSafe(F.col("s")) & (F.col("_h") == F.col("h"))
    return fresh.join(known, cond, "left_anti").select("path", "symbol", "kind").distinct()


def git_activity(log: DataFrame) -> DataFrame:
    """(path, commits, last_commit) from commits (path, commit, ts in seconds); renames are not followed."""
    return log.groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.max("ts").alias("last_commit"))


def git_log(spark: SparkSession, root: str) -> DataFrame:
    """Commits of the repository as (path, commit, ts); empty without one. One call of git."""
    schema = "path string, commit string, ts long"
    try:
        out = subprocess.run(["git", "-C", root, "log", "--name-only", "--format=%x01%H %ct"], capture_output=True, check=True, text=True, timeout=300).stdout
    except (OSError, subprocess.SubprocessError):
        return spark.createDataFrame([], schema)
    rows, at = [], ("", 0)
    for line in out.splitlines():
        if line.startswith("\x01"):
            commit, ts = line[1:].split()
            at = (commit, int(ts))
        elif line:
            rows.append((line, *at))
    return spark.createDataFrame(rows, schema)


# --- uploads


def lines_to_paragraphs(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, paragraph, text) of positioned lines (doc, page, y, nth, text), y falling down a page.

    A new paragraph begins on a new page or where the gap to the line above is more than 1.5 times the
    page's median gap (the upper one of an even number).
    """
    flow = Window.partitionBy(doc, "page").orderBy("nth")
    gaps = items.withColumn("gap", F.abs(F.lag("y").over(flow) - F.col("y")))
    w = Window.partitionBy(doc, "page")
    real = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(w))
    gaps = gaps.withColumn("median", F.when(F.size(real) > 0, F.get(real, F.floor(F.size(real) / 2).cast("int"))))
    begins = F.coalesce(F.col("gap").isNull() | (F.col("gap") > GAP * F.col("median")), F.lit(False)).cast("int")
    run = Window.partitionBy(doc).orderBy("page", "nth")
    grouped = gaps.withColumn("paragraph", F.sum(begins).over(run) - 1)
    return grouped.groupBy(doc, "paragraph").agg(F.sort_array(F.collect_list(F.struct("page", "nth", "text"))).alias("r")).select(doc, "paragraph", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_markdown(data: bytes) -> str:
    """Headings, paragraphs, list items, links and tables of a docx file, in their order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
            rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in z.namelist() else ()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise UploadRejected("not a readable docx file") from e
    targets = {r.get("Id"): r.get("Target") for r in rels if r.get("TargetMode") == "External"}
    body = root.find(f"{_W}body")
    out: list[str] = []
    for node in body if body is not None else root:
        if node.tag == f"{_W}p" and (text := _docx_text(node, targets)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"Heading(\d)", style.get(f"{_W}val", "") if style is not None else "")
            item = node.find(f"{_W}pPr/{_W}numPr") is not None
            line = "#" * int(level[1]) + " " + text if level else f"- {text}" if item else text
            if item and out and out[-1].startswith("- "):
                out[-1] += f"\n{line}"  # one list is one paragraph
            else:
                out.append(line)
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, (_docx_text(p, targets) for p in cell.iter(f"{_W}p")))) for cell in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            if lines:
                out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
    return "\n\n".join(out)


def _docx_text(p: ElementTree.Element, targets: dict) -> str:
    """The text of a paragraph, external links as [text](target)."""
    parts = []
    for node in p:
        text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
        url = targets.get(node.get(_R)) if node.tag == f"{_W}hyperlink" else None
        parts.append(f"[{text}]({url})" if url and text else text)
    return "".join(parts).strip()


def ingest(uploads: DataFrame, budget: int = SEGMENT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(name, id, kind, format, text, bytes, error): uploads (name, content) as rows to be written.

    Text and markdown become segments id#0, id#1, ...; docx goes through markdown; anything else is kept as
    bytes and found by its name alone. What is too large, broken or empty comes back as one row with an
    error and no text. Null contents are empty.
    """
    base = uploads.select("name", F.coalesce("content", F.lit(b"")).alias("content"), classify_upload(F.col("name")).alias("c"), derive_doc_id(F.col("name")).alias("base"))
    base = base.select("name", "content", "c.route", "c.format", "base", (F.octet_length("content") > max_bytes).alias("big"))

    def convert(batches):
        for b in batches:
            out = []
            for data, route, fmt in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                try:
                    out.append((docx_markdown(data), None) if fmt == "docx" else (None, f"no converter for {fmt}"))
                except UploadRejected as e:
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array([x for x, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["name", "format", "base", "body", "error"])

    ok = base.filter("NOT big")
    converted = ok.filter("route = 'convert'").drop("big").mapInArrow(convert, "name string, format string, base string, body string, error string")
    plain = ok.filter("route IN ('text', 'markdown')").select("name", "format", "base", F.decode("content", "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))
    texts = plain.unionByName(converted)
    parts = segments(texts.filter("error IS NULL"), ["name", "format", "base"], "body", budget)
    rows = parts.select("name", F.concat("base", F.lit("#"), "segment").alias("id"), F.lit("doc").alias("kind"), "format", "text", F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("error"))
    blobs = ok.filter("route = 'blob'").select("name", F.col("base").alias("id"), F.lit("doc").alias("kind"), "format", F.col("name").alias("text"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))
    reject = lambda df, why: df.select("name", F.col("base").alias("id"), F.lit("doc").alias("kind"), "format", F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("bytes"), why.alias("error"))
    empty = texts.filter("error IS NULL").join(rows.select("name").distinct(), "name", "left_anti")
    return rows.unionByName(blobs).unionByName(reject(base.filter("big"), F.lit("too large"))).unionByName(reject(texts.filter("error IS NOT NULL"), F.col("error"))).unionByName(reject(empty, F.lit("no text")))


# --- path aliases


def load_ts_paths(config: str) -> list[tuple[str, str]]:
    """(pattern, target) of a tsconfig's path aliases; comments and trailing commas are allowed."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", config, flags=re.S)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    return [(k, f"{base}/{v[0]}".removeprefix("/").removeprefix("./").replace("/./", "/")) for k, v in options.get("paths", {}).items() if v]


def apply_alias(specifier: str, aliases: list[tuple[str, str]]) -> str | None:
    """The path that an aliased specifier stands for; at most one wildcard a pattern."""
    for pattern, target in aliases:
        head, star, tail = pattern.partition("*")
        if star and specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail):
            return target.replace("*", specifier[len(head) : len(specifier) - len(tail)], 1)
        if not star and specifier == pattern:
            return target
    return None
