"""Graph operators: import resolution, neighbourhoods, nodes and the impact of a change."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, risk
from ..session import materialize

MAX_HOPS = 3
SYMBOLS_BROADCAST = 500_000
# Fixed value: names that say nothing about who is called.
SKIPPED_CALLEES = ("constructor", "toString", "valueOf", "__init__", "__call__", "self", "super")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, imports, imported_by): distinct edges out of and into each path; one pass, one shuffle."""
    ends = edges.filter("src_path IS NOT NULL AND dst_path IS NOT NULL").select("src_path", "dst_path", F.coalesce("type", F.lit("import")).alias("type")).distinct()
    both = ends.select(F.explode(F.array(F.struct(F.col("src_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return both.groupBy("e.path").agg(F.sum("e.o").alias("imports"), F.sum("e.i").alias("imported_by"))


def related(edges: DataFrame, seeds: DataFrame, hops: int = 1, direction: str = "both", edge: str = "import") -> DataFrame:
    """(seed, id, hops, via): what each seed reaches in up to min(hops, 3) steps; seeds (seed) are many at once.

    The nearest hop wins and the seed itself is left out. via is the direction of the edge that found the
    node, seen from the node before it; `out` goes first where both do. Null ends and self-loops are ignored.
    Each step's frontier is written to the shared folder, so a lost executor doesn't redo earlier steps.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    e = edges.filter(F.col("type").eqNullSafe(edge)).filter("src_path IS NOT NULL AND dst_path IS NOT NULL AND src_path <> dst_path").select("src_path", "dst_path").distinct()
    steps = []
    if direction in ("out", "both"):
        steps.append(e.select(F.col("src_path").alias("from"), F.col("dst_path").alias("to"), F.lit(0).alias("d")))
    if direction in ("in", "both"):
        steps.append(e.select(F.col("dst_path").alias("from"), F.col("src_path").alias("to"), F.lit(1).alias("d")))
    arcs = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    start = seeds.select("seed").filter("seed IS NOT NULL").distinct()
    seen = start.select("seed", F.col("seed").alias("id"))
    frontier, found = seen, None
    for h in range(1, min(hops, MAX_HOPS) + 1):
        reached = frontier.join(arcs, frontier["id"] == arcs["from"]).groupBy("seed", F.col("to").alias("id")).agg(F.min("d").alias("d"))
        fresh = materialize(reached.join(seen, ["seed", "id"], "left_anti"), "frontier")
        layer = fresh.select("seed", "id", F.lit(h).alias("hops"), F.when(F.col("d") == 0, "out").otherwise("in").alias("via"))
        found = layer if found is None else found.unionByName(layer)
        frontier = fresh.select("seed", "id")
        seen = seen.unionByName(frontier)
    return found if found is not None else start.select("seed", F.lit("").alias("id"), F.lit(0).alias("hops"), F.lit("").alias("via")).limit(0)


def truncated(hops: int) -> bool:
    """More hops were asked for than are walked."""
    return hops > MAX_HOPS


def node_views(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, kind, format, chunks, imports, imported_by) of every path with chunks, chunks in order of id."""
    one = nodes.filter("path IS NOT NULL").dropDuplicates(["id"])
    chunk = F.struct("id", "symbol", "node_type", "start_line", "end_line")
    grouped = one.groupBy("path").agg(F.min("kind").alias("kind"), F.min("format").alias("format"), F.sort_array(F.collect_list(chunk)).alias("chunks"))
    d = degrees(edges)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grouped.join(d, "path", "left").select("path", "kind", "format", "chunks", zero("imports"), zero("imported_by"))


# --- resolving imports


def _normal(path: Column) -> Column:
    """a/./b/../c -> a/c; null where it climbs above the root."""
    parts = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))
    up = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("\x00"))),
    )
    joined = F.array_join(up, "/")
    return F.when(~F.contains(joined, F.lit("\x00")), joined)


# What is tried behind a JavaScript specifier, in this order.
JS_FILE = ("", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx")
JS_INDEX = ("/index.js", "/index.mjs", "/index.cjs", "/index.ts", "/index.tsx")


def aliased(specifier: Column, aliases: list[tuple[str, str]]) -> Column:
    """The path that an aliased specifier stands for, null without one: (pattern, target) pairs, the first that fits;
    a pattern and its target may have one wildcard."""
    out = F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        head, star, tail = pattern.partition("*")
        before, _, after = target.partition("*")
        if star:
            inner = F.substring(specifier, F.lit(len(head) + 1), F.length(specifier) - len(head) - len(tail))
            fits = specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= len(head) + len(tail))
            out = F.when(fits, F.concat(F.lit(before), inner, F.lit(after)) if "*" in target else F.lit(target)).otherwise(out)
        else:
            out = F.when(specifier == pattern, F.lit(target)).otherwise(out)
    return out


def resolve_targets(imports: DataFrame, paths: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, specifier, target) from (path, specifier) and the known paths (path).

    Python: an absolute name meets every file whose path ends with it (module or package), a relative one
    climbs a directory per dot after the first. JavaScript: a relative specifier, or one that `aliases` turns into a
    path, meets the first of itself, with an ending, as a directory's index. Anything else is external and dropped.
    """
    known = paths.select("path").filter("path IS NOT NULL").distinct()
    i = imports.filter("path IS NOT NULL AND specifier IS NOT NULL").select(F.col("path").alias("src"), F.col("specifier").alias("spec")).distinct()
    i = i.withColumn("py", extension(F.col("src")) == "py").withColumn("dir", F.regexp_replace("src", "/?[^/]*$", ""))
    meant = F.when(F.col("spec").startswith("."), F.concat_ws("/", "dir", "spec")).otherwise(aliased(F.col("spec"), aliases or []))
    js = i.filter("NOT py").withColumn("base", _normal(meant)).filter("base IS NOT NULL")
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")  # last of all, a .js specifier may name a .ts source
    tries = F.array(*[F.concat("base", F.lit(x)) for x in JS_FILE + JS_INDEX], *[F.concat(bare, F.lit(x)) for x in JS_FILE[1:]])
    js = js.select("src", "spec", F.posexplode(tries).alias("nth", "path")).join(known, "path").groupBy("src", "spec").agg(F.min_by("path", "nth").alias("dst"))
    py = i.filter("py")
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    name = F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    climb = F.when(dots > 1, F.concat("dir", F.repeat(F.lit("/.."), dots - 1))).otherwise(F.col("dir"))
    rel = py.filter("spec LIKE '.%'").withColumn("base", _normal(F.concat_ws("/", climb, name))).filter("base IS NOT NULL")
    rel = rel.select("src", "spec", F.explode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("path")).join(known, "path").select("src", "spec", F.col("path").alias("dst"))
    # every suffix of a known module path is a name by which it can be imported: an equality join
    stem = F.regexp_replace(F.regexp_replace("path", r"/__init__\.py$", ""), r"\.py$", "")
    steps = F.split(stem, "/", -1)
    tails = known.filter("path LIKE '%.py'").select(F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, n, F.size(steps)), "/"))).alias("name"))
    absolute = py.filter("spec NOT LIKE '.%'").select("src", "spec", name.alias("name")).join(tails, "name").select("src", "spec", "dst")
    out = js.select("src", "spec", "dst").unionByName(rel).unionByName(absolute)
    return out.distinct().select(F.col("src").alias("path"), F.col("spec").alias("specifier"), F.col("dst").alias("target"))


def resolve_imports(imports: DataFrame, paths: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """(type, src_path, dst_path): resolve_targets() as distinct edges, without those of a file to itself."""
    out = resolve_targets(imports, paths, aliases).filter("path <> target")
    return out.select(F.lit("import").alias("type"), F.col("path").alias("src_path"), F.col("target").alias("dst_path")).distinct()


# --- impact


def mentions(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, path, line, n): whole-word occurrences of each symbol in every line, lines from 0.

    Lines are cut into words once and joined with the symbols; no text is searched per symbol. Up to SYMBOLS_BROADCAST
    symbols are broadcast, so that words that are none are never shuffled.
    """
    lines = docs.filter("path IS NOT NULL AND body IS NOT NULL").select("path", "body").distinct().select("path", F.posexplode(F.split("body", "\r?\n", -1)).alias("line", "text"))
    words = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_$]+)"), F.lit(1))).alias("symbol"))
    asked = symbols.select("symbol").distinct()
    few = asked.limit(SYMBOLS_BROADCAST + 1).count() <= SYMBOLS_BROADCAST
    return words.join(F.broadcast(asked) if few else asked, "symbol").groupBy("symbol", "path", "line").agg(F.count("*").alias("n"))


def outside(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """uses (symbol, path, line, ...) that lie in no definition of the same symbol."""
    d = defs.select("symbol", "path", "start_line", "end_line").distinct().alias("d")
    u = uses.alias("u")
    inside = (F.col("u.symbol") == F.col("d.symbol")) & (F.col("u.path") == F.col("d.path")) & F.col("u.line").between(F.col("d.start_line"), F.col("d.end_line"))
    return u.join(d, inside, "left_anti")


_word = re.compile(r"[A-Za-z0-9_$]+")


def mention_counts(docs: DataFrame, defs: DataFrame) -> DataFrame:
    """(symbol, mentions): whole-word occurrences of each defined symbol outside its own definitions; symbols without one
    are left out.

    A body meets the definitions of its own file, is cut into words there, and only counts leave the task: no word and
    no line is shuffled. Bodies delivered twice count once. Up to SYMBOLS_BROADCAST symbols are known to the tasks,
    beyond it all words are counted and met with the symbols afterwards.
    """
    asked = defs.select("symbol").filter("symbol IS NOT NULL").distinct()
    some = [r["symbol"] for r in asked.limit(SYMBOLS_BROADCAST + 1).toArrow().to_pylist()]
    few = len(some) <= SYMBOLS_BROADCAST
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(some) if few else None)
    spans = F.collect_set(F.struct("symbol", "start_line", "end_line")).alias("spans")  # of one file
    own = defs.filter("path IS NOT NULL AND symbol IS NOT NULL").groupBy("path").agg(spans)
    bodies = docs.filter("path IS NOT NULL AND body IS NOT NULL").select("path", "body").distinct()

    def run(batches):
        known, total = shared.value, Counter()
        for b in batches:
            for body, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = Counter(_word.findall(body))
                lines = body.split("\n") if mine else []
                inside: dict[str, set[int]] = {}
                for d in mine or ():
                    if d["symbol"] in words and d["start_line"] is not None and d["end_line"] is not None:
                        inside.setdefault(d["symbol"], set()).update(range(max(d["start_line"], 0), min(d["end_line"] + 1, len(lines))))
                for symbol, at in inside.items():
                    words[symbol] -= sum(_word.findall(lines[i]).count(symbol) for i in at)
                for w, n in words.items():
                    if n > 0 and (known is None or w in known):
                        total[w] += n
            if len(total) > 1_000_000:
                yield _counts(total)
                total = Counter()
        yield _counts(total)

    counted = bodies.join(own, "path", "left").select("body", "spans").mapInArrow(run, "symbol string, n long")
    counted = counted if few else counted.join(asked, "symbol", "left_semi")
    return counted.groupBy("symbol").agg(F.sum("n").alias("mentions"))


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["symbol", "n"])


def impact(nodes: DataFrame, docs: DataFrame, calls: DataFrame, complexity: DataFrame, symbols: DataFrame | None = None, alias_calls: DataFrame | None = None) -> DataFrame:
    """One row per defined symbol: definitions, mentions, confirmed call sites, ref_count, risk, complexity,
    callees, hedges.

    calls (path, line, callee, enclosing) and complexity (id, complexity) come from the parser; alias_calls
    (symbol, path, line, alias) are call sites under a re-exported name. A use within one of the symbol's own
    definitions doesn't count. ref_count is the larger of confirmed calls and mentions, so it may count too
    much, never too little.
    """
    defs = nodes.filter("symbol IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL AND node_type NOT IN ('section', 'preamble', 'file')").dropDuplicates(["id"]).select("id", "path", "symbol", "start_line", "end_line", "body")
    if symbols is not None:
        defs = defs.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    base = defs.join(complexity.select("id", "complexity"), "id", "left").groupBy("symbol").agg(F.count("*").alias("defs"), F.coalesce(F.max("complexity"), F.lit(0)).alias("complexity"), F.max(F.col("body").rlike(r"^\s*export\b").cast("int")).alias("_exported"))
    said = mention_counts(docs, defs)
    sites = calls.select(F.col("callee").alias("symbol"), "path", "line").distinct()
    if alias_calls is not None:
        sites = sites.unionByName(alias_calls.select("symbol", "path", "line").distinct())
    sure = outside(sites.join(defs.select("symbol").distinct(), "symbol", "left_semi"), defs).groupBy("symbol").agg(F.count("*").alias("confirmed"))
    names = nodes.filter("symbol IS NOT NULL").select(F.col("symbol").alias("callee")).distinct()
    inner = calls.filter(~F.col("callee").isin(*SKIPPED_CALLEES)).join(names, "callee", "left_semi").select("path", "line", "callee").alias("k")
    d = defs.alias("d")
    made = d.join(inner, (F.col("d.path") == F.col("k.path")) & F.col("k.line").between(F.col("d.start_line"), F.col("d.end_line")) & (F.col("k.callee") != F.col("d.symbol"))).groupBy("d.symbol").agg(F.sort_array(F.collect_set("k.callee")).alias("callees"))
    renamed = alias_calls.groupBy("symbol").agg(F.sort_array(F.collect_set("alias")).alias("aliases"), F.count("*").alias("_via")) if alias_calls is not None else None
    out = base.join(said, "symbol", "left").join(sure, "symbol", "left").join(made, "symbol", "left")
    out = out.join(renamed, "symbol", "left") if renamed is not None else out.withColumn("aliases", F.lit(None).cast("array<string>")).withColumn("_via", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumn("mentions", zero("mentions")).withColumn("confirmed", zero("confirmed")).withColumn("ref_count", F.greatest("mentions", "confirmed"))
    public = (F.col("_exported") == 1) | ~F.col("symbol").startswith("_")
    hedges = F.array_compact(F.array(
        F.when(F.col("_via") > 0, F.concat(F.lit("reached under re-exported names: "), F.array_join("aliases", ", "))),
        F.when((F.col("confirmed") == 0) & (F.col("mentions") > 0), F.concat(F.col("mentions").cast("string"), F.lit(" mentions could not be confirmed as calls"))),
        F.when((F.col("ref_count") == 0) & public, "exported or public: users elsewhere are not visible"),
        F.when(F.col("ref_count") == 0, "no reference outside its definition: to be reviewed, not shown to be unused"),
    ))
    return out.select("symbol", "defs", "mentions", "confirmed", "ref_count", risk(F.col("ref_count")).alias("risk"), "complexity", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"), hedges.alias("hedges"))


def alias_callers(reexports: DataFrame, bindings: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, path, line, alias): calls of a symbol under the name that a barrel exports it by.

    reexports (barrel, symbol, alias) with resolved paths, bindings (path, barrel, alias, local) of the files
    that import the alias from that barrel, calls (path, line, callee).
    """
    chain = reexports.filter("symbol <> alias").join(bindings, ["barrel", "alias"]).select("symbol", "alias", "path", "local")
    return chain.join(calls.select("path", "line", F.col("callee").alias("local")), ["path", "local"]).select("symbol", "path", "line", "alias").distinct()
