"""Source code to chunks, imports, call sites, complexity and signatures.

Python is parsed by the standard library. JavaScript and TypeScript are scanned: comments and literals are
blanked out first, then definitions are found by their opening and closed by matching braces.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import textwrap
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = ("py", "js", "ts")


@dataclass
class Chunk:
    symbol: str | None
    node_type: str
    start: int
    end: int
    complexity: int = 0


class Unparsable(ValueError):
    """The text is not code of its format."""


# --- Python


def _py_tree(text: str) -> ast.Module:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Unparsable(str(e)) from e


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _py_complexity(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.match_case)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def _py_chunks(text: str) -> list[Chunk]:
    kind = lambda x: "class_definition" if isinstance(x, ast.ClassDef) else "function_definition"
    found = [x for x in ast.walk(_py_tree(text)) if isinstance(x, _DEFS)]
    found.sort(key=lambda x: (x.lineno, -(x.end_lineno or 0)))
    return [Chunk(x.name, kind(x), x.lineno - 1, x.end_lineno - 1, _py_complexity(x)) for x in found]


def _py_name(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _py_calls(text: str) -> list[tuple[int, str, str | None]]:
    out = []

    def walk(node: ast.AST, inside: str | None) -> None:
        if isinstance(node, ast.Call) and (n := _py_name(node.func)):
            out.append((node.lineno - 1, n, inside))
        if isinstance(node, _DEFS):
            for d in node.decorator_list:  # a bare decorator applies the name
                if not isinstance(d, ast.Call) and (n := _py_name(d)):
                    out.append((d.lineno - 1, n, inside))
        for child in ast.iter_child_nodes(node):
            walk(child, node.name if isinstance(node, _DEFS) else inside)

    walk(_py_tree(text), None)
    return out


def _py_imports(text: str) -> list[str]:
    out = []
    for x in ast.walk(_py_tree(text)):
        if isinstance(x, ast.Import):
            out += [a.name for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            base = "." * x.level + (x.module or "")
            joint = "" if base.endswith(".") or not base else "."
            out += [base] * bool(x.module) + [f"{base}{joint}{a.name}" for a in x.names if a.name != "*"]
    return list(dict.fromkeys(out))


def _py_signature(text: str) -> str | None:
    for source in (text, textwrap.dedent(text)):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            continue
        d = next((x for x in ast.walk(tree) if isinstance(x, _DEFS)), None)
        if d is None:
            return None
        lines = source.split("\n")
        first = d.body[0]
        if first.lineno == d.lineno:
            head = "\n".join([*lines[: d.lineno - 1], lines[d.lineno - 1].encode()[: first.col_offset].decode().rstrip()])
        else:
            last = first.lineno - 1
            while last > d.lineno and not lines[last - 1].split("#")[0].strip():
                last -= 1
            head = "\n".join(lines[:last])
            if isinstance(first, _DEFS) and first.decorator_list:
                head = "\n".join(lines[: first.decorator_list[0].lineno - 1]).rstrip()
        doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        return head.rstrip() + (f"\n    {ast.get_source_segment(source, first.value)}" if doc else "")
    return None


# --- JavaScript and TypeScript

_BLANK = re.compile(
    r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\[+])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S
)
_NAME = r"[A-Za-z_$][\w$]*"
_OPEN = re.compile(
    rf"(?P<fn>\b(?:async\s+)?function\b\s*\*?\s*(?P<fname>{_NAME})?\s*(?=[(<]))|(?P<cls>\bclass\s+(?P<cname>{_NAME}))|(?P<ifc>\binterface\s+(?P<iname>{_NAME}))"
    rf"|(?P<typ>\btype\s+(?P<tname>{_NAME})\s*(?:<[^=;]*>)?\s*=)|(?P<arr>(?:(?:\b(?:const|let|var)\s+)?(?P<aname>{_NAME})\s*(?::[^=;(){{}}]*)?=\s*)?(?:\basync\s+)?(?:\((?:[^()]|\([^()]*\))*\)|{_NAME})\s*(?::[^=;{{}}]*)?=>)"
)
_METHOD = re.compile(rf"(?:^|(?<=[;{{}}\n]))[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|\*)\s+|\*\s*)*(?P<name>#?{_NAME})\s*(?:<[^()<>]*>)?\s*\(")
_WORDS = set("if for while switch catch return function typeof new await yield throw delete void in of do else case with super import".split())
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<q>[.\w$]*?)(?P<name>{_NAME})\s*(?:\?\.)?\(")
_BRANCH = re.compile(r"\b(?:if|for|while|do|case|catch)\b|\?(?![.?:])(?=[^\n]*:)")


def blank(text: str) -> str:
    """The text with comments and literals replaced by spaces; lines stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(code: str, at: int, pair: str) -> int:
    """Position after the bracket that matches the one at `at`; the end if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(code)


def _body(code: str, at: int) -> tuple[int, int]:
    """(start, end) of the block that follows the parameters which begin at or after `at`."""
    p = code.find("(", at)
    at = _close(code, p, "()") if p >= 0 else at
    b = code.find("{", at)
    end = re.compile(r";|\n\s*\n").search(code, at)
    if b < 0 or (end and end.start() < b):
        return (end.end() if end else len(code),) * 2
    return b, _close(code, b, "{}")


def _spans(code: str) -> list[tuple[str | None, str, int, int, int]]:
    """(name, type, start, body start, end) of definitions by position."""
    out = []
    for m in _OPEN.finditer(code):
        if m["fn"]:
            b, e = _body(code, m.end())
            out.append((m["fname"], "function_declaration" if m["fname"] else "function_expression", m.start(), b, e))
        elif m["cls"] or m["ifc"]:
            b = code.find("{", m.end())
            if b < 0:
                continue
            e = _close(code, b, "{}")
            out.append((m["cname"] or m["iname"], "class_declaration" if m["cls"] else "interface_declaration", m.start(), b, e))
            if m["cls"]:
                out += _methods(code, b + 1, e - 1)
        elif m["typ"]:
            depth, e = 0, len(code)
            for x in re.compile(r"[{}();\n]").finditer(code, m.end()):
                depth += (x[0] in "{(") - (x[0] in "})")
                if depth <= 0 and x[0] in ";\n":
                    e = x.start()
                    break
            out.append((m["tname"], "type_alias_declaration", m.start(), m.end(), e))
        else:
            rest = re.compile(r"\s*").match(code, m.end()).end()
            if code[rest : rest + 1] == "{":
                b, e = rest, _close(code, rest, "{}")
            else:
                b, depth, e = rest, 0, len(code)
                for x in re.compile(r"[(){}\[\];,\n]").finditer(code, rest):
                    if x[0] in "({[":
                        depth += 1
                    elif x[0] in ")}]":
                        depth -= 1
                    if depth < 0 or (depth == 0 and x[0] in ";,\n"):
                        e = x.start()
                        break
            out.append((None, "arrow_function", m.start(), b, e))
    return sorted(out, key=lambda x: (x[2], -x[4]))


def _methods(code: str, start: int, end: int) -> list:
    out, at = [], start
    while m := _METHOD.search(code, at, end):
        if m["name"] in _WORDS or code[start : m.start("name")].count("{") != code[start : m.start("name")].count("}"):
            at = m.end()
            continue
        after = _close(code, m.end() - 1, "()")
        b = re.compile(r"\s*(?::[^{;=]*)?\{").match(code, after)
        if not b:
            at = after
            continue
        e = _close(code, b.end() - 1, "{}")
        out.append((m["name"].lstrip("#"), "method_definition", m.start("name"), b.end() - 1, e))
        at = e
    return out


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _js_chunks(text: str) -> list[Chunk]:
    code = blank(text)
    if code.count("{") != code.count("}"):
        raise Unparsable("braces don't match")
    at = _line_starts(text)
    row = lambda p: bisect_right(at, p) - 1
    return [Chunk(n, t, row(s), row(max(s, e - 1)), 1 + len(_BRANCH.findall(code[s:e]))) for n, t, s, _, e in _spans(code)]


def _js_calls(text: str) -> list[tuple[int, str, str | None]]:
    code, at = blank(text), _line_starts(text)
    spans = _spans(code)
    own = {code.index("(", s) for _, t, s, _, e in spans if t in ("method_definition", "function_declaration") and "(" in code[s:e]}
    out = []
    for m in _CALL.finditer(code):
        if m["new"] or m["name"] in _WORDS or m.end() - 1 in own:
            continue
        inner = [x for x in spans if x[2] <= m.start("name") < x[4] and x[0]]
        out.append((bisect_right(at, m.start("name")) - 1, m["name"], min(inner, key=lambda x: x[4] - x[2])[0] if inner else None))
    for m in re.finditer(rf"@(?:{_NAME}\.)*({_NAME})(?!\s*\(|[\w$.])", code):
        out.append((bisect_right(at, m.start()) - 1, m[1], None))
    return out


_FROM = re.compile(r"""(?:\bimport\b|\bexport\b)[^'"`;]*?\bfrom\s*(['"])([^'"\n]+)\1|\bimport\s*(['"])([^'"\n]+)\3|\brequire\s*\(\s*(['"])([^'"\n]+)\5\s*\)""")


def _js_imports(text: str) -> list[str]:
    bare = re.sub(r"/\*.*?\*/|(?<![:'\"])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    return list(dict.fromkeys(m[2] or m[4] or m[6] for m in _FROM.finditer(bare)))


_DOC = re.compile(r"\s*(/\*.*?\*/|(?:[ \t]*//[^\n]*\n)+)", re.S)


def _js_signature(text: str) -> str | None:
    code = blank(text)
    spans = _spans(code) or _methods(code, 0, len(code))
    if not spans:
        return None
    _, _, _, b, _ = spans[0]
    lead = _DOC.match(text)
    head = re.sub(r"^[ \t]*\n+", "", text[lead.end() if lead else 0 : b]).rstrip()
    return f"{lead[1].strip()}\n{head}" if lead else head


# --- reexports, for callers under another name

_REEXPORT = re.compile(r"""\bexport\s*\{([^}]*)\}\s*from\s*(['"])([^'"\n]+)\2""")
_IMPORT_NAMES = re.compile(r"""\bimport\s*(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*(['"])([^'"\n]+)\3""")


def _pairs(names: str) -> list[tuple[str, str]]:
    out = []
    for part in filter(None, (p.strip() for p in names.split(","))):
        a, _, b = part.partition(" as ")
        out.append((a.strip().removeprefix("type "), (b or a).strip()))
    return out


def reexports_of(text: str) -> list[tuple[str, str, str]]:
    """(name, alias, specifier) that a barrel hands on."""
    return [(a, b, m[3]) for m in _REEXPORT.finditer(text) for a, b in _pairs(m[1])]


def bindings_of(text: str) -> list[tuple[str, str, str]]:
    """(exported name, local name, specifier) that a file imports."""
    out = []
    for m in _IMPORT_NAMES.finditer(text):
        out += [("default", m[1], m[4])] * bool(m[1]) + [(a, b, m[4]) for a, b in _pairs(m[2] or "")]
    return out


# --- one entry per language


def _comments(fmt: str, text: str) -> dict[int, tuple[int, bool]]:
    """Comments with lines of their own: last line -> (first line, whether it is a block)."""
    if fmt == "py":
        try:
            tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
        except (tokenize.TokenError, SyntaxError):
            return {}
        rows = [t.start[0] - 1 for t in tokens if t.type == tokenize.COMMENT and t.line.lstrip().startswith("#")]
        return {r: (r, False) for r in rows}
    starts, out = _line_starts(text), {}
    for m in _BLANK.finditer(text):
        if m[0][:2] not in ("//", "/*"):
            continue
        first, last = (bisect_right(starts, at) - 1 for at in (m.start(), m.end() - 1))
        after = text.find("\n", m.end())
        if not text[starts[first] : m.start()].strip() and not text[m.end() : after if after >= 0 else None].strip():
            out[last] = (first, m[0][1] == "*")
    return out


def _uncovered(spans: list[tuple[int, int]], n: int) -> list[int]:
    """The lines of 0..n-1 that lie in no span (first, last)."""
    out, at = [], 0
    for first, last in sorted(spans):
        out += range(at, first)
        at = max(at, last + 1)
    return [*out, *range(at, n)]


def chunks_of(fmt: str | None, text: str) -> list[tuple[Chunk, str]]:
    """Chunks with their text: each definition with the comments right above it (line comments, or one block and the
    line comments under it), then what is left."""
    lines = text.split("\n")
    whole = [(Chunk(None, "file", 0, len(lines) - 1), text)]
    if fmt not in PARSED:
        return whole
    try:
        found = _py_chunks(text) if fmt == "py" else _js_chunks(text)
    except Unparsable:
        return whole
    above = _comments(fmt, text)
    for c in found:
        block = False
        while not block and c.start - 1 in above:
            c.start, block = above[c.start - 1]
    rest = "\n".join(lines[i] for i in _uncovered([(c.start, c.end) for c in found], len(lines))).strip()
    chunks = [(c, "\n".join(lines[c.start : c.end + 1])) for c in found]
    return chunks + ([(Chunk(None, "preamble", 0, len(lines) - 1), rest)] if rest else [])


def calls_of(fmt: str | None, text: str) -> list[tuple[int, str, str | None]]:
    try:
        return _py_calls(text) if fmt == "py" else _js_calls(text) if fmt in PARSED else []
    except Unparsable:
        return []


def imports_of(fmt: str | None, text: str) -> list[str]:
    try:
        return _py_imports(text) if fmt == "py" else _js_imports(text) if fmt in PARSED else []
    except Unparsable:
        return []


def signature_of(fmt: str | None, text: str | None) -> str | None:
    """Header and documentation of a definition without its body; None if there is none to be found."""
    if not text or fmt not in PARSED:
        return None
    return _py_signature(text) if fmt == "py" else _js_signature(text)


def compress(text: str, level: str, fmt: str | None = None, symbol: str | None = None) -> str:
    if level == "verbatim":
        return text
    if level == "signature":
        return signature_of(fmt, text) or text
    if level == "drop":
        return f"{symbol} …" if symbol else "…"
    raise ValueError(f"unknown level {level!r}")


# --- over tables


def _over(docs: DataFrame, schema: str, each, names: list[str]) -> DataFrame:
    """A row per result of each(path, format, body); null bodies are read as empty, null paths left out."""
    types = [f.split()[1] for f in schema.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32()}

    def run(batches):
        for b in batches:
            rows = [r for p, f, t in zip(*(b.column(i).to_pylist() for i in range(3))) for r in each(p, f, t or "")]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), arrow[t]) for c, t in zip(cols, types)], names)

    return docs.filter("path IS NOT NULL").select("path", "format", "body").mapInArrow(run, schema)


def chunk_files(docs: DataFrame) -> DataFrame:
    """(path, format, nth, symbol, node_type, start_line, end_line, complexity, body) of code files."""
    each = lambda p, f, t: [(p, f, n, c.symbol, c.node_type, c.start, c.end, c.complexity, x) for n, (c, x) in enumerate(chunks_of(f, t))]
    return _over(docs, "path string, format string, nth int, symbol string, node_type string, start_line int, end_line int, complexity int, body string", each, ["path", "format", "nth", "symbol", "node_type", "start_line", "end_line", "complexity", "body"])


def call_sites(docs: DataFrame) -> DataFrame:
    """(path, line, callee, enclosing): confirmed calls, not mentions in comments or strings."""
    return _over(docs, "path string, line int, callee string, enclosing string", lambda p, f, t: [(p, *c) for c in calls_of(f, t)], ["path", "line", "callee", "enclosing"])


def import_specifiers(docs: DataFrame) -> DataFrame:
    """(path, specifier)."""
    return _over(docs, "path string, specifier string", lambda p, f, t: [(p, s) for s in imports_of(f, t)], ["path", "specifier"])


def reexports(docs: DataFrame) -> DataFrame:
    return _over(docs, "path string, symbol string, alias string, specifier string", lambda p, f, t: [(p, *r) for r in reexports_of(t)] if f in ("js", "ts") else [], ["path", "symbol", "alias", "specifier"])


def import_bindings(docs: DataFrame) -> DataFrame:
    return _over(docs, "path string, alias string, local string, specifier string", lambda p, f, t: [(p, *r) for r in bindings_of(t)] if f in ("js", "ts") else [], ["path", "alias", "local", "specifier"])


def signature_column(unit: Column) -> Column:
    """signature_of() over a struct(content, format, symbol), in Arrow batches."""
    run = F.pandas_udf(lambda u: u.apply(lambda r: signature_of(r["format"], r["content"]), axis=1) if len(u) else u["content"], "string")
    return run(unit)
