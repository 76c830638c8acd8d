import io
import os
import zipfile

import pytest

from cairnlake import api, session
from cairnlake.functions import parse
from cairnlake.operators import graph
from cairnlake.operators.fences import GLOBAL, ScopeRequired
from cairnlake.sources import files
from cairnlake.streaming import logs


def test_listing_and_diff(spark, tmp_path):
    for p, b in {"src/a.py": "x = 1\n", "src/b.ts": "let b;", "node_modules/m/i.js": "no", "README.md": "# Hi", "c.txt": "no"}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(b)
    now = files.listing(spark, str(tmp_path))
    assert sorted(r["path"] for r in now.collect()) == ["README.md", "src/a.py", "src/b.ts"]
    body = files.contents(spark, str(tmp_path), now.filter("path LIKE 'src/%'"))
    assert {(r["path"], r["kind"], r["format"], r["body"]) for r in body.collect()} == {("src/a.py", "code", "py", "x = 1\n"), ("src/b.ts", "code", "ts", "let b;")}
    schema = "path string, mtime long, size long, hash string"
    old = spark.createDataFrame([("keep", 1, 1, "h"), ("touch", 1, 1, "h"), ("edit", 1, 1, "h"), ("gone", 1, 1, "h")], schema)
    new = spark.createDataFrame([("keep", 1, 1, "h"), ("touch", 2, 1, "h"), ("edit", 1, 2, "i"), ("new", 1, 1, "h")], schema)
    assert dict(tuple(r) for r in files.snapshot_diff(new, old).collect()) == {"keep": "unchanged", "touch": "touch", "edit": "upsert", "gone": "deleted", "new": "upsert"}
    assert "gone" not in dict(tuple(r) for r in files.snapshot_diff(new, old, scoped=True).collect())
    assert files.git_paths(str(tmp_path)) is None and files.git_log(spark, str(tmp_path)).count() == 0


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def test_ingest(spark):
    up = spark.createDataFrame([
        ("notes.md", bytearray(b"# A\nx\n# B\ny")), ("flat.txt", bytearray(b"one\ntwo")), ("r.docx", bytearray(docx(("Heading1", "Title"), ("", "Body")))), ("bad.docx", bytearray(b"zip?")), ("pic.png", bytearray(b"\x89P")),
        ("empty.txt", bytearray(b"")), ("null.log", None), ("big.txt", bytearray(b"x" * 200)), ("p.pdf", bytearray(b"%PDF")),
    ], "name string, content binary")
    got = {r["id"]: (r["text"], r["error"]) for r in files.ingest(up, max_bytes=1500).collect()}
    assert got["doc:notes#0"] == ("# A\nx", None) and got["doc:notes#1"][0] == "# B\ny" and got["doc:flat#0"][0] == "one\ntwo" and got["doc:r#0"][0].startswith("# Title")
    assert got["doc:pic"][0] == "pic.png" and got["doc:bad"][1] and got["doc:empty"][1] == got["doc:null"][1] == "no text" and got["doc:p"][1]
    assert files.ingest(up, max_bytes=100).filter("error = 'too large'").count() >= 1


def test_paragraphs_by_gap(spark):
    rows = [("d", 1, y, i, t) for i, (y, t) in enumerate([(100, "a"), (90, "b"), (60, "c"), (50, "d")])] + [("d", 2, 100, 0, "e")]
    df = spark.createDataFrame(rows, "doc_id string, page int, y int, nth int, text string")
    assert [r["text"] for r in files.lines_to_paragraphs(df).orderBy("paragraph").collect()] == ["a b", "c d", "e"]


PY = '''import os
from .util import helper as h

# about f
def f(a, b=2):
    """Doc."""
    if a and b:
        return helper(a)
    return [x for x in b if x]


class K(Base):
    @cached
    def m(self):
        return f(1)
'''
TS = """import { f as g } from './barrel.js';
/** Keeps. */
export async function keep(a: string): Promise<number> {
  // f('no')
  const s = `f(1) ${a}`;
  return a ? g(1) : other(2);
}
class A extends B {
  get size() { return this.list.map((x) => x.id()).length; }
  private async load<T>(p: T) { await new Thing(p); }
}
const arrow = async (x) => { call(x); };
type Q = { a: string };
interface I { b(): void }
"""


def test_parser():
    py = {(c.symbol, c.node_type, c.start, c.end, c.complexity) for c, _ in parse.chunks_of("py", PY)}
    assert ("f", "function_definition", 3, 8, 3) in py and ("K", "class_definition", 11, 14, 1) in py and ("m", "function_definition", 13, 14, 1) in py and (None, "preamble", 0, 15, 0) in py
    ts = {(c.symbol, c.node_type, c.start, c.end) for c, _ in parse.chunks_of("ts", TS)}
    assert {("keep", "function_declaration", 1, 6), ("A", "class_declaration", 7, 10), ("size", "method_definition", 8, 8), ("load", "method_definition", 9, 9), (None, "arrow_function", 11, 11), ("Q", "type_alias_declaration", 12, 12), ("I", "interface_declaration", 13, 13)} <= ts
    assert [(c, w) for _, c, w in parse.calls_of("ts", TS) if c in ("f", "g", "other", "Thing", "call")] == [("g", "keep"), ("other", "keep"), ("call", None)]
    assert {(c, w) for _, c, w in parse.calls_of("py", PY)} >= {("helper", "f"), ("cached", "K"), ("f", "m")}
    assert parse.imports_of("py", PY) == ["os", ".util", ".util.helper"] and parse.imports_of("ts", TS) == ["./barrel.js"]
    assert parse.signature_of("ts", TS.split("class A")[0].split("\n", 1)[1]) == "/** Keeps. */\nexport async function keep(a: string): Promise<number>"
    assert parse.signature_of("py", "    def m(self, x):\n        return 1\n") == "def m(self, x):" and parse.signature_of("md", "# x") is None
    assert parse.chunks_of("py", "def (:")[0][0].node_type == "file" and parse.chunks_of("ts", "{{")[0][0].node_type == "file" and parse.chunks_of("tsx", "x")[0][0].node_type == "file"
    assert parse.compress("x", "drop", symbol="n") == "n …" and parse.compress("# x", "signature", "md") == "# x"
    with pytest.raises(ValueError):
        parse.compress("x", "half")


def test_impact_with_alias(spark):
    docs = spark.createDataFrame([
        ("m.ts", "ts", "export function target() { return 1; }\nfunction lone() {}\n"), ("barrel.ts", "ts", "export { target as renamed } from './m.js';\n"),
        ("use.ts", "ts", "import { renamed } from './barrel.js';\nfunction go() { renamed(); }\n"), ("direct.ts", "ts", "// target\nfunction d() { target(); }\n"), (None, "ts", "target()"),
    ], "path string, format string, body string")
    chunks = parse.chunk_files(docs).withColumn("id", __import__("pyspark.sql.functions", fromlist=["x"]).xxhash64("path", "nth")).cache()
    calls = parse.call_sites(docs)
    known = docs.select("path")
    edge = lambda df: df.join(graph.resolve_imports(df.select("path", "specifier"), known).selectExpr("src_path AS path", "dst_path AS to"), "path")
    re = edge(parse.reexports(docs)).selectExpr("path AS barrel", "symbol", "alias")
    bind = edge(parse.import_bindings(docs)).selectExpr("path", "to AS barrel", "alias", "local")
    alias = graph.alias_callers(re, bind, calls)
    got = {r["symbol"]: r for r in graph.impact(chunks, docs, calls, chunks.select("id", "complexity"), alias_calls=alias).collect()}
    t = got["target"]
    assert (t["mentions"], t["confirmed"], t["risk"]) == (3, 2, "medium") and "renamed" in t["hedges"][0]
    assert got["lone"]["ref_count"] == 0 and "not shown to be unused" in got["lone"]["hedges"][-1] and got["go"]["callees"] == []


def test_engine(spark):
    ticks = iter(range(1_800_000_000_000, 1_900_000_000_000, 1000))
    heard, seen = [], []
    e = api.Engine(spark, session.fresh_dir(spark, "e"), clock=lambda: next(ticks), gate=lambda a: "deny" if "secret" in a["text"] else "allow", audit=heard.append, trace=api.Trace())
    e.trace.tap("remember", seen.append)
    e.remember("fact:a", "the cache layer leaks memory", "fact")
    e.remember("fact:a", "the cache layer leaks memory again", "fact", scope="x")
    with pytest.raises(api.WriteDenied):
        e.remember("fact:s", "secret", "fact")
    assert len(heard) == 3 and heard[-1]["decision"] == "deny" and len(seen) == 2
    hits = e.recall("memory leaks", ("fact",), scope=GLOBAL).collect()
    assert [(r["id"], r["use"]) for r in hits] == [("fact:a", 0)] and e.recall("memory leaks", ("fact",), scope=GLOBAL).first()["use"] == 1
    assert e.get("fact:a") == "the cache layer leaks memory again" and e.get("fact:a", GLOBAL).endswith("memory") and e.get("nope") is None
    assert e.scoped("x").count() == 2 and e.count(GLOBAL) == 1
    assert e.ingest("n.md", b"# A\nx\n# B\ny") == ["doc:n#0", "doc:n#1"] and e.ingest("n.md", b"# A\nz") == ["doc:n#0"]
    assert e.enumerate("doc")["total"] == 1
    with pytest.raises(files.UploadRejected):
        e.ingest("n.txt", b"")
    e.stash("s", "y" * 300)
    assert e.peek("s")["truncated"] and e.evict(id="s") == 1 and e.peek("s") is None
    assert e.forget(id="fact:a", scope="x") == 1 and e.count() == 2
    store = api.StoreAdapter(e)
    key = store.store("a durable note on queues", {"kind": "fact", "topic": 1})
    assert store.get(key)["metadata"] == {"topic": 1, "kind": "fact", "by": "agent"} and store.search("queues note")[0]["id"] == key and store.delete(key) and store.get(key) is None
    assert e.trace.edges()[0] == ("n1", "n2") and "flowchart" in e.trace.mermaid()
    with pytest.raises(ScopeRequired):
        api.Engine(spark, session.fresh_dir(spark, "e"), strict=True).recall("x")
    with pytest.raises(AttributeError):
        e.scoped("x").purge
    with pytest.raises(ValueError):
        api.Engine(spark, "x", episode_days=0)


def test_a_build_that_dies_between_two_commits_repeats_no_edit(spark, tmp_path):
    from cairnlake.index import SourceIndex
    from cairnlake.operators.incremental import VersionedTable

    src = tmp_path / "src"
    src.mkdir()
    for p in ("a.py", "b.py"):
        (src / p).write_text(f"def {p[0]}(x):\n    return x\n")
    x = SourceIndex(spark, session.fresh_dir(spark, "index"), str(src))
    x.build()
    commits, publish = [], VersionedTable._publish
    for at in range(1, 6):  # edits, nodes, calls, imports, files: the build dies after each of them
        (src / "a.py").write_text(f"def a(x):\n    return x + {at}\n")

        def dies(self, m, at=at):
            commits.append(self.root)
            v = publish(self, m)
            if len(commits) == at:
                raise RuntimeError("lost")
            return v

        commits.clear()
        VersionedTable._publish = dies
        try:
            with pytest.raises(RuntimeError):
                x.build()
        finally:
            VersionedTable._publish = publish
        x.build()
        assert [(r["path"], r["symbol"]) for r in x.edit_log().collect()] == [("a.py", "a")] * at
        assert {r["body"] for r in x.nodes.read().filter("path = 'a.py'").collect()} == {f"def a(x):\n    return x + {at}"}
    assert x.recent_activity().first()["symbol"] == "a" and [r["path"] for r in x.files_with("def b").collect()] == ["b.py"]


def test_docx_lists_tables_and_links():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    say = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    item = lambda x: f'<w:p><w:pPr><w:numPr/></w:pPr>{say(x)}</w:p>'
    cell = lambda x: f"<w:tc><w:p>{say(x)}</w:p></w:tc>"
    body = f'<w:p>{say("See ")}<w:hyperlink r:id="r1">{say("here")}</w:hyperlink></w:p>{item("one")}{item("two")}<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl><w:p/>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="http://x.test/" TargetMode="External"/></Relationships>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
    assert files.docx_markdown(buf.getvalue()) == "See [here](http://x.test/)\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from cairnlake import cli

    monkeypatch.setattr(session, "build", lambda *a, **k: spark)
    monkeypatch.setattr(session, "release", lambda s: 0)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def used(x):\n    return x\n\n\ndef go():\n    return used(1)\n")
    run = lambda *a: (cli.main(["--root", str(tmp_path / "root"), *a]), capsys.readouterr().out)
    assert run("index", str(tmp_path / "src")) == (0, "upsert\t1\ntouch\t0\nunchanged\t0\ndeleted\t0\n")
    code, out = run("impact", str(tmp_path / "src"), "used")
    assert code == 0 and out.startswith("used\tlow\t1\t1\t")
    assert run("promotions") == (0, "") and "usage" in run("help")[1]


def test_release_deletes_what_was_handed_out(spark):
    kept = dict(session._made)
    session._made.clear()
    path = session.fresh_dir(spark, "gone").removeprefix("file://")
    session.materialize(spark.range(3).toDF("n"), "gone")
    os.makedirs(path, exist_ok=True)
    assert session.release(spark) == 2 and not os.path.exists(path) and session.release(spark) == 0
    session._made.update(kept)


def test_tenants_share_nothing_but_the_shared_tier(spark):
    root, ticks = session.fresh_dir(spark, "e"), iter(range(1_800_000_000_000, 1_900_000_000_000, 1000))
    made = lambda **k: api.Engine(spark, root, clock=lambda: next(ticks), **k)
    a, b = made(owner="a", session="s1"), made(owner="b", strict=True, session="s2")
    a.remember("fact:x", "alpha keeps the queue short", "fact")
    b.remember("fact:x", "beta keeps the queue long", "fact")
    a.remember("fact:only-a", "the queue of alpha", "fact")
    a.remember("ep:1", "queue drained", "episode")
    made(session="s3").remember("ep:2", "queue filled", "episode", scope="b")
    host = api.StoreAdapter(b)
    assert host.get("fact:x")["text"].startswith("beta") and host.get("fact:only-a") is None
    assert {r["id"] for r in host.search("queue")} == {"fact:x"} and host.search("queue")[0]["text"].startswith("beta")
    # demand is a row's own, not that of its id
    assert [(r["id"], r["use"]) for r in a.recall("queue", ("fact",), log=False).orderBy("id").collect()] == [("fact:only-a", 0), ("fact:x", 0)]
    assert b.recall("queue", ("fact",), log=False).first()["use"] == 2
    # episodes of another session are neither counted nor listed
    assert b.count(kinds=("episode",)) == 0 and b.enumerate("episode")["total"] == 0 and a.count(kinds=("episode",)) == 1
    with pytest.raises(ScopeRequired):
        made(strict=True).ingest("n.md", b"# A")
    assert b.ingest("n.md", b"# A\ntext of b") == ["doc:n#0"] and a.get("doc:n#0") is None and b.get("doc:n#0") is not None
    assert b.node("fact:x") == {"path": "fact:x", "kind": "fact", "format": "md", "chunks": [], "imports": 0, "imported_by": 0} and b.node("doc:n#0") is None
    assert [(r["id"], r["hits"]) for r in b.review(threshold=2).collect()] == [("fact:x", 2)] and a.review(threshold=1).count() == 0
    assert b.promotions(threshold=1).count() == 0


def test_recall_has_two_domains_and_nominees(spark):
    ticks = iter(range(1_800_000_000_000, 1_900_000_000_000, 1000))
    asked = []

    def embed(text):
        asked.append(text)
        return [float("cat" in text or "feline" in text), float("dog" in text), 0.1]

    e = api.Engine(spark, session.fresh_dir(spark, "e"), clock=lambda: next(ticks), embed=embed)
    for i, t in enumerate(("caching answers helps", "a feline sleeps", "dogs bark", "nothing at all", "the answer")):
        e.remember(f"fact:{i}", t, "fact")
    e.ingest("n.md", b"# A\ncaching answers")
    got = {r["id"]: r for r in e.recall("cached answers of a cat", ("fact",), log=False).collect()}
    assert got["fact:0"]["score"] > got["fact:4"]["score"] > 0  # stems: cached meets caching
    assert got["fact:1"]["score"] == 0 and got["fact:1"]["cosine"] > 0.9  # a nominee by cosine alone
    docs = e.recall("cached answer", ("doc",), log=False)
    assert docs.count() == 0 and e.recall("answers", ("doc",), log=False).first()["cosine"] is None  # no stems among documents
    before = len(asked)
    e.recall("answers", ("doc",), log=False)
    assert len(asked) == before  # the vector of a query is kept


def test_javascript_resolution_order_and_aliases(spark):
    known = spark.createDataFrame([(p,) for p in ("w/a.js", "w/a.ts", "w/d/index.ts", "w/d/index.mjs", "src/lib/x.ts", "src/ui/index.ts", "w/o.tsx")], "path string")
    want = {"./a": "w/a.js", "./d": "w/d/index.mjs", "@lib/x": "src/lib/x.ts", "@ui": "src/ui/index.ts", "./o": "w/o.tsx", "react": None}
    said = spark.createDataFrame([("w/m.ts", s) for s in want], "path string, specifier string")
    got = {r["specifier"]: r["target"] for r in graph.resolve_targets(said, known, [("@ui", "src/ui/index.ts"), ("@lib/*", "src/lib/*")]).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert set(graph.resolve_targets(said, known).toPandas()["specifier"]) == {"./a", "./d", "./o"}


def test_aliases_of_paths():
    a = api.load_ts_paths('{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@ui": ["./ui/index.ts"], "@lib/*": ["lib/*"],}} }')
    assert api.apply_alias("@lib/x/y", a) == "src/lib/x/y" and api.apply_alias("react", a) is None


def test_threshold_stream(spark, tmp_path):
    schema = "id long, path string, kind string, symbol string, action string, ts long"
    spark.createDataFrame([(i, "a" if i % 3 else "b", "fact", None, "RECALL" if i != 5 else None, 1_790_000_000_000 + i) for i in range(12)], schema).write.parquet(str(tmp_path / "log"))
    s = logs.threshold_crossings(logs.timed(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))), 5)
    got = []
    q = logs.into(s, str(tmp_path / "ck"), lambda df, _: got.extend(map(tuple, df.collect())))
    q.awaitTermination()
    assert got == [("a", 8)]


def test_source_index(spark, tmp_path):
    from cairnlake.index import SourceIndex, StalePointer

    src = tmp_path / "src"
    for p, b in {"app/cache.py": PY, "app/util.py": "def helper(x):\n    return x\n", "web/m.ts": "export function target() { return 1; }\n", "web/barrel.ts": "export { target as renamed } from './m';\n",
                 "web/use.ts": "import { renamed } from './barrel';\nfunction go() { renamed(); }\n", "README.md": "# Cache\nhow the helper works\n"}.items():
        os.makedirs(src / os.path.dirname(p), exist_ok=True)
        (src / p).write_text(b)
    x = SourceIndex(spark, session.fresh_dir(spark, "index"), str(src), embed=lambda t: [float("helper" in t), 1.0])
    assert x.build() == {"upsert": 6, "touch": 0, "unchanged": 0, "deleted": 0}
    assert x.build() == {"upsert": 0, "touch": 0, "unchanged": 6, "deleted": 0}
    os.utime(src / "web/m.ts", (1, 1))
    (src / "app/util.py").write_text("def helper(x):\n    return x + 1\n")
    (src / "web/use.ts").unlink()
    assert x.build() == {"upsert": 1, "touch": 1, "unchanged": 3, "deleted": 1}
    assert [(r["path"], r["symbol"]) for r in x.edits.read().collect()] == [("app/util.py", "helper")]
    assert {(r["src_path"], r["dst_path"]) for r in x.edges().collect()} == {("app/cache.py", "app/util.py"), ("web/barrel.ts", "web/m.ts")}
    hit = x.recall("what does helper return").first()
    assert hit["path"] in ("app/util.py", "app/cache.py") and hit["symbol"] and hit["fused"] is not None
    assert x.recall("helper", kind="doc").first()["path"] == "README.md"
    assert [r["id"] for r in x.related("app/cache.py").collect()] == ["app/util.py"] and x.node("app/util.py").first()["imported_by"] == 1
    (src / "web/use.ts").write_text("import { renamed } from './barrel';\nfunction go() { renamed(); }\n")
    x.build()
    t = x.impact("target").first()
    assert t["confirmed"] == 1 and "renamed" in t["hedges"][0]
    assert x.chunk("app/util.py", 0, 0) == "def helper(x):" and x.chunk("nope.py", 0, 0) is None
    (src / "app/util.py").write_text("changed")
    with pytest.raises(StalePointer):
        x.chunk("app/util.py", 0, 0)
