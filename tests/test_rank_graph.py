import math
from collections import Counter

import pytest

from cairnlake.functions.text import ident_words
from cairnlake.operators import graph, lexical, rank
from cairnlake.operators.fences import GLOBAL, ScopeRequired, fence_of, live, owned
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("a", "red apple pie".split()), ("b", "apple tree".split()), ("c", []), ("d", "blue sky apple apple".split()), ("e", ["unrelated"]), ("f", ["pie"])]
    return spark.createDataFrame(rows, "path string, tokens array<string>"), dict(rows)


def brute_bm25(docs, terms):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for t in terms for d in docs.values() if t in d)
    out = {}
    for k, d in docs.items():
        if any(t in d for t in terms):
            out[k] = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if t in d)
    return out


def test_bm25(spark, corpus):
    df, docs = corpus
    got = {r["path"]: r["score"] for r in lexical.bm25(df, ["apple", "pie"]).collect()}
    want = brute_bm25(docs, ["apple", "pie"])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    kept = {r["path"]: r["score"] for r in lexical.bm25(df, ["apple", "pie"], F.col("path") == "a").collect()}
    assert kept == {"a": got["a"]}  # statistics don't shrink with the filter
    many = lexical.bm25_many(lexical.postings(df, ["path"]), lexical.corpus_stats(df), spark.createDataFrame([("q", ["apple", "pie", "apple"])], "query_id string, terms array<string>"), ["path"])
    assert {r["path"]: round(r["score"], 9) for r in many.collect()} == {k: round(v, 9) for k, v in want.items()}
    words = spark.createDataFrame([(k, " ".join(v).upper()) for k, v in docs.items()] + [("null", None)], "path string, t string").select("path", ident_words(F.col("t")).alias("words"))
    other = {r["path"]: r["score"] for r in lexical.bm25(words, ["apple", "pie"]).collect()}
    want = brute_bm25(docs | {"null": []}, ["apple", "pie"])
    assert other.keys() == want.keys() and all(abs(other[k] - want[k]) < 1e-12 for k in want)
    assert lexical.bm25(words.limit(0), ["apple"]).count() == 0 and lexical.bm25(df, []).count() == 0 and lexical.bm25(df.limit(0), ["x"]).count() == 0


def test_fences(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", "x", 5), ("c", "y", 10)], "id string, owner string, e int")
    ids = lambda f: [r["id"] for r in rows.filter(owned(F.col("owner"), f) & live(F.col("e"), f.now)).orderBy("id").collect()]
    assert ids(fence_of()) == ["a", "b", "c"] and ids(fence_of("x")) == ["a", "b"] and ids(fence_of(GLOBAL)) == ["a"]
    assert ids(fence_of(now=5)) == ["a", "c"]
    with pytest.raises(ScopeRequired):
        fence_of(None, strict=True)
    with pytest.raises(ValueError):
        fence_of("")


def test_spread_lifts_a_neighbour(spark):
    pool = spark.createDataFrame([("a", 4.0), ("b", 2.0), ("c", 3.0)], "path string, score double")
    edges = spark.createDataFrame([("import", "b", "a"), ("import", "b", "a"), ("import", "c", "z"), ("import", "c", "c"), (None, None, "a")], "type string, src_path string, dst_path string")
    got = {r["path"]: (r["bm25"], round(r["score"], 6)) for r in rank.spread(pool, edges).collect()}
    assert got == {"a": (4.0, 1.0), "b": (2.0, 0.3), "c": (3.0, 0.5)}
    assert rank.spread(pool.limit(1), edges).first()["score"] == pool.limit(1).first()["score"]


def test_fusion(spark):
    pool = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "path string, score double")
    near = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("k", 0.8), ("m", -0.2)], "path string, cosine double")
    extra = rank.nominees(near, pool, 5)
    assert [r["path"] for r in extra.collect()] == ["k"]
    got = {r["path"]: round(r["fused"], 6) for r in rank.fuse(pool, near, extra).collect()}
    assert got == {"a": 1.0, "b": 1.0, "k": 0.875}
    assert rank.fuse(pool.limit(1), near).first()["fused"] is None


def test_related(spark):
    e = spark.createDataFrame([("import", "a", "b"), ("import", "b", "c"), ("import", "d", "a"), ("import", "c", "a"), ("import", "c", "e"), ("import", "x", None), ("call", "a", "q")], "type string, src_path string, dst_path string")
    seeds = spark.createDataFrame([("a",), ("a",), ("zz",)], "seed string")
    walk = lambda **k: {(r["id"], r["hops"], r["via"]) for r in graph.related(e, seeds, **k).filter("seed = 'a'").collect()}
    assert walk(hops=1) == {("b", 1, "out"), ("d", 1, "in"), ("c", 1, "in")}
    assert walk(hops=9, direction="out") == {("b", 1, "out"), ("c", 2, "out"), ("e", 3, "out")}
    assert graph.truncated(9) and not graph.truncated(3)
    assert graph.related(e.limit(0), seeds, 2).count() == 0
    with pytest.raises(ValueError):
        graph.related(e, seeds, direction="up")


def test_degrees_and_views(spark):
    e = spark.createDataFrame([(1, "import", "a", "b"), (2, "import", "a", "b"), (3, "import", "a", "c")], "id int, type string, src_path string, dst_path string")
    assert {tuple(r) for r in graph.degrees(e).collect()} == {("a", 2, 0), ("b", 0, 1), ("c", 0, 1)}
    n = spark.createDataFrame([(1, "a", "code", "py", "f", "function_definition", 0, 1)] * 2, "id long, path string, kind string, format string, symbol string, node_type string, start_line int, end_line int")
    v = graph.node_views(n, e).first()
    assert len(v["chunks"]) == 1 and (v["imports"], v["imported_by"]) == (2, 0)


def test_resolve_imports(spark):
    paths = spark.createDataFrame([(p,) for p in ("pkg/a.py", "pkg/sub/b.py", "pkg/sub/__init__.py", "web/x.ts", "web/lib/index.js", "web/y.ts")], "path string")
    specs = spark.createDataFrame([("pkg/sub/b.py", "..a"), ("pkg/a.py", "pkg.sub.b"), ("pkg/a.py", ".sub"), ("pkg/a.py", "os"), ("pkg/a.py", "pkg.a"), ("web/x.ts", "./lib"), ("web/x.ts", "./y.js"), ("web/x.ts", "react"), ("web/x.ts", "../../up"), (None, "./y")], "path string, specifier string")
    assert {(r["src_path"], r["dst_path"]) for r in graph.resolve_imports(specs, paths).collect()} == {
        ("pkg/sub/b.py", "pkg/a.py"), ("pkg/a.py", "pkg/sub/b.py"), ("pkg/a.py", "pkg/sub/__init__.py"), ("web/x.ts", "web/lib/index.js"), ("web/x.ts", "web/y.ts")}


def test_localize_prefers_leaf_and_names_the_unnamed(spark):
    n = spark.createDataFrame([
        (1, "p", "Big", "class_declaration", 0, 20, "alpha beta"), (2, "p", "small", "method_definition", 2, 5, "alpha beta"), (3, "p", None, "arrow_function", 8, 9, "alpha beta gamma"),
        (4, "q", "only", "section", 0, 3, "nothing"),
    ], "id long, path string, symbol string, node_type string, start_line int, end_line int, body string")
    hits = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [tuple(r) for r in rank.localize(hits, n, ["alpha", "beta", "gamma"]).collect()] == [("p", "Big", "class_declaration", 0, 20)]
    assert [r["symbol"] for r in rank.localize(hits, n, ["alpha", "beta"]).collect()] == ["small"]


def test_quality(spark):
    q = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")
    r = rank.retrieval_quality(q).first()
    assert abs(r["mrr"] - (1 + 0.25) / 3) < 1e-12 and abs(r["p_at_5"] - 2 / 3) < 1e-12
    a = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.8, True)], "s double, y boolean")
    assert abs(rank.auc(a, "s", "y").first()["auc"] - 0.875) < 1e-12


def test_change_impact_asks_every_symbol_and_renamed_callers(spark, tmp_path):
    from cairnlake.plans import code

    files = {
        "a/core.js": "export function build(x) {\n  return x;\n}\n",
        "a/index.js": "export { build as make } from './core.js';\n",
        "a/use.js": "import { make } from './index.js';\nexport function run() {\n  return make(1);\n}\n",
    }
    docs = spark.createDataFrame([(p, "code", "js", b) for p, b in files.items()], "path string, kind string, format string, body string")
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    got = {r["symbol"]: r for r in code.change_impact(spark, str(tmp_path)).collect()}
    assert {"build", "run"} <= set(got)
    assert got["build"]["confirmed"] == 1 and "make" in got["build"]["hedges"]
