from pyspark.sql import functions as F

from cairnlake.functions import stem
from cairnlake.functions import text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_identifiers(spark):
    assert one(spark, T.split_ident, "getUserData base_level a.b/c9D") == ["get", "user", "data", "base", "level", "a", "b", "c9", "d"]
    assert one(spark, T.split_ident, "café Straße") == ["caf", "stra", "e"]
    assert one(spark, T.split_ident, "") == []
    assert one(spark, T.camel_parts, "getUserData = Plain + snake_case + getUserData") == ["get", "user", "data"] * 2


def test_unicode_words(spark):
    assert one(spark, T.unicode_tokens, "café Straße base_level getUserData") == ["cafe", "straße", "base", "level", "getuserdata"]


def test_keywords(spark):
    q = "How does the Session token rotate? session TOKEN id"
    assert one(spark, T.keywords, q) == T.query_terms(q) == ["session", "token", "rotate"]
    assert T.match_expression(q) == '"session" OR "token" OR "rotate"'
    assert T.match_expression("of it") is None and T.query_terms("") == []


def test_kinds(spark):
    assert one(spark, T.classify_path, "a/b.TSX").asDict() == {"kind": "code", "format": "ts"}
    assert one(spark, T.classify_path, "x.md").asDict() == {"kind": "doc", "format": "md"}
    assert one(spark, T.classify_upload, "n.markdown").asDict() == {"route": "markdown", "format": "md"}
    assert one(spark, T.classify_upload, "n.p@d").asDict() == {"route": "blob", "format": "bin"}
    assert one(spark, T.derive_doc_id, "My Notes (v2).PDF") == "doc:my-notes-v2"


def test_numbers(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [1.0])], "a array<float>, b array<float>, c array<float>")
    r = row.select(T.cosine(F.col("a"), F.col("b")).alias("x"), T.cosine(F.col("a"), F.col("c")).alias("y"), T.cosine(F.col("a"), F.lit(None).cast("array<float>")).alias("z")).first()
    assert abs(r["x"] - 0.6) < 1e-6 and r["y"] == 0 and r["z"] == 0
    n = spark.createDataFrame([(3.5, "x"), (-1.0, "abcde"), (float("nan"), None)], "t double, c string")
    assert [r[0] for r in n.select(T.tokens_of(F.col("t"), F.col("c"))).collect()] == [3.5, 2.0, 0.0]
    assert one(spark, T.relative_age, 90 * 60_000, "long") == "1h" and one(spark, T.risk, 11, "int") == "high"
    p = one(spark, T.peek, "ä" * 241)
    assert (len(p["head"]), len(p["tail"]), p["chars"], p["bytes"], p["truncated"]) == (160, 80, 241, 482, True)
    assert one(spark, T.peek, "short")["tail"] is None


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "refunds": "refund", "cached": "cach", "caching": "cach", "migrations": "migrat", "retried": "retri", "deploys": "deploi", "deployment": "deploy", "sky": "sky", "is": "is"}
    assert {w: stem.stem(w) for w in pairs} == pairs
