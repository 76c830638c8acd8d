import random

import pytest

from cairnlake.functions import parse
from cairnlake.operators import folds, memory
from cairnlake.operators.fences import GLOBAL
from pyspark.sql import functions as F

UNITS = "conv_id int, turn int, " + folds.UNIT


def unit(conv, turn, tokens, **k):
    d = {"id": f"{conv}-{turn}", "role": "user", "content": "x", "kind": None, "format": None, "symbol": None, "pinned": None, "atomic": None, "tokensApprox": float(tokens), **k}
    return (conv, turn, *(d[c] for c in ("id", "role", "content", "kind", "format", "symbol", "pinned", "atomic", "tokensApprox")))


def loop(rows, budget):
    used = sum(r[-1] for r in rows if r[8])
    kept = {r[1] for r in rows if r[8]}
    items = {}
    for r in rows:
        if not r[8]:
            items.setdefault(r[9] or f"u{r[1]}", []).append(r)
    forced = {r[9] for r in rows if r[8] and r[9]}
    for k, members in sorted(items.items(), key=lambda x: -max(m[1] for m in x[1])):
        t = sum(m[-1] for m in members)
        if k in forced or used + t <= budget:
            used += t
            kept |= {m[1] for m in members}
    return kept


def test_assemble_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [unit(c, t, rng.randint(0, 40), pinned=rng.random() < 0.1 or None, atomic=rng.choice([None, None, "g", "h"])) for c in range(40) for t in range(rng.randint(1, 15))]
    got = folds.assemble(spark.createDataFrame(rows, UNITS), 100)
    kept = {}
    for r in got.filter("kept").collect():
        kept.setdefault(r["conv_id"], set()).add(r["turn"])
    for c in range(40):
        assert kept.get(c, set()) == loop([r for r in rows if r[0] == c], 100), c
    assert got.count() == len(rows)
    assert folds.assemble(spark.createDataFrame(rows, UNITS), None).filter("NOT kept").count() == 0
    assert folds.assemble(spark.createDataFrame([], UNITS), 10).count() == 0


def test_assemble_rescues_signatures(spark):
    body = "def f(a):\n" + "    x = 1\n" * 60
    rows = [unit(1, 1, 160, content=body, kind="code", format="py"), unit(1, 2, 30)]
    got = {r["turn"]: r for r in folds.assemble(spark.createDataFrame(rows, UNITS), 40, parse.signature_column).collect()}
    assert got[1]["compressed"] and got[1]["content"] == "def f(a):" and got[1]["tokens"] == 3 and got[2]["tokens"] == 30


def test_summary_window(spark):
    rows = [unit(1, 0, 20, pinned=True), *(unit(1, t, 60, content=f"DECISION-{t}") for t in (1, 2, 3)), unit(1, 4, 30), unit(1, 5, 30)]
    df = spark.createDataFrame(rows, UNITS)
    got = {r["id"]: (r["kept"], r["reason"]) for r in folds.summary_window(df, 160, lambda m: " ".join(x["content"] for x in m), keep=2).collect()}
    assert got["1-1"] == got["1-3"] == (False, "summarized") and got["summary:1-1..1-3"][0] and got["1-5"][0] and got["1-0"][0]
    plain = {r["id"]: r["kept"] for r in folds.summary_window(df, 160, lambda m: "", keep=2).collect()}
    assert plain == {r["id"]: r["kept"] for r in folds.assemble(df, 160).collect()}


def test_trim(spark):
    rows = [unit(1, t, 1, atomic="g" if t in (2, 3) else None, pinned=t == 0 or None) for t in range(6)]
    kept = lambda **k: {r["turn"] for r in folds.trim(spark.createDataFrame(rows, UNITS), **k).filter("kept").collect()}
    assert kept(keep_last=3) == {0, 2, 3, 4, 5} and kept(keep_last=0) == {0} and kept() == set(range(6)) and kept(max_tokens=3) == {0, 4, 5}


def test_packing(spark):
    rng = random.Random(1)
    docs = [(i, ["w" * rng.randint(1, 50) for _ in range(rng.randint(0, 20))]) for i in range(50)]

    def plain(ps, budget):
        out, cur = [], None
        for p in ps:
            if cur is not None and len(cur) + 1 + len(p) <= budget:
                cur += "\n" + p
            else:
                out += [cur] if cur is not None else []
                cur = p
        return out + ([cur] if cur is not None else [])

    got = dict(tuple(r) for r in spark.createDataFrame(docs, "i int, p array<string>").select("i", folds.pack_paragraphs(F.col("p"), 60)).collect())
    assert got == {i: plain(p, 60) for i, p in docs}


def test_sections_and_segments(spark):
    md = "intro\n\n# One\ntext\n## Two ##\nmore"
    df = spark.createDataFrame([("a", md), ("b", "no heading\nat all"), ("c", None), ("d", "\n\n# H")], "path string, body string")
    got = {(r["path"], r["node_type"], r["symbol"], r["start_line"], r["end_line"]) for r in folds.sections(df, ["path"]).collect()}
    assert got == {("a", "preamble", None, 0, 1), ("a", "section", "One", 2, 3), ("a", "section", "Two", 4, 5), ("b", "file", None, 0, 1), ("d", "section", "H", 2, 2)}
    assert {(r["path"], r["segment"]) for r in folds.segments(df, ["path"]).collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("d", 0)}


ROWS = "seq long, op string, owner string, id string, kind string, provenance string, created_at long, occurred_at long, expires_at long, text string"


def test_op_log(spark):
    ops = spark.createDataFrame([
        (1, "put", None, "fact:a", "fact", "agent", 1, None, None, "old"), (2, "put", None, "fact:a", "fact", "agent", 2, None, None, "new"), (3, "put", "x", "fact:a", "fact", "human", 3, None, None, "mine"),
        (4, "put", None, "fact:b", "fact", "agent", 4, None, 50, "gone"), (5, "del", None, "fact:b", "fact", None, None, None, None, None), (6, "put", "x", "doc:d#0", "doc", "human", 5, None, 9, "d"),
    ], ROWS)
    rows = memory.current(ops)
    assert {(r["owner"], r["id"], r["text"]) for r in rows.collect()} == {(None, "fact:a", "new"), ("x", "fact:a", "mine"), ("x", "doc:d#0", "d")}
    gone = lambda **k: {(r["owner"], r["id"]) for r in memory.forget(rows, 9, **k).collect()}
    assert gone(id="doc:d") == {("x", "doc:d#0")} and gone(kind="fact", scope=GLOBAL) == {(None, "fact:a")} and gone(by="human") == {("x", "fact:a"), ("x", "doc:d#0")}
    for bad in ({}, {"by": "human", "scope": "x"}):
        with pytest.raises(ValueError):
            memory.forget(rows, 9, **bad)
    assert [r["id"] for r in memory.purge(rows, 9, 7).collect()] == ["doc:d#0"] and memory.purge(rows, 8, 7).count() == 0
    log = spark.createDataFrame([("fact:b", 4), ("fact:b", 6), ("fact:a", 1)], "path string, seq long")
    assert sorted(tuple(r) for r in memory.history(log, ops).collect()) == [("fact:a", 1), ("fact:b", 6)]


def test_demand(spark):
    log = spark.createDataFrame([(1, "a", "fact", None, "RECALL", 1_700_000_000), (1, "a", "fact", None, "RECALL", 1_700_000_000), (2, "a", "fact", None, None, 1_700_000_000_001), (3, "a", "fact", None, "fetch", 5)], "id long, path string, kind string, symbol string, action string, ts long")
    d = memory.demand(log)
    assert {(r["id"], r["action"], r["ts"]) for r in d.collect()} == {(1, "recall", 1_700_000_000_000), (2, "recall", 1_700_000_000_001), (3, "fetch", 5000)}
    mem = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {tuple(r) for r in memory.use_counts(mem, d).collect()} == {("a", 2), ("b", 0)}


def test_evict(spark):
    s = spark.createDataFrame([(str(i), i) for i in range(6)], "id string, created_at int")
    assert {r["id"] for r in memory.evict(s, older_than=2, keep_newest=3).collect()} == {"0", "1", "2"}
    assert [r["id"] for r in memory.evict(s, id="4").collect()] == ["4"]
