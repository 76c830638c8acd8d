import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import fusion, handwritten, neighbours, packing, queries, splitting, subjects, tokens

FOLDER = os.environ.get("TOKENIZERS", tokens.TOKENIZERS)
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, data):
    QUERIES[name](spark, data).collect()


# --- neighbours

VEC = "path string, dim int, vec array<float>, h string, key int"


def brute(rows, k, least):
    ok = {}
    for p, d, v, *_ in rows:
        if p is None or v is None or d != len(v) or any(x is None or x != x for x in v) or not any(v):
            continue
        ok[p] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    out = set()
    for p, v in ok.items():
        near = sorted(((-float(v @ w), q) for q, w in ok.items() if q != p and len(w) == len(v)))[:k]
        out |= {(min(p, q), max(p, q)) for c, q in near if -c >= least}
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(40):
        centre = rng.standard_normal(32)
        for i in range(rng.integers(1, 6)):
            v = centre + 0.1 * rng.standard_normal(32)
            rows.append((f"g{g}/{i}", 32, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], "x", 1))
    rows += [(f"s{i}", 8, [float(np.float32(x)) for x in rng.standard_normal(8)], "x", 1) for i in range(30)]
    rows += rows[:20] + [(None, 2, [1.0, 1.0], "", 0), ("n", 2, None, "", 0), ("e", 0, [], "", 0), ("z", 2, [0.0, 0.0], "", 0), ("nan", 2, [1.0, float("nan")], "", 0), ("hole", 2, [1.0, None], "", 0), ("dim", 3, [1.0, 1.0], "", 0), ("nodim", None, [1.0], "", 0)]
    df = spark.createDataFrame(rows, VEC)
    want = brute(rows, 3, 0.9)
    assert len(want) > 50
    assert {tuple(r) for r in neighbours.similar_pairs(df, 3, 0.9).collect()} == want
    assert {tuple(r) for r in neighbours.similar_pairs(df, 3, 0.9, bucket_cap=3).collect()} == want  # split buckets
    assert {tuple(r) for r in neighbours.similar_pairs(df, 3, 0.9, probes=1).collect()} == want


@pytest.mark.parametrize("bits", [None, 12, 16, 20])
def test_codes_in_the_radius_meet_whatever_the_number_of_rows(spark, bits):
    """Differing bits spread evenly over the code are the worst case of an index on substrings."""
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for n, differ in enumerate((1, 20, 30, 41, 50, 57)):
        code = rng.integers(0, 2, 256, dtype=np.uint8)
        other = code.copy()
        other[(np.arange(differ) * 256) // differ] ^= 1
        for h, c in ((2 * n, code), (2 * n + 1, other)):
            rows.append((h, 32, *np.packbits(c, bitorder="little").view(np.int64).tolist()))
        want.add((2 * n, 2 * n + 1))
    df = spark.createDataFrame(rows, "h long, dim int, c0 long, c1 long, c2 long, c3 long")
    assert {tuple(r) for r in neighbours.candidate_pairs(df, 1 << 20, 0.88, bits=bits).collect()} == want


def test_certain_lookups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}/{i}", 16, [float(np.float32(x)) for x in c + 0.2 * rng.standard_normal(16)], "x", 1) for g in range(20) for c in [rng.standard_normal(16)] for i in range(4)]
    assert {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), 3, 0.9, certain=True).collect()} == brute(rows, 3, 0.9)


@pytest.mark.parametrize("width", neighbours.WIDTHS)
def test_recall_at_the_least_cosine_whatever_the_width(width):
    """Pairs at exactly 0.88, of vectors that fit nothing, meet in a table and lie within the radius."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.standard_normal((30, 64)))
    x = unit(np.repeat(centres, rng.integers(20, 400, 30), axis=0) * 1.2 + 0.12 * rng.standard_normal((1, 64)))
    x = unit(x + 0.1 * rng.standard_normal(x.shape))
    rng.shuffle(x)
    test, r = x[-1000:], neighbours.fit_rotation(x[:-1000], 64, neighbours.Plan(0.88, 1, width))
    u = rng.standard_normal(test.shape)
    u = unit(u - (u * test).sum(1, keepdims=True) * test)
    a, b = r.bits(test), r.bits(unit(0.88 * test + math.sqrt(1 - 0.88**2) * u))
    met = neighbours._meet(neighbours._substrings(a, width) ^ neighbours._substrings(b, width), 1, width).any(1)
    assert (met & ((a != b)[:, : neighbours.CHECK].sum(1) <= r.radius)).mean() >= 0.92


def test_crowded_groups_keep_their_nearest(spark, monkeypatch):
    """One cluster of a third of the rows, groups above the limit: its members still find near ones."""
    rng = np.random.default_rng(4)
    c = rng.standard_normal(32)
    v = np.concatenate([c + 0.15 * rng.standard_normal((300, 32)), rng.standard_normal((600, 32))])
    rows = [(f"p{i:03d}", 32, [float(np.float32(x)) for x in row], "x", 1) for i, row in enumerate(v)]
    want = brute(rows, 5, 0.88)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), 5, 0.88, bucket_cap=16).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_many_copies_and_no_rows(spark):
    rows = [(f"c{i:03d}", 2, [1.0, 2.0], "", 0) for i in range(60)]
    got = neighbours.similar_vectors(spark.createDataFrame(rows, VEC), 3)
    by = {}
    for r in got.collect():
        by.setdefault(r["path"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert by["c000"] == [(1, "c001", 1.0), (2, "c002", 1.0), (3, "c003", 1.0)] and sorted(by["c059"]) == [(1, "c000", 1.0), (2, "c001", 1.0), (3, "c002", 1.0)] and len(by) == 60
    assert neighbours.similar_pairs(spark.createDataFrame([], VEC)).count() == 0


# --- tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.load("byte_bpe_50k", FOLDER)


def test_tree_equals_direct_encoding(enc):
    rng = random.Random(1)
    for _ in range(400):
        s = "".join(rng.choice(" \n\t'reslvdmt0129abcü漢🙂.,!  <|endoftext|>​\r") for _ in range(rng.randint(0, 500)))
        ids = enc.encode_ordinary(s)
        assert tokens.encode(enc, s, rng.randint(1, 30)) == ids
        assert tokens.decode(enc, ids) == s
    for s in (" " * 9000, "a" * 9000, "\n \n" * 3000, "don't " * 3000, "<|endoftext|>" * 800):
        assert tokens.encode(enc, s, 64) == enc.encode_ordinary(s)


def test_token_tables(spark, enc):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hello <|endoftext|>", 9), (3, "hello <|endoftext|>", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = sorted(map(tuple, tokens.token_ids(df, folder=FOLDER).collect()), key=repr)
    assert got == sorted([(1, []), (2, []), *[(3, enc.encode_ordinary("hello <|endoftext|>"))] * 2, (None, enc.encode_ordinary("x"))], key=repr)
    assert sorted(r["n"] for r in tokens.token_counts(df, folder=FOLDER).collect()) == sorted(len(x[1]) for x in got)
    assert tokens.token_ids(df.limit(0), folder=FOLDER).count() == 0


def test_long_texts_are_encoded_in_parts(spark, enc):
    """Where a text is cut into rows makes no difference to its ids."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(["word ", "  ", "\n", "don't", "12", "\u6f22", "\U0001f642", "e\u0301"]) for _ in range(300)) for _ in range(6)]
    texts += [" " * 500, "a" * 500, "short", "", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (7, 64, 1000):
        got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df, folder=FOLDER, part=part).collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
        assert {r["doc_id"]: r["n"] for r in tokens.token_counts(df, folder=FOLDER, part=part).collect()} == {i: len(x) for i, x in got.items()}


# --- containers


def test_plan_uses_up_the_histogram():
    rng = random.Random(2)
    for _ in range(15):
        cap = rng.choice([10, 100, 2048])
        h = Counter(rng.randint(1, cap) if rng.random() < 0.3 else rng.randint(1, max(1, cap // 8)) for _ in range(rng.randint(1, 3000)))
        plan = packing.plan_containers(h, cap)
        used = Counter()
        for have, many in plan:
            assert sum(n * q for n, q in have.items()) <= cap and many > 0
            for n, q in have.items():
                used[n] += q * many
        assert used == h
        total, containers = sum(n * q for n, q in h.items()), sum(m for _, m in plan)
        assert containers <= total / cap * 1.1 + sum(q for n, q in h.items() if n > cap / 2) + 2
    assert packing.plan_containers({}, 10) == []


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((20, 8)), np.maximum(rng.standard_normal(8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("block", [100_000, 50])
def test_containers(spark, block):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 7, 7, 7, 100, rng.randint(1, 99), 250]) for _ in range(800)]
    rows = [(i, n, 1) for i, n in enumerate(sizes)] + [(900, None, 1), (901, -3, 1), (902, 201, 1), (902, 201, 1)]
    got = packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n int, piece int"), 100, rank_block=block).collect()
    fill = Counter()
    for r in got:
        if r["size"]:
            fill[r["container_id"]] += r["size"]
        else:
            assert r["container_id"] is None
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    by = Counter()
    for r in got:
        by[r["doc_id"]] += r["size"]
        assert r["pieces"] == 1 or r["size"] == min(100, 201 if r["doc_id"] == 902 else 250, (201 if r["doc_id"] == 902 else 250) - r["first"])
    assert all(by[i] == n for i, n in enumerate(sizes)) and by[902] == 402 and by[900] == by[901] == 0
    assert sum(fill.values()) / 100 / len(fill) > 0.97
    assert packing.fill_containers(spark.createDataFrame([], "doc_id long, n int"), 100).count() == 0


# --- fusion

HIT = "hit_id long, query_id long, path string, score double, cosine double, position int"


def brute_fused(rows):
    one = {}
    for h, q, p, s, c, _ in rows:
        if (q, p) not in one or (h if h is not None else -1) > one[q, p][0]:
            one[q, p] = (h if h is not None else -1, s, c)
    out = {}
    for q in {k[0] for k in one}:
        mine = {p: v for (r, p), v in one.items() if r == q}
        real = lambda x: x is not None and x == x
        pos = lambda p, i: 1 + sum(real(v[i]) and v[i] > mine[p][i] for v in mine.values()) if real(mine[p][i]) else None
        for p in mine:
            a, b = pos(p, 1), pos(p, 2)
            out[q, p] = (a, b, round((1 / (60 + a) if a else 0) + (1 / (60 + b) if b else 0), 12))
    return out


@pytest.mark.parametrize("hot", [200_000, 20])
def test_fusion(spark, hot):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1.0, 2.0, float("nan"), 1e300, -1e300, float("inf"), rng.random(), rng.random()])
    rows = [(i, rng.choice([1, 1, 2, 3, None]), rng.choice([f"p{rng.randint(0, 60)}", None]), value(), value(), 7) for i in range(300)]
    rows += [(1000 + i, 9, f"k{i}", 5.0, None, 7) for i in range(30)] + rows[:10]
    got = fusion.fuse(spark.createDataFrame(rows, HIT), hot_rows=hot).collect()
    want = brute_fused(rows)
    assert {(r["query_id"], r["path"]): (r["pos_score"], r["pos_cosine"], round(r["fused"], 12)) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["position"] == 1 + sum(w[2] > round(r["fused"], 12) for k, w in want.items() if k[0] == r["query_id"])
    assert {(r["query_id"], r["path"]) for r in fusion.agreed(spark.createDataFrame(rows, HIT), hot_rows=hot).collect()} == {k for k, (a, b, _) in want.items() if a and b and a <= 3 and b <= 3}
    assert fusion.fuse(spark.createDataFrame([], HIT)).count() == 0


@pytest.mark.parametrize("hot", [200_000, 20])
def test_one_order_without_ties(spark, hot):
    rng = random.Random(12)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([None, f"p{rng.randint(0, 80):02d}"]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 0.5]), 7) for i in range(300)]
    rows += [(1000 + i, 9, f"k{i:02d}", None, None, 7) for i in range(40)] + rows[:10]
    want = {}
    for q in {k[0] for k in brute_fused(rows)}:
        mine = sorted((-v[2], k[1] is not None, k[1] or "", k[1]) for k, v in brute_fused(rows).items() if k[0] == q)
        want |= {(q, x[3]): n + 1 for n, x in enumerate(mine)}
    got = fusion.ranking(spark.createDataFrame(rows, HIT), hot_rows=hot).collect()
    assert {(r["query_id"], r["path"]): r["place"] for r in got} == want and len(got) == len(want)
    assert fusion.ranking(spark.createDataFrame([], HIT)).count() == 0


# --- splitting


def greedy(text, limit, overlap):
    """Cut by cut: the plain form of what pointer doubling derives at once."""
    at, strength = splitting.boundaries(text)
    step, n, cut, out = limit - overlap, len(text), overlap, []
    edge = [overlap, *(a for a in at.tolist() if a > overlap), n]
    marks = [(a, s) for a, s in zip(at.tolist(), strength.tolist()) if a > overlap] + [(x, -1) for a, b in zip(edge[:-1], edge[1:]) for x in range(a + step, b, step)]
    while n > cut + step:
        for level in (3, 2, 1, 0):
            best = [a for a, s in marks if s == level and cut + step // 2 < a <= cut + step]
            if best:
                break
        cut = max(best) if best else max(a for a, _ in marks if cut < a <= cut + step)
        out.append(cut)
    return [*out, n]


def test_pointer_doubling_equals_cut_by_cut():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word ", "x", "end. ", "line\n", "\n\n", "漢字。", "🙂 ", "longlonglong"]) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["a" * 1000, " " * 1000, "\n" * 500, "", "ab"]
    ends = splitting.cut_all(texts, 100, 20)
    for t, e in zip(texts, ends):
        assert e.tolist() == greedy(t, 100, 20)
    assert splitting.cut_all([]) == []


def test_pieces(spark):
    long = "para one. " * 30 + "\n\n" + "x" * 900 + "\r\nend"
    docs = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "short", 1), ("c", None, 1), ("d", "", 1), ("w", long, 1), (None, long, 1)], "path string, body string, text int")
    nodes = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 0, 2), (2, "a", 2, 99), (3, "a", 3, 1), (4, "a", None, 1), (5, "b", 0, 0), (6, "gone", 0, 9), (7, "a", 3, 3), (8, None, 0, 1), (9, "a", 50, 60)], "id long, path string, start_line int, end_line int")
    got = splitting.pieces_of(nodes, docs, 400, 50).collect()
    assert {(r["path"], r["node_id"]) for r in got} == {("a", 1), ("a", 2), ("w", -1)}
    whole = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        key = (r["path"], r["node_id"])
        assert len(r["text"]) == r["end"] - r["start"] <= 400
        assert r["piece"] == 0 or r["text"][:50] == whole[key][-50:]
        whole[key] = whole.get(key, "") + r["text"][50 if r["piece"] else 0 :]
    assert whole["w", -1] == long.replace("\r\n", "\n") and whole["a", 1] == long.split("\r\n")[0]
    assert splitting.pieces_of(nodes.limit(0), docs.limit(0), 400, 50).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(docs, ["path"], "body", 100, 60)


# --- files not written by hand


def test_svm_separates():
    rng = np.random.default_rng(7)
    rows = [(np.arange(5), rng.standard_normal(5) + (2 if i % 2 else -2)) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w = handwritten.train_svm(rows, y, np.ones(60), 5)
    assert all((w[i] @ v > 0) == (t > 0) for (i, v), t in zip(rows, y))


def test_handwritten(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("parcel ledger token cursor frame badge unit panel".split())
    files = []
    for i in range(240):
        repo = f"repo-{i % 12}"
        body = "\n".join(f"def {word()}_{rng.randint(0, 99)}(x):\n    if x > {rng.randint(0, 9)}:\n        return {word()}\n" for _ in range(6))
        files.append((f"{repo}/src/{word()}_{i}.py", body, False))
    for i in range(60):
        repo, n = f"repo-{i % 12}", rng.randint(10, 30)
        files.append((f"{repo}/gen/{word()}{i}.pb.ts", "export class R {\n" + "\n".join(f"  get a{k:03d}() {{ return this._f[{k}]; }}" for k in range(n)) + "\n}\n", True))
        files.append((f"{repo}/static/{word()}{i}.min.js", "".join(f"function {rng.choice('abc')}(x){{return x.{word()}?1:{k}}}" for k in range(60)), True))
        files.append((f"{repo}/data/{word()}{i}.py", "T = [\n" + "\n".join("    " + ", ".join(str(rng.randint(0, 999)) for _ in range(15)) + "," for _ in range(30)) + "\n]\n", True))
    hidden = [("repo-3/src/plain.ts", "export class R {\n" + "\n".join(f"  get b{k:03d}() {{ return this._f[{k}]; }}" for k in range(25)) + "\n}\n", True)]
    docs = spark.createDataFrame([(p, b, 1) for p, b, _ in files + hidden] + [("repo-1/src/null.py", None, 1), (None, "x", 1), ("elsewhere", "x", 1)], "path string, body string, kind int")
    index = spark.createDataFrame([(p, 1) for p, *_ in files + hidden] * 2 + [("repo-1/src/null.py", 1), ("repo-1/src/missing.py", 1), (None, 1)], "path string, size int")
    got = {r["path"]: r["kind"] for r in handwritten.score_files(index, docs).collect()}
    assert len(got) == len(files) + 3 and "elsewhere" not in got
    right = sum((got[p] is not None) == y for p, _, y in files)
    assert right >= 0.97 * len(files) and got["repo-3/src/plain.ts"] == "generated"
    assert all(r["kind"] is None for r in handwritten.score_files(index.filter("path LIKE 'repo-1/src/%'"), docs).collect())
    assert handwritten.score_files(index.limit(0), docs.limit(0)).count() == 0


def test_masks():
    p, b = handwritten.mask("r/node_modules/lib/a.min.js", "// @generated by x\nlet a;\n//# sourceMappingURL=a.js.map")
    assert not handwritten.giveaways(p, b)


# --- subjects


def test_sentences():
    assert subjects.sentences("## Part 3\n- One point. Two points!\n[08:00] user: Three​x here\n=====\n", "doc") == ["One point.", "Two points!", "Threex here"]
    assert subjects.sentences("x = 1\n# A comment here. Another\n", "code") == ["A comment here.", "Another"]
    assert subjects.sentences("<p>In a tag</p>", "doc") == ["In a tag"]
    assert subjects.sentences(None, "doc") == subjects.sentences(" \n", None) == subjects.sentences("----\n​", "doc") == []
    assert set(subjects.items("lnudi Lundi")) == {"dilnu", "dilnu dilnu"}


TERMS = {"sport": "goalkeeper penalty marathon relay referee offside".split(), "food": "olive noodle butter oven broth cinnamon".split(), "law": "tribunal affidavit plaintiff verdict statute clause".split()}
FRAMES = ["What matters is the {0}; the {1} can wait.", "Notes on the {0}: first seen, then compared with the {1}.", "Open question: who saw the {0} near the {1}?"]


def test_rules_of_words_that_say_nothing_alone(spark):
    """The subject follows from two words, or three, each of which is spread evenly over five subjects."""
    n, docs, wanted, pairs, triples = 5, [], [], set(), set()
    for i in range(n):
        for j in range(n):
            a, b, c = (f"{x}{chr(97 + v)}" for x, v in (("pa", i), ("qa", j), ("ta", j)))
            pairs.add(((a, b), f"s{(i + j) % n}"))
            for k in range(n):
                d, e = f"ra{chr(97 + i)}", f"ua{chr(97 + k)}"
                triples.add((tuple(sorted((d, c, e))), f"s{(i + j + k) % n}"))
                for _ in range(4):
                    for t, s in ((f"{a} of {b}", i + j), (f"{d} of {c} of {e}", i + j + k)):
                        docs.append((len(docs), t, "doc", "en"))
                        wanted.append((len(wanted), f"s{s % n}"))
    d = spark.createDataFrame(docs, "doc_id long, text string, kind string, lang string")
    rules = subjects.mine(d, spark.createDataFrame(wanted, "doc_id long, subject string"))
    assert pairs | triples <= {(x, s) for x, s, _ in rules}


def test_subjects(spark):
    rng = random.Random(9)
    docs, truth = [], {}
    for i in range(600):
        s = rng.choice([*TERMS, "none", "two"])
        lines = []
        for k in range(6):
            t = {"none": None, "two": ("sport", "food")[k % 2]}.get(s, s)
            lines.append(rng.choice(FRAMES).format(*rng.sample(TERMS[t], 2)) if t and rng.random() < 0.9 else "Please remember this.")
        docs.append((i, " ".join(lines), "code" if i % 50 == 7 and s == "none" else "fact", "en", "x"))
        truth[i] = set() if s == "none" else {"sport", "food"} if s == "two" else {s}
    labels = [(i, next(iter(truth[i]), None)) for i in range(150) if len(truth[i]) < 2] * 2 + [(3, "sport"), (3, "food"), (None, "law"), (9999, "law")]
    docs += [(900, None, "fact", None, "x"), (901, "", "fact", "en", "x"), (902, "0a 1b 2c", None, "en", "x"), (0, docs[0][1], "fact", "en", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, kind string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    got = {}
    for r in subjects.document_subjects(d, lab).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    prose = [i for i in truth if docs[i][2] != "code"]
    assert sum(got.get(i, set()) == truth[i] for i in prose) >= 0.95 * len(prose)
    assert not {900, 901, 902} & got.keys()
    none = subjects.document_subjects(d.filter("doc_id > 800"), lab.limit(0))
    assert none.count() == 0 and subjects.document_subjects(d.limit(0), lab.limit(0)).count() == 0
    code = spark.createDataFrame([(1, "x = 1", "code", "en"), (2, " ", "code", "en")], "doc_id long, text string, kind string, lang string")
    assert {tuple(r) for r in subjects.document_subjects(code, lab.limit(0)).collect()} == {(1, "software")}
