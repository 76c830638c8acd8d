"""Which source files nobody wrote by hand in their repository.

Linear support-vector classifiers, one for each kind (generated, minified, vendored, data), over hashed
character n-grams of the body's shape, words of its opening comment, path components and line statistics.
Nobody labels files by hand here, so a file counts as an example of a kind if it gives itself away: a tool's
header, a vendor directory, a bundle's name, a body of literals, or if its body lies in a vendor directory as
well. Each example is learned twice, as it is and with what gave it away masked, so that the classifiers also
know its kin without headers. Files that look like a kind though they were taken as hand-written are left out
of a second round. Repositories held out from training set the thresholds, on examples as they are and masked,
and give the figures of `report`.

Content equal to another repository's or to a file in a vendor directory is a feature as well; it is counted
over all files, and as the model is linear, added to the score after the bodies have been read once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KINDS = ("generated", "minified", "vendored", "data")
#: Hashed names (of the path, the opening comment, the lines) and hashed n-grams of the body's shape lie apart.
NAMES, GRAMS = 1 << 15, 1 << 15
DIM = NAMES + GRAMS
#: Files that fit the classifiers (picked by hash of the path); all others are only scored.
SAMPLE = 6000
#: How much a masked example counts, by kind.
MASKED_COST = {"generated": 0.4, "minified": 2.0, "vendored": 1.0, "data": 2.0}

# Phrases with which tools and copies announce themselves, and names of directories and files
# that are set aside for them.
GENERATED_HEADER = r"@generated\b|auto-?generated|code generated by|do not edit|machine[- ](?:written|generated)|automatically (?:created|generated)|produced by .{1,60} on build|overwritten on every run|hands off|maschinell .{0,60}erzeugt|automatisch (?:erzeugt|generiert)|g[ée]n[ée]r[ée]e? (?:automatiquement|par|à partir)|generado (?:autom[áa]ticamente|por|a partir)"
VENDORED_HEADER = r"copied from|snapshot of \S+@|\(c\) \S+ contributors|@license\b|with permission of the|included here unmodified|not ours\b|send fixes upstream"
GENERATED_PATH = r"(?:^|/)__generated__/|\.pb\.|_pb2\.|\.generated\.|\.g\.[a-z]+$|_generated\.|_autogen\."
MINIFIED_PATH = r"[.-]min\.[a-z]+$|\.(?:bundle|chunk)\.[a-z]+$|\.[0-9a-f]{8}\.(?:[a-z]+\.)?[a-z]+$"
VENDORED_PATH = r"(?:^|/)(?:node_modules|bower_components|third_party|thirdparty|_vendored|vendor|contrib|external|deps)/[^/]+/"
SOURCE_MAP = r"sourceMappingURL="

_gen, _ven, _gen_path, _min_path, _ven_path = (re.compile(p, re.I) for p in (GENERATED_HEADER, VENDORED_HEADER, GENERATED_PATH, MINIFIED_PATH, VENDORED_PATH))
_map = re.compile(SOURCE_MAP)
_comment = re.compile(r"\s*(?:(?:#|//)[^\n]*(?:\n|$)|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\")", re.S)
_word = re.compile(r"[A-Za-z@]{2,}")
_blob = re.compile(r"[A-Za-z0-9+/=_-]{160,}")
_literal = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[\d\s\[\]{}(),:;=.+-]+")

_shape = np.arange(256, dtype=np.uint8)
_shape[[*range(65, 91), *range(97, 123), *range(128, 256)]] = ord("a")
_shape[range(48, 58)] = ord("0")
_shape[[9, 11, 12]] = 32
_quote, _repeats, _counted = (np.isin(np.arange(256), x) for x in ([34, 39], [97, 48, 32], [97, 48]))


def opening(body: str) -> int:
    """Where the comments at the head of a file end."""
    at = 0
    while (m := _comment.match(body, at)) and m.end() > at:
        at = m.end()
    return at


def giveaways(path: str, body: str) -> set[str]:
    """The kinds of which a file is an example by what it says of itself."""
    head = body[: opening(body)]
    out = set()
    if _gen.search(head) or _gen_path.search(path):
        out.add("generated")
    if _min_path.search(path) or _map.search(body):
        out.add("minified")
    if _ven_path.search(path) or _ven.search(head):
        out.add("vendored")
    rest = body[len(head) :]
    dense = len(re.sub(r"\s+", "", rest))
    # blobs, columns of numbers, or hardly anything but literals
    if dense > 400 and (sum(map(len, _blob.findall(rest))) > 0.5 * dense or sum(c.isdigit() for c in rest) > 0.3 * dense or len(_literal.sub("", rest)) < 0.05 * dense):
        out.add("data")
    return out


def mask(path: str, body: str) -> tuple[str, str]:
    """The file without what may give it away: of the path, the repository and the ending are left."""
    return f"{path.split('/')[0]}/.{path.rsplit('.', 1)[-1]}", _map.sub("", body[opening(body) :])


def _named(names: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values), each index once."""
    at: dict[int, float] = {}
    for name, v in names:
        i = zlib.crc32(name.encode()) % NAMES
        at[i] = at.get(i, 0.0) + v
    return np.fromiter(at.keys(), dtype=np.int64, count=len(at)), np.fromiter(at.values(), dtype=np.float64, count=len(at))


def features(path: str, body: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(indices, values) of one file, each index once, and how many of them don't come from the body's n-grams."""
    names: list[tuple[str, float]] = [("bias", 1.0)]
    parts = path.lower().split("/")[1:] or [path.lower()]
    names += [(f"d:{x}", 0.6) for x in parts[:-1]] + [(f"p:{a}/{b}", 0.4) for a, b in zip(parts[:-2], parts[1:-1])]
    base = re.sub(r"\d", "0", re.sub(r"[0-9a-f]{8,}", "HEX", parts[-1]))
    stem, *ends = base.split(".")
    names += [("e:" + ".".join(ends[-3:]), 0.6), *((f"e:{x}", 0.4) for x in ends), *((f"n:{x}", 0.3) for x in re.split(r"[-_]", stem))]
    names += [(f"g:{base[i : i + 4]}", 0.1) for i in range(len(base) - 3)]
    cut = opening(body)
    # the repository's own name says who wrote it, any other is a word like others
    head = body[:cut].replace(path.split("/")[0], " OWNREPO ")
    words = [w.lower() for w in _word.findall(head)]
    names += [(f"h:{w}", 0.35) for w in set(words)] + [(f"hb:{a} {b}", 0.35) for a, b in set(zip(words[:-1], words[1:]))]
    if _map.search(body):
        names.append(("map", 0.6))
    rest = body[cut:]
    raw = np.frombuffer(rest.encode("utf-8", "ignore"), dtype=np.uint8)
    raw = raw[raw != 13]
    names.append((f"size:{len(raw).bit_length()}", 0.3))
    if not len(raw):
        idx, val = _named([*names, ("empty", 1.0)])
        return idx, val, len(idx)
    newline = np.flatnonzero(raw == 10)
    lines = np.diff(np.concatenate([[-1], newline, [len(raw)]]))
    shape = _shape[raw]
    ink = np.maximum((shape != 32).sum(), 1)
    names += [(f"longest:{int(lines.max()).bit_length()}", 0.6), (f"mean:{int(lines.mean()).bit_length()}", 0.6), (f"digits:{int(20 * (shape == 48).sum() / ink)}", 0.6), (f"spaces:{int(20 * (shape == 32).sum() / len(raw))}", 0.4), (f"quotes:{int(20 * _quote[raw].sum() / ink)}", 0.4)]
    run = np.concatenate([[True], (shape[1:] != shape[:-1]) | ~_repeats[shape[1:]]])
    starts = np.flatnonzero(run)
    s = shape[starts].astype(np.uint32)
    length = np.diff(np.append(starts, len(shape)))
    # runs keep a hint of their length: one letter, a word, a blob
    s = np.where(_counted[s], s + np.where(length == 1, 256, np.where(length > 40, 512, 0)).astype(np.uint32), s)
    if len(s) >= 5:
        g = (((s[:-4] * np.uint32(31) + s[1:-3]) * np.uint32(1009) + s[2:-2]) * np.uint32(9176) + s[3:-1]) * np.uint32(31) + s[4:]
        g = ((g * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % GRAMS + NAMES
        grams, count = np.unique(g, return_counts=True)
        weight = np.sqrt(count)
        weight = weight / np.sqrt((weight * weight).sum()) * 2.5
    else:
        grams, weight = np.zeros(0, dtype=np.int64), np.zeros(0)
    idx, val = _named(names)
    return np.concatenate([idx, grams]), np.concatenate([val, weight]), len(idx)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (dim, ...) of linear classifiers with squared hinge loss, by dual coordinate descent.

    y and cost are (rows) or (rows, classifiers): all classifiers are trained in one pass over the rows. A row of cost
    0 is no example. No row may have an index twice.
    """
    y, cost, flat = y.reshape(len(rows), -1), cost.reshape(len(rows), -1).astype(np.float64), y.ndim == 1
    w, alpha = np.zeros((dim, y.shape[1])), np.zeros(y.shape)
    use = cost > 0
    half = np.divide(0.5, cost, out=np.full(cost.shape, np.inf), where=use)
    scale = 1 / (np.array([v @ v for _, v in rows])[:, None] + half)
    half[~use] = 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            grad = y[i] * (val @ w[idx]) - 1 + alpha[i] * half[i]
            step = np.maximum(alpha[i] - grad * scale[i], 0.0) - alpha[i]
            if step.any():
                w[idx] += val[:, None] * (step * y[i])
                alpha[i] += step
                moved = max(moved, float((np.abs(step) * half[i]).max()))
        if moved < 0.005:
            break
    return w[:, 0] if flat else w


#: Features that are known only after all files have been counted; they come behind the hashed ones.
LATE = ("copied_vendored", "copied_abroad")


@dataclass
class Model:
    weights: np.ndarray  # kinds x (DIM + LATE)
    thresholds: np.ndarray
    report: dict = field(default_factory=dict)


@dataclass
class Example:
    """A file of the sample: features as it is and masked, how many of them are not of its body, kinds it gives away."""

    path: str
    plain: tuple[np.ndarray, np.ndarray]
    masked: tuple[np.ndarray, np.ndarray]
    begin: int
    gave: frozenset[str]
    late: tuple[bool, ...] = (False,) * len(LATE)

    @classmethod
    def of(cls, path: str, body: str, late: tuple[bool, ...] = (False,) * len(LATE)) -> Example:
        gave = giveaways(path, body)
        *plain, begin = features(path, body)
        # what a copy gives away is known only later, so every file is masked
        return cls(path, tuple(plain), features(*mask(path, body))[:2], begin, frozenset(gave), late)

    def kinds(self) -> set[str]:
        return set(self.gave) | ({"vendored"} if self.late[0] else set())


def fit(files: list[Example], cost: float = 1.0, seed: int = 0) -> Model:
    """A model; the first step of a path is its repository."""
    label = np.array([[k in f.kinds() for k in KINDS] for f in files], dtype=bool).reshape(len(files), len(KINDS))
    late = lambda f, x: (np.concatenate([x[0], DIM + np.flatnonzero(f.late)]), np.concatenate([x[1], np.ones(sum(f.late))]))
    plain, masked = [late(f, f.plain) for f in files], [late(f, f.masked) for f in files]
    repo = np.array([zlib.crc32(f.path.split("/")[0].encode()) % 5 for f in files])
    weights, thresholds, report = np.zeros((len(KINDS), DIM + len(LATE))), np.full(len(KINDS), np.inf), {}
    score = lambda rows: np.array([v @ weights[:, i].T for i, v in rows]).reshape(len(rows), len(KINDS))
    known, held = label.any(1), repo == 0
    suspect = np.zeros(len(files), dtype=bool)
    learned = np.flatnonzero(label.any(0))
    for step in ("suspects", "thresholds", "all"):
        if not len(learned):
            break
        use = np.flatnonzero(~held | (step == "all"))  # with the thresholds set, all repositories are learned
        again = use[known[use]]
        y = np.where(np.concatenate([label[use], label[again]])[:, learned], 1.0, -1.0)
        # without its header a file may read like any other, so masked examples have a cost of their own
        own_cost = np.where(label[use], 2.0, np.where(suspect[use, None], 0.0, 1.0))
        again_cost = np.where(label[again], np.array([MASKED_COST[k] for k in KINDS]), np.where(suspect[again, None], 0.0, 1.0))
        c = np.concatenate([own_cost, again_cost])[:, learned] * cost
        weights[learned] = train_svm([plain[i] for i in use] + [masked[i] for i in again], y, c, DIM + len(LATE), seed=seed).T
        if step == "all":
            break
        own, blind = score(plain), score(masked)
        for j in learned:
            # the threshold with the best F0.5 (a hand-written file lost costs more than one kept too many) on the
            # repositories held out, examples counted as they are and masked; unlabelled files beyond half the margin are
            # taken as kin of examples, all others as wrong
            yes, no = held & label[:, j], held & ~label[:, j] & (own[:, j] < 0.5)
            tried = []
            for t in np.linspace(-0.3, 0.0, 7):
                found, wrong = (own[yes, j] > t).sum() + (blind[yes, j] > t).sum(), (own[no, j] > t).sum()
                tried.append((round(1.25 * found / max(1.0, found + wrong + 0.25 * 2 * yes.sum()), 3), t))
            thresholds[j] = max(tried)[1]
            got = (own[:, j] > thresholds[j]) & held
            report[KINDS[j]] = {
                "examples": int(label[:, j].sum()), "held out": int(yes.sum()), "found": int((got & yes).sum()), "found masked": int((blind[yes, j] > thresholds[j]).sum()), "flagged besides": int((got & ~known).sum()),
            }
        if step == "suspects":
            # a body that reads more like the examples' bodies than like the others', or a margin near theirs
            for j in learned:
                if KINDS[j] == "vendored":  # those were written by hand once
                    continue
                inner = np.array([weights[j, i[f.begin :]] @ v[f.begin :] for (i, v), f in zip((f.plain for f in files), files)])
                cut = (inner[label[:, j]].mean() + inner[~known].mean()) / 2
                suspect |= ~known & ((inner > cut) | (own[:, j] > -0.1))
    return Model(weights, thresholds, report)


def content_key(body: Column) -> Column:
    """A hash of the body without its opening comments and white space; null for very short ones."""
    bare = F.regexp_replace(body, r'(?s)\A(?:\s*(?:(?:#|//)[^\n]*(?:\n|\z)|/\*.*?\*/|<!--.*?-->))*', "")
    bare = F.regexp_replace(bare, r"\s+", "")
    return F.when(F.length(bare) >= 60, F.xxhash64(bare))


def score_files(index: DataFrame, docs: DataFrame, sample: int = SAMPLE, cost: float = 1.0) -> DataFrame:
    """(path, generated, minified, vendored, data, kind): for each path of the index the margins of the four
    classifiers and the kind with the largest one above 0, else null for hand-written.

    Paths come once; null paths are left out. Null and missing bodies count as empty, so the path decides. Of
    several bodies under one path the largest margins count. Without a single example in the sample no file
    is flagged.
    """
    spark = index.sparkSession
    paths = index.select("path").filter("path IS NOT NULL").distinct()
    # bodies are read where they lie and never shuffled: keys and scores are cut to the index afterwards
    texts = docs.filter("path IS NOT NULL").select("path", F.coalesce("body", F.lit("")).alias("body"))
    keyed = materialize(texts.select("path", content_key(F.col("body")).alias("key")).filter("key IS NOT NULL").distinct().join(paths, "path", "left_semi"), "keys")
    repo = F.substring_index("path", "/", 1)
    kept = F.col("path").rlike("(?i)" + VENDORED_PATH)
    copies = keyed.groupBy("key").agg(
        F.min(repo).alias("r0"), F.max(repo).alias("r1"), F.count("*").alias("n"),
        F.sum(kept.cast("int")).alias("vn"),
    ).filter("n > 1").select("key", (F.col("r0") != F.col("r1")).cast("int").alias("copied_abroad"), (F.col("vn") > 0).cast("int").alias("copied_vendored"))
    late = keyed.join(copies, "key").groupBy("path").agg(*[F.max(c).alias(c) for c in LATE])

    total = index.count()
    share = min(1.0, sample / max(total, 1))
    picked = texts.filter(F.pmod(F.xxhash64("path"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).join(paths, "path", "left_semi")
    one = picked.groupBy("path").agg(F.max("body").alias("body")).limit(2 * sample)
    vectors = "idx array<int>, val array<double>, m_idx array<int>, m_val array<double>, begin int, gave array<string>"

    def read(batches):
        for b in batches:
            made = [Example.of(p, body) for p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            lists = [(x.plain[0], x.plain[1], x.masked[0], x.masked[1], x.begin, sorted(x.gave)) for x in made]
            cols = list(zip(*lists)) or [()] * 6
            kinds = [pa.list_(pa.int32()), pa.list_(pa.float64())] * 2 + [pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["p", "idx", "val", "m_idx", "m_val", "begin", "gave"])

    # features reach the driver, not bodies
    seen = one.mapInArrow(read, f"p string, {vectors}")
    t = seen.join(late, seen["p"] == late["path"], "left").drop("path").toArrow().sort_by("p").combine_chunks()
    cut = lambda c: np.split(t[c].combine_chunks().flatten().to_numpy(), t[c].combine_chunks().offsets.to_numpy()[1:-1]) if t.num_rows else []
    model = fit([
        Example(p, (i.astype(np.int64), v), (mi.astype(np.int64), mv), n, frozenset(g), (bool(a), bool(b)))
        for p, i, v, mi, mv, n, g, a, b in zip(t["p"].to_pylist(), cut("idx"), cut("val"), cut("m_idx"), cut("m_val"), t["begin"].to_pylist(), t["gave"].to_pylist(), *(t[c].to_pylist() for c in LATE))
    ], cost)
    shared = spark.sparkContext.broadcast((model.weights[:, :DIM].T.copy(), model.thresholds))

    def run(batches):
        weights, thresholds = shared.value
        for b in batches:
            out = np.zeros((b.num_rows, len(KINDS)))
            for i, (p, body) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                idx, val, _ = features(p, body or "")
                out[i] = val @ weights[idx] - thresholds
            out = np.where(np.isfinite(out), out, -1e9)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, j]) for j in range(len(KINDS))]], ["path", *KINDS])

    missing = paths.join(texts.select("path").distinct(), "path", "left_anti").withColumn("body", F.lit(""))
    scored = texts.unionByName(missing).mapInArrow(run, "path string, " + ", ".join(f"{k} double" for k in KINDS))
    one = scored.groupBy("path").agg(*[F.max(k).alias(k) for k in KINDS]).join(paths, "path", "left_semi").join(late, "path", "left")
    for j, k in enumerate(KINDS):
        add = sum((F.coalesce(F.col(c), F.lit(0)) * F.lit(float(model.weights[j, DIM + i])) for i, c in enumerate(LATE)), F.lit(0.0))
        one = one.withColumn(k, F.col(k) + add)
    best = F.greatest(*KINDS)
    kind = F.when(best > 0, F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in KINDS]))
    return one.select("path", *KINDS, kind.alias("kind"))
