"""The k most similar vectors of every vector: multi-index hashing over learned binary codes.

Plan
1. A bounded sample of each vector length fits rotations (principal axes, then iterative quantisation); the signs of
   the rotated vector are its code. The code is cut into substrings of `width` bits, and each is indexed (a table).
   Width follows from the number of vectors (`width_for`), so that a substring has few candidates.
2. The number of tables is measured: as many as it takes at that width for the share RECALL of pairs at exactly
   min_cosine to meet in one of them (`fit_rotation`), so recall doesn't depend on the number of vectors. Of two codes that differ in
   fewer bits than there are tables, one substring is equal (pigeonhole), so these meet for certain; the flips raise the
   share of all others.
3. The first KEY bits of a substring are the shuffle key; index and lookups with flips of the other, low bits are arrays
   of one task, so no flip is shuffled. A row of the shuffle packs all codes of a batch that have one key.
4. Pairs within the radius on CHECK bits whose distance is near the k smallest of one of the two are ranked by the
   exact cosine of the floats.

Vectors that are equal bit for bit form one class; classes are compared once, and a class hands on its k+1
smallest paths, which is all that k neighbours in the order (cosine desc, path) can need.

`certain=True` instead retrieves every pair of 256-bit codes within the radius, blocks of codes against blocks. Its work
grows with the square of the vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORDS = 4
#: Bits of a substring's shuffle key; bits on which candidates are checked.
KEY, CHECK = 6, 128
#: Widths of substrings; at most CROWD codes to a value are meant, if values were even.
WIDTHS, CROWD = (16, 20, 24, 28), 1024
#: Share of the pairs at exactly min_cosine that must meet in a table.
RECALL = 0.96
MAX_TABLES = 128
#: Codes that share a shuffle key go to one task; more than this are split by further bits of their substring.
GROUP_ROWS = 1 << 20
#: Lengths of vectors for which rotations are learned; rarer ones get seeded random rotations.
MAX_FITTED_DIMS = 64


def usable_vectors(df: DataFrame, path: str = "path", dim: str = "dim", vec: str = "vec") -> DataFrame:
    """Rows (path, h, dim, vec) that have a direction: dim is the length of vec, no element null, NaN or
    infinite, not all zero, path not null. h is a hash of the vector, equal for equal vectors."""
    inf = float("inf")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf)))
    ok = F.col(path).isNotNull() & (F.size(vec) == F.col(dim)) & ~bad & F.exists(vec, lambda x: x != 0)
    return df.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(path).alias("path"), F.xxhash64(dim, vec).alias("h"), F.col(dim).cast("int").alias("dim"), F.col(vec).cast("array<float>").alias("vec")
    )


def _orthogonal(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Rotation:
    """How vectors of one length are coded: centre, planes (d, tables x width), and the radius on the check bits."""

    centre: np.ndarray
    planes: np.ndarray
    width: int
    tables: int
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(n, tables x width) booleans of unit vectors."""
        return (x.astype(np.float32) - self.centre) @ self.planes > 0


@dataclass(frozen=True)
class Plan:
    """What is looked for: least cosine, flips and width of the lookups, least bits of a code."""

    min_cosine: float
    flips: int = 1
    width: int = WIDTHS[0]
    bits: int = CHECK


def width_for(vectors: int) -> int:
    return next((w for w in WIDTHS if vectors <= CROWD << w), WIDTHS[-1])


def _substrings(bits: np.ndarray, width: int) -> np.ndarray:
    """(n, tables) numbers of `width` bits."""
    return bits[:, : bits.shape[1] // width * width].reshape(len(bits), -1, width) @ (1 << np.arange(width, dtype=np.int64))


def _check_words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits[:, :CHECK], axis=1, bitorder="little").view(np.uint64)


def _meet(diff: np.ndarray, flips: int, width: int) -> np.ndarray:
    """Whether two substrings with this difference meet in a table: one key, and so many flips of the rest."""
    return ((diff >> (width - KEY)) == 0) & (np.bitwise_count(diff) <= flips)


def fit_rotation(x: np.ndarray | None, d: int, plan: Plan, recall: float = RECALL, rounds: int = 15) -> Rotation:
    """Planes by iterative quantisation from several starts, as many as `recall` takes.

    The recall is measured: each of a fifth of the sample (up to 2,000 rows, which fit nothing) gets a neighbour at exactly
    min_cosine in a random direction, and tables are added until that share of these pairs meets in one of them (or there are MAX_TABLES).
    The radius is the mean of their differing check bits plus 2.5 standard deviations.
    """
    rng, width, min_cosine = np.random.default_rng(d), plan.width, plan.min_cosine
    if x is None or len(x) < 4 * d:
        centre, axes, v = np.zeros(d), np.eye(d), None
        x = rng.standard_normal((2000, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        held = min(2000, len(x) // 5)
        x, v = x[:held], x[held:]
        centre = v.mean(0)
        _, axes = np.linalg.eigh(np.cov((v - centre).T).reshape(d, d))
        v = (v - centre) @ axes
    some = x[:2000]
    u = rng.standard_normal(some.shape)
    u -= (u * some).sum(1, keepdims=True) * some
    length = np.linalg.norm(u, axis=1, keepdims=True)
    near = min_cosine * some + math.sqrt(max(0.0, 1 - min_cosine**2)) * np.divide(u, length, out=np.zeros_like(u), where=length > 1e-9)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    planes, k = np.zeros((d, 0)), 0
    for tables in (*range(16, MAX_TABLES, 8), MAX_TABLES):
        while planes.shape[1] < tables * width:
            r = _orthogonal(d, 7919 * k + d)
            for _ in range(rounds if v is not None else 0):
                w, _, z = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (w @ z).T
            planes, k = np.concatenate([planes, axes @ r], axis=1), k + 1
        mine = planes[:, : tables * width]
        # planes of one rotation hang together; spread over the tables they fail independently
        mine = mine[:, np.random.default_rng(tables).permutation(mine.shape[1])].astype(np.float32)
        out = Rotation(centre.astype(np.float32), mine, width, tables, 0)
        a, b = out.bits(some), out.bits(near)
        met = np.cumsum(_meet(_substrings(a, width) ^ _substrings(b, width), plan.flips, width), axis=1) > 0
        enough = np.flatnonzero(met.mean(0) >= recall)
        if len(enough) or tables == MAX_TABLES:
            n = max(int(enough[0]) + 1 if len(enough) else MAX_TABLES, -(-plan.bits // width))
            far = (a != b)[:, :CHECK].sum(1)
            return Rotation(out.centre, mine[:, : n * width], width, n, math.ceil(far.mean() + 2.5 * far.std()))
    raise AssertionError


@lru_cache(maxsize=256)
def _unlearned(d: int, plan: Plan) -> Rotation:
    """The rotation of a length that the sample doesn't hold; the same on every machine."""
    return fit_rotation(None, d, plan)


def fit(usable: DataFrame, rows: int, sample: int, plan: Plan) -> dict[int, Rotation]:
    """Rotations by length from about `sample` rows picked by hash (2 x sample at most reach the driver)."""
    share = min(1.0, sample / max(rows, 1))
    picked = usable.filter(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("h", "dim", "vec").limit(2 * sample).toArrow().sort_by("h")
    dims = picked["dim"].to_numpy()
    lengths, counts = np.unique(dims, return_counts=True)
    out = {}
    for d in lengths[np.argsort(-counts)][:MAX_FITTED_DIMS]:
        x = np.asarray(picked.filter(pa.array(dims == d))["vec"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, d)
        out[int(d)] = fit_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), int(d), plan)
    return out


def _encode(rotations: dict[int, Rotation], plan: Plan):
    def run(batches):
        for b in batches:
            dims, vec = b.column("dim").to_numpy(), b.column("vec")
            codes: list[bytes] = [b""] * b.num_rows
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                rotation = rotations.get(int(d)) or _unlearned(int(d), plan)
                x = np.asarray(vec.take(pa.array(rows)).flatten(), dtype=np.float32).reshape(-1, d)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, c in zip(rows, np.packbits(rotation.bits(x), axis=1, bitorder="little")):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("dim"), pa.array(codes, pa.binary())], ["h", "dim", "code"])

    return run


def _unpacked(b: pa.RecordBatch):
    """(d, rows, bits) for each length of vectors in a batch of codes."""
    dims, code = b.column("dim").to_numpy(), b.column("code")
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        raw = np.frombuffer(b"".join(code.take(pa.array(rows)).to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
        yield int(d), rows, np.unpackbits(raw, axis=1, bitorder="little")


# --- retrieval by tables


def _keys(d: int, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rest) of shape (n, tables): the group of each substring and its low bits."""
    sub, low = _substrings(bits, width), width - KEY
    table = np.arange(sub.shape[1], dtype=np.int64)
    return (((d * MAX_TABLES + table) << KEY) + (sub >> low)) << low, sub & ((1 << low) - 1)


def _count_keys(width: int):
    def run(batches):
        for b in batches:
            for d, _, bits in _unpacked(b):
                key, n = np.unique(_keys(d, bits, width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def _pack(crowded: dict[int, int], width: int):
    """Rows (key, n, data): the codes of a batch with one key; data has their h, check bits and low bits.

    The key of a crowded group also has so many of the low bits, so that groups stay small; of these no flips are
    looked up.
    """
    low_bits = width - KEY

    def run(batches):
        for b in batches:
            hs = b.column("h").to_numpy()
            for d, rows, bits in _unpacked(b):
                keys, rest = _keys(d, bits, width)
                if crowded:
                    more = np.zeros_like(keys)
                    for key in np.unique(keys):
                        if e := crowded.get(int(key)):
                            more[keys == key] = ((1 << e) - 1) << (low_bits - e)
                    keys = keys + (rest & more)
                check, h = _check_words(bits), hs[rows]
                order = np.argsort(keys, axis=None, kind="stable")
                flat, owner = keys.ravel()[order], order // keys.shape[1]
                low = rest.ravel()[order].astype(np.uint32 if low_bits > 16 else np.uint16)
                cut = np.flatnonzero(np.diff(flat, prepend=-1))
                data = [
                    b"".join((h[o].tobytes(), check[o].tobytes(), low[i:j].tobytes()))
                    for i, j, o in ((i, j, owner[i:j]) for i, j in zip(cut, np.append(cut[1:], len(flat))))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(flat[cut]), pa.array(np.diff(np.append(cut, len(flat))).astype(np.int32)), pa.array(data, pa.binary())], ["key", "n", "data"])

    return run


def _candidates(sub: np.ndarray, masks: np.ndarray):
    """Positions (i, j) of sorted values, each unordered pair whose values differ by one of the masks once."""
    value, first, count = np.unique(sub, return_index=True, return_counts=True)
    for m in masks:
        at = np.flatnonzero((value ^ m) > value) if m else np.flatnonzero(count > 1)
        to = np.minimum(np.searchsorted(value, value[at] ^ m), len(value) - 1)
        found = value[to] == value[at] ^ m
        at, to = at[found], to[found]
        # a row of the left run meets the right run, or what follows it in its own
        i = np.repeat(first[at] - (np.cumsum(count[at]) - count[at]), count[at]) + np.arange(count[at].sum())
        end = np.repeat(first[to] + count[to], count[at])
        begin = np.repeat(first[to], count[at]) if m else i + 1
        many = end - begin
        keep = np.flatnonzero(many)
        i, begin, many = i[keep], begin[keep], many[keep]
        ends = np.cumsum(many)
        for part in np.split(np.arange(len(i)), np.searchsorted(ends, np.arange(CHUNK, ends[-1] if len(i) else 0, CHUNK)) + 1):
            # one row may have more partners than a chunk holds
            if len(part):
                k = many[part]
                yield np.repeat(i[part], k), np.arange(k.sum()) + np.repeat(begin[part] - (np.cumsum(k) - k), k)


def _closest(i: np.ndarray, j: np.ndarray, far: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Which pairs are as near as the k-th nearest of one of the two, give or take `slack` bits."""
    who, dist = np.concatenate([i, j]), np.concatenate([far, far])
    order = np.lexsort((dist, who))
    who, dist = who[order], dist[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(np.append(first, len(who)))
    limit = np.full(int(who[-1]) + 1 if len(who) else 0, np.iinfo(np.int64).max // 2)
    full = size >= k
    limit[who[first[full]]] = dist[first[full] + k - 1]
    return far <= np.maximum(limit[i], limit[j]) + slack


def _search(radii: dict[int, int], plan: Plan, k: int, cap: int):
    """Pairs (a, b) of the groups of a partition that is sorted by key."""
    low_bits = plan.width - KEY
    plain, fine, low_type = _masks(low_bits, plan.flips), _masks(16, plan.flips), np.uint32 if low_bits > 16 else np.uint16

    def pairs(d: int, groups: list):
        radius = radii[d] if d in radii else _unlearned(d, plan).radius
        h, check, low = (np.concatenate(x) for x in zip(*(g[1:] for g in groups)))
        group = np.repeat(np.arange(len(groups)), [len(g[1]) for g in groups])
        sub = (group << low_bits) + low
        order = np.argsort(sub, kind="stable")
        sub, h, check, group = sub[order], h[order], check[order], group[order]
        value, count = np.unique(sub, return_counts=True)
        # many equal substrings in a group: it is searched anew by parts of the check bits
        dense = np.unique(value[count > cap] >> low_bits)
        loose = ~np.isin(group, dense)
        searches = [(sub[loose], plain, np.flatnonzero(loose))]
        for g in dense:
            mine = np.flatnonzero(group == g)
            for part in range(CHECK // 16):
                v = (check[mine, part // 4] >> np.uint64(16 * (part % 4))).astype(np.int64) & 0xFFFF
                o = np.argsort(v, kind="stable")
                searches.append((v[o], fine, mine[o]))
        c0, c1 = check[:, 0], check[:, 1]
        # two to three standard deviations of a distance, as far as the radius has them
        slack = max(1, radius // 3)
        held: list[np.ndarray] = []

        def pruned():
            i, j, far = np.concatenate(held, axis=1) if held else np.zeros((3, 0), dtype=np.int64)
            keep = _closest(i, j, far, k, slack)
            return np.stack([i[keep], j[keep], far[keep]])

        for v, masks, where in searches:
            for i, j in _candidates(v, masks):
                i, j = where[i], where[j]
                far = np.bitwise_count(c0[i] ^ c0[j]) + np.bitwise_count(c1[i] ^ c1[j])
                near = np.flatnonzero(far <= radius)
                if len(near):
                    held.append(np.stack([i[near], j[near], far[near].astype(np.int64)]))
                    if sum(x.shape[1] for x in held) > 4 * CHUNK:
                        held[:] = [pruned()]
        i, j, _ = pruned()
        a, b = np.minimum(h[i], h[j]), np.maximum(h[i], h[j])
        if len(a):
            both = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches):
        held, last, d, rows = [], None, None, 0
        for b in batches:
            for key, n, data in zip(b.column("key").to_numpy(), b.column("n").to_numpy(), b.column("data")):
                if key != last:
                    own = int(key) >> (low_bits + KEY + 7)
                    if held and (rows > 1 << 17 or own != d):
                        yield from pairs(d, [(g, *(np.concatenate(x) for x in zip(*parts))) for g, parts in held])
                        held, rows = [], 0
                    held.append((key, []))
                    last, d = key, own
                raw = data.as_buffer()
                held[-1][1].append((
                    np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint64, 2 * n, 8 * n).reshape(n, 2), np.frombuffer(raw, low_type, n, 24 * n).astype(np.int64),
                ))
                rows += n
        if held:
            yield from pairs(d, [(g, *(np.concatenate(x) for x in zip(*parts))) for g, parts in held])

    return run


def table_pairs(codes: DataFrame, rotations: dict[int, Rotation], classes: int, plan: Plan, k: int = 10, cap: int = 4096) -> DataFrame:
    """Distinct pairs (a, b) of codes (h, dim, code) that meet in a table and lie within the radius.

    Groups whose number of codes is above GROUP_ROWS are split by further bits, and groups in which more than `cap`
    codes have one substring are searched by parts of their check bits: both lose a few of their pairs far out,
    none of their work is a square of the group. Of a code's pairs in a task those remain that are near its k
    nearest by distance, or its partner's.
    """
    counts = codes.mapInArrow(_count_keys(plan.width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most rows x tables / GROUP_ROWS of them
    crowded = {r["key"]: min(plan.width - KEY - 1, math.ceil(math.log2(r["n"] / GROUP_ROWS))) for r in counts.filter(F.col("n") > GROUP_ROWS).toArrow().to_pylist()}
    packed = codes.mapInArrow(_pack(crowded, plan.width), "key long, n int, data binary")
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes * 20 // GROUP_ROWS + 1)
    met = packed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_search({d: r.radius for d, r in rotations.items()}, plan, k, cap), "a long, b long")
    return met.distinct()


# --- certain retrieval by blocks


def _words(batches):
    """(h, dim, c0..c3): the first 256 bits of each code."""
    for b in batches:
        h = b.column("h").to_numpy()
        for d, rows, bits in _unpacked(b):
            w = np.packbits(bits[:, : WORDS * 64], axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(np.full(len(rows), d, dtype=np.int32)), *[pa.array(w[:, i]) for i in range(WORDS)]], ["h", "dim", *[f"c{i}" for i in range(WORDS)]])


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of `bits` bits with at most `flips` ones."""
    return np.array([sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(bits), n)], dtype=np.int64)


def substrings(min_cosine: float, probes: int = 0, bits: int | None = None) -> tuple[int, int, int]:
    """(bits, flips, radius): the width of the substrings, the flips in which each is looked up, and the distance of
    256-bit codes up to which every pair is then certain to meet.

    The radius holds the mean of differing bits at min_cosine plus three standard deviations. Two codes in it differ
    in radius // substrings bits of one substring at most. Of the widths the cheapest is taken; the number of
    vectors has no part in it.
    """
    p = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    n = WORDS * 64
    least = min(n, int(n * p + 3 * math.sqrt(n * p * (1 - p))))

    def plan(width: int) -> tuple[float, int, int, int]:
        tabs = WORDS * (64 // width)
        flips = min(width, max(probes, least // tabs))
        lookups = tabs * sum(math.comb(width, i) for i in range(flips + 1))
        return lookups * (2.0**-width + 2.0**-12), width, flips, max(least, tabs * (flips + 1) - 1)

    return min(plan(w) for w in ([bits] if bits else range(4, 21)))[1:]


#: Candidates compared at once.
CHUNK = 1 << 20


def _near(a: list[np.ndarray], b: list[np.ndarray], same: bool, bits: int, masks: np.ndarray, radius: int) -> np.ndarray:
    """Positions (2, n) of the codes of a and b within the radius, by an index of b on each substring."""
    low, out = (1 << bits) - 1, [np.zeros((2, 0), dtype=np.int64)]
    for word in range(WORDS):
        for s in range(64 // bits):
            va, vb = ((x[word] >> (s * bits)) & low for x in (a, b))
            order = np.argsort(vb, kind="stable")
            codes = [x[order] for x in b]
            first = np.concatenate([[0], np.cumsum(np.bincount(vb, minlength=low + 1))])
            for some in np.array_split(masks, -(-len(masks) * len(va) // CHUNK)):
                v = (some[:, None] ^ va).ravel()
                at = first[v]
                many = first[v + 1] - at
                hit = np.flatnonzero(many)
                ends = np.cumsum(many[hit])
                cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)) + 1 if len(hit) else []
                for part in np.split(hit, cuts):
                    m = many[part]
                    i = np.repeat(part % len(va), m)
                    j = np.arange(len(i)) + np.repeat(at[part] - (np.cumsum(m) - m), m)
                    far = np.zeros(len(i), dtype=np.int64)
                    for x, y in zip(a, codes):
                        far = far + np.bitwise_count((x[i] ^ y[j]).view(np.uint64))
                        keep = np.flatnonzero(far <= radius)
                        i, j, far = i[keep], j[keep], far[keep]
                    if len(i):
                        found = np.stack([i, order[j]])
                        out.append(found[:, found[0] < found[1]] if same else found)
        out = [np.unique(np.concatenate(out, axis=1), axis=1)]
    return out[0]


def _compare(bits: int, flips: int, radius: int):
    """Pairs (a, b) within the radius of each run of equal keys (pairs of blocks); the input is sorted by key."""
    names = ["h", "own", *[f"c{i}" for i in range(WORDS)]]

    def pairs(chunks: list[pa.RecordBatch], masks: np.ndarray):
        t = pa.Table.from_batches(chunks)
        h, own, *code = (t[n].to_numpy() for n in names)
        same = t["same"][0].as_py()
        left, right = (np.flatnonzero(own == 0), np.flatnonzero(own == (0 if same else 1)))
        if len(left) and len(right):
            i, j = _near([c[left] for c in code], [c[right] for c in code], same, bits, masks, radius)
            if len(i):
                x, y = h[left[i]], h[right[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        masks, held, last = _masks(bits, flips), [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and key[lo] != last:
                    yield from pairs(held, masks)
                    held = []
                last = key[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from pairs(held, masks)

    return run


#: Blocks of a length of vectors; each code is sent to as many pairs of blocks.
MAX_BLOCKS = 32


def candidate_pairs(codes: DataFrame, classes: int, min_cosine: float, probes: int = 0, bucket_cap: int = 4096, bits: int | None = None) -> DataFrame:
    """Pairs (a < b) of codes of the same length of vector that differ in no more bits than substrings() says.

    `probes` flips are looked up at least. Codes lie in blocks of about bucket_cap, or larger ones once there are
    MAX_BLOCKS; each pair of blocks is indexed and looked up on its own, so no flip is shuffled.
    """
    bits, flips, radius = substrings(min_cosine, probes, bits)
    blocks = F.least(F.ceil(F.count("*") / bucket_cap), F.lit(MAX_BLOCKS)).cast("int")
    sizes = codes.groupBy("dim").agg(blocks.alias("blocks"))
    r = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    wide = codes.join(sizes, "dim").withColumn("r", r).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("r", "o"), F.greatest("r", "o")
    key = (F.col("dim").cast("long") * MAX_BLOCKS + lo) * MAX_BLOCKS + hi
    rows = wide.select(key.alias("key"), (lo == hi).alias("same"), (F.col("r") != lo).cast("byte").alias("own"), "h", *[f"c{i}" for i in range(WORDS)])
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(classes // bucket_cap + 1, MAX_BLOCKS * (MAX_BLOCKS + 1) // 2))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(bits, flips, radius), "a long, b long")


def _rescored(pairs: DataFrame, usable: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) with at least min_cosine.

    Of each pair one vector has to travel. First it goes as one byte an element, with a bound of the error that this
    makes (half a step an element), which leaves out most pairs that are too far apart and none that are not; then whole.
    """
    sum_ = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: sum_(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    step = F.array_max(F.transform("vec", F.abs)).cast("double") / 127
    floats = usable.groupBy("h").agg(F.first("vec").alias("vec")).withColumn("norm", F.sqrt(dot("vec", "vec")))
    left = floats.select(F.col("h").alias("a"), "vec", "norm")
    bytes_ = floats.withColumn("step", step).select(
        F.col("h").alias("b"), F.transform("vec", lambda x: F.round(x / F.col("step")).cast("byte")).alias("code"), (F.col("step") / F.col("norm")).alias("unit"),
        (F.col("step") * F.sqrt(F.size("vec")) / 2 / F.col("norm") + 1e-6).alias("off"),
    )
    near = pairs.join(bytes_, "b").join(left, "a").filter(dot("vec", "code") * F.col("unit") / F.col("norm") >= min_cosine - F.col("off")).select("a", "b")
    right = floats.select(F.col("h").alias("b"), F.col("vec").alias("vec_b"), F.col("norm").alias("norm_b"))
    both = near.join(right, "b").join(left, "a")
    return both.select("a", "b", (dot("vec", "vec_b") / (F.col("norm") * F.col("norm_b"))).alias("cosine")).filter(F.col("cosine") >= min_cosine)


def similar_vectors(df: DataFrame, k: int = 10, min_cosine: float = 0.88, sample: int = 8192, probes: int = 1, bucket_cap: int = 4096, certain: bool = False) -> DataFrame:
    """(path, neighbour, cosine, rank): of each usable path its k most similar others of the same length.

    Neighbours below min_cosine are not looked for; at min_cosine about the share RECALL is found, above it more,
    whatever the number of rows. Equal cosines are ordered by path. Unusable rows (see usable_vectors) neither ask
    nor answer; of several vectors under one path the one with the smallest hash counts; further columns are
    ignored. An empty table gives an empty result. `sample` bounds the rows that fit the rotations; every row is
    indexed. `probes` is the number of flips in which a substring is looked up.
    """
    usable = usable_vectors(df.select("path", "dim", "vec"))
    rows = df.count()
    plan = Plan(min_cosine, probes, width_for(rows), WORDS * 64 if certain else CHECK)
    rotations = fit(usable, rows, sample, plan)
    members = materialize(usable.groupBy("path").agg(F.min("h").alias("h")), "members")
    coded = usable.select("h", "dim", "vec").mapInArrow(_encode(rotations, plan), "h long, dim int, code binary")
    codes = materialize(coded.dropDuplicates(["h"]).join(members.select("h").distinct(), "h", "left_semi"), "codes")
    classes = codes.count()
    if certain:
        words = codes.mapInArrow(_words, "h long, dim int, " + ", ".join(f"c{i} long" for i in range(WORDS)))
        pairs = candidate_pairs(words, classes, min_cosine, probes, bucket_cap)
    else:
        pairs = table_pairs(codes, rotations, classes, plan, k, bucket_cap)

    scored = materialize(_rescored(pairs, usable, min_cosine), "scored")

    first = Window.partitionBy("h").orderBy("path")
    heads = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    own = heads.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(1.0).alias("cosine"))
    directed = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).unionByName(own)
    reach = directed.join(heads.select(F.col("h").alias("b"), F.col("path").alias("neighbour")), "b")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour")
    lists = (
        reach.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        .groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("near"))
    )
    mine = members.join(lists, members["h"] == lists["a"]).select("path", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("path")), 1, k).alias("near"))
    return mine.select("path", F.posexplode("near").alias("at", "x")).select("path", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))


def similar_pairs(df: DataFrame, k: int = 10, min_cosine: float = 0.88, **how) -> DataFrame:
    """(path_a, path_b), path_a < path_b: each pair of which one is among the k nearest of the other."""
    near = similar_vectors(df, k, min_cosine, **how)
    return near.select(F.least("path", "neighbour").alias("path_a"), F.greatest("path", "neighbour").alias("path_b")).distinct()
