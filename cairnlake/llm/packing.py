"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths (capacity + 1 numbers) reaches the driver. There combinations of up to `depth`
lengths that fill a container are enumerated on a grid of `grid` steps, non-negative least squares finds how
often to repeat each so that together they use up the histogram, the counts are rounded down, and what is
left over is packed greedily, longest first, into the tightest space. The outcome is a list of container
patterns with repeat counts, whose size depends on the capacity, not on the number of items. Items find
their container by their rank among the items of their length, which is computed without collecting them.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def combinations(steps: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 1..depth positive numbers that sum to steps."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, have: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(have)
        elif len(have) < depth:
            for x in range(min(rest, most), -(-rest // (depth - len(have))) - 1, -1):
                grow(rest - x, x, (*have, x))

    grow(steps, steps, ())
    return out


def plan_containers(histogram: dict[int, int], capacity: int, depth: int = 3, grid: int = 64) -> list[tuple[Counter, int]]:
    """[(lengths in a container with their counts, number of such containers)], using up the histogram."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if 0 < k <= capacity and v > 0})
    if not left:
        return []
    grid = min(grid, capacity)
    width = capacity / grid
    cell = lambda n: int(np.ceil(n / width))
    bins: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        bins[cell(n)].append(n)
    target = np.zeros(grid)
    for n, c in left.items():
        target[cell(n) - 1] += c
    shapes = combinations(grid, depth)
    use = np.zeros((grid, len(shapes)))
    for j, shape in enumerate(shapes):
        for s in shape:
            use[s - 1, j] += 1
    weight = np.where(np.arange(grid) < grid // 8, 1e-3, 1.0)  # short items fill any gap later
    counts = np.floor(nnls(use * weight[:, None], target * weight) + 1e-6).astype(np.int64)

    groups: list[tuple[Counter, int]] = []

    def take(b: int, most: int) -> tuple[int, int]:
        """The longest length left in cell b and how many of it, up to most."""
        while bins[b] and left[bins[b][-1]] == 0:
            bins[b].pop()
        if not bins[b]:
            return 0, 0
        return bins[b][-1], min(most, left[bins[b][-1]])

    for j in np.argsort(-counts):
        need = int(counts[j])
        while need > 0:
            have, many = Counter(), need
            for s, q in Counter(shapes[j]).items():
                n, m = take(s, need * q)
                if m < q:  # not enough of one length for one container: mix lengths one by one below
                    many = 0
                    break
                have[n] += q
                many = min(many, m // q)
            if many == 0:
                have, many = Counter(), 1
                for s in shapes[j]:
                    n, m = take(s, 1)
                    if m:
                        have[n] += 1
                        left[n] -= 1
                if sum(have.values()) < len(shapes[j]):  # the cell has no more: what was taken is packed below
                    for n, q in have.items():
                        left[n] += q
                        if n not in bins[cell(n)]:
                            bins[cell(n)].append(n)
                    break
            else:
                for n, q in have.items():
                    left[n] -= q * many
            groups.append((have, many))
            need -= many

    space: list[int] = []
    by_space: dict[int, list[tuple[Counter, int]]] = defaultdict(list)

    def put(have: Counter, many: int, room: int) -> None:
        if many > 0:
            if not by_space[room]:
                bisect.insort(space, room)
            by_space[room].append((have, many))

    for have, many in groups:
        put(have, many, capacity - sum(n * q for n, q in have.items()))
    for n in sorted(left, reverse=True):
        c = left[n]
        while c > 0:
            at = bisect.bisect_left(space, n)
            if at == len(space):
                q = capacity // n
                full, rest = divmod(c, q)
                put(Counter({n: q}), full, capacity - n * q)
                if rest:
                    put(Counter({n: rest}), 1, capacity - n * rest)
                break
            room = space[at]
            have, many = by_space[room].pop()
            if not by_space[room]:
                space.pop(at)
            q = min(room // n, max(1, c // many))
            m = min(many, c // q)
            put(have, many - m, room)
            put(have + Counter({n: q}), m, room - n * q)
            c -= q * m
    return [g for room in space for g in by_space[room]]


def intervals(groups: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and the containers that they go to, sorted by (length, first rank)."""
    rows, at, base = [], Counter(), 0
    for have, many in groups:
        for n, q in have.items():
            rows.append((n, at[n], base, many))
            at[n] += q * many
        base += many
    rows.sort()
    t = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": t[:, 0] * (1 << 44) + t[:, 1], "from": t[:, 1], "base": t[:, 2], "many": t[:, 3]}


def fill_containers(sizes: DataFrame, capacity: int, key: str = "doc_id", n: str = "n", depth: int = 3, grid: int = 64, rank_block: int = 100_000) -> DataFrame:
    """(key, piece, pieces, first, size, container_id) for a table of items and their sizes.

    Items are kept whole in one container; one larger than the capacity is cut into pieces of the capacity
    and a remainder, which is packed like any item. Every container holds at most `capacity`. Items of size
    0, null or below need no room: one row with container_id null. Repeated rows are items of their own; rows
    with a null key are items too. The plan on the driver has at most a few rows per possible length.
    """
    kind = dict(sizes.dtypes)[key]
    size = F.greatest(F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    cut = sizes.select(F.col(key).alias("k"), size.alias("all")).withColumn("pieces", F.greatest(F.ceil(F.col("all") / capacity), F.lit(1)).cast("int"))
    items = materialize(
        cut.select("k", "all", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        .withColumn("first", F.col("piece") * F.lit(capacity).cast("long"))
        .withColumn("size", F.least(F.col("all") - F.col("first"), F.lit(capacity)).cast("int")).drop("all"),
        "items",
    )
    total = items.count()
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    table = items.sparkSession.sparkContext.broadcast(intervals(plan_containers(histogram, capacity, depth, grid)))

    block = F.pmod(F.xxhash64("k", "piece"), F.lit(max(1, -(-total // rank_block)))).cast("int")
    held = items.withColumn("block", block)
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("size", "block").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("size", "block").orderBy("k", "piece")
    ranked = held.withColumn("nth", F.row_number().over(within)).join(offsets, ["size", "block"]).withColumn("rank", F.col("ahead") + F.col("nth") - 1)

    def place(batches):
        t = table.value
        for b in batches:
            length, rank = b.column("size").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            if len(t["key"]):
                at = np.maximum(np.searchsorted(t["key"], length * (1 << 44) + rank, side="right") - 1, 0)
                where = t["base"][at] + (rank - t["from"][at]) % t["many"][at]
            else:
                where = np.zeros(len(rank), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("k", "piece", "pieces", "first", "size")] + [pa.array(where, mask=length <= 0)], [key, "piece", "pieces", "first", "size", "container_id"]
            )

    schema = f"`{key}` {kind}, piece int, pieces int, first long, size int, container_id long"
    return ranked.select("k", "piece", "pieces", "first", "size", "rank").mapInArrow(place, schema)
