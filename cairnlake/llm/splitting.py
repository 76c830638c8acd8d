"""Splitting oversized texts at natural boundaries, with overlap, by pointer doubling.

Every boundary of every text of a batch gets a pointer to the farthest boundary at which a piece that shares
`overlap` characters with the piece before may end. Squaring the pointer table (p <- p[p]) while adding what
the marked boundaries reach derives the cuts of all texts at once, in as many rounds as the logarithm of the
longest chain of pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: Characters of a batch that are cut at a time.
CHUNK = 4_000_000

_SENTENCE_ENDS = np.array([ord(c) for c in ".!?。！？"], dtype=np.uint32)
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside the text before which it may be cut, and their strength: 3 after a blank line,
    2 after a line end, 1 after the end of a sentence, 0 after white space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.isin(c, _SPACES)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # before the first character of a word
    newline = np.flatnonzero(c == 10)
    lines = newline + 1
    at = np.union1d(at, lines[lines < len(c)])
    strength = np.zeros(len(at), dtype=np.int8)
    if len(at):
        gap = np.concatenate([[0], np.flatnonzero(~space) + 1])  # ends of words
        end = gap[np.searchsorted(gap, at, side="right") - 1]
        stop = np.isin(c[np.maximum(end - 1, 0)], _SENTENCE_ENDS) & (end > 0)
        strength[stop] = 1
        breaks = np.searchsorted(newline, at) - np.searchsorted(newline, end)
        strength[breaks == 1] = 2
        strength[breaks > 1] = 3
    return at.astype(np.int64), strength


def cut_all(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Ends of the pieces of each text; the next piece starts `overlap` before the end of the one before."""
    step = limit - overlap
    pos, kind, final, base = [], [], [], 0
    first = []
    for t in texts:
        n = len(t)
        at, strength = boundaries(t)
        keep = at > overlap
        at, strength = at[keep], strength[keep]
        # a virtual cut at `overlap`, from which the first piece starts at 0; then cuts by length where no
        # boundary is within reach
        edge = np.concatenate([[overlap], at, [n]])
        more = [np.arange(a + step, b, step) for a, b in zip(edge[:-1], edge[1:]) if b - a > step]
        hard = np.concatenate(more) if more else np.zeros(0, dtype=np.int64)
        p = np.concatenate([[overlap], at, hard, [max(n, overlap + 1)]])
        s = np.concatenate([[-2], strength, np.full(len(hard), -1), [4]]).astype(np.int8)
        order = np.argsort(p, kind="stable")
        first.append(sum(map(len, pos)))
        pos.append(p[order] + base)
        kind.append(s[order])
        final.append(np.full(len(p), base + max(n, overlap + 1)))
        base += max(n, overlap + 1) + limit + overlap + 1
    if not texts:
        return []
    p, s, end = np.concatenate(pos), np.concatenate(kind), np.concatenate(final)
    reach = np.minimum(p + step, end)
    succ = np.searchsorted(p, reach, side="right") - 1  # the farthest legal one of any kind
    todo = end > p + step
    for level in (3, 2, 1, 0):  # the strongest kind in the second half of the reach goes first
        here = np.flatnonzero(s == level)
        if len(here) and todo.any():
            k = np.searchsorted(p[here], reach, side="right") - 1
            good = todo & (k >= 0) & (p[here][np.maximum(k, 0)] > p + step // 2)
            succ[good] = here[k[good]]
            todo &= ~good
    last = np.searchsorted(p, end)
    succ = np.where(succ <= np.arange(len(p)), np.minimum(np.arange(len(p)) + 1, last), succ)
    marked = np.zeros(len(p), dtype=bool)
    marked[first] = True
    pointer = succ
    while True:
        grown = marked.copy()
        grown[pointer[marked]] = True
        if (grown == marked).all():
            break
        marked, pointer = grown, pointer[pointer]
    out = []
    for i, f in enumerate(first):
        stop = first[i + 1] if i + 1 < len(first) else len(p)
        own = np.flatnonzero(marked[f:stop])[1:] + f
        out.append(np.minimum(p[own] - (end[f] - max(len(texts[i]), overlap + 1)), len(texts[i])))
    return out


def split_texts(items: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece, pieces, start, end, text): the pieces of each text that is longer than limit characters.

    A piece has at most limit characters and, but for the first, starts overlap characters before the end of
    the piece before. It ends after a blank line, else a line, a sentence or white space if one lies in the
    second half of its reach, else at the farthest boundary, else at the limit. Null texts and texts within
    the limit give no rows; repeated rows are cut each.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    kinds = dict(items.dtypes)
    long = items.filter(F.length(text) > limit).select(*keys, F.col(text).alias("_text"))
    names = [*keys, "piece", "pieces", "start", "end", "text"]

    def run(batches):
        for b in batches:
            sizes = np.cumsum(pa.compute.binary_length(b.column(len(keys))).to_numpy())
            at = 0
            while at < b.num_rows:  # a bounded amount of text at a time
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
                part = b.slice(at, upto - at)
                texts = part.column(len(keys)).to_pylist()
                ends = cut_all(texts, limit, overlap)
                row = np.repeat(np.arange(len(texts)), [len(e) for e in ends])
                no = np.concatenate([np.arange(len(e)) for e in ends]).astype(np.int32)
                stop = np.concatenate(ends).astype(np.int32)
                start = np.where(no == 0, 0, np.roll(stop, 1) - overlap).astype(np.int32)
                total = np.repeat([len(e) for e in ends], [len(e) for e in ends]).astype(np.int32)
                pieces = [texts[r][x:y] for r, x, y in zip(row, start, stop)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(row)) for i in range(len(keys))], pa.array(no), pa.array(total), pa.array(start), pa.array(stop), pa.array(pieces, pa.string())], names)
                at = upto

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece int, pieces int, start int, end int, text string"
    return long.mapInArrow(run, schema)


def plain_lines(body: Column) -> Column:
    """The body with one carriage return removed from the end of each line."""
    joined = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.endswith(joined, F.lit("\r")), F.substring(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined)


def oversized_items(nodes: DataFrame, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(path, node_id, start_line, end_line, text): chunks whose lines in the docs body exceed the limit, and
    whole bodies over it (node_id -1, lines null) of paths that have no chunk.

    A chunk's text is lines start_line to end_line of the body of its path, both included, counted from 0;
    lines before 0 or behind the end are left out. Chunks with a null line, start_line > end_line or without
    a body are none. Rows delivered twice count once; of several bodies under one path the one with the
    largest hash counts. Lengths of lines decide before any text is moved.
    """
    lines = F.split(F.col("body"), "\n", -1)
    bodies = docs.filter("path IS NOT NULL AND body IS NOT NULL").select("path", plain_lines(F.col("body")).alias("body"), F.xxhash64("body").alias("h"))
    shape = F.struct("h", F.when(F.length("body") > limit, F.transform(lines, F.length)).alias("lens")).alias("m")
    shapes = bodies.select("path", shape).groupBy("path").agg(F.max_by("m", "m.h").alias("m")).select("path", "m.h", "m.lens")
    refs = nodes.select("path", F.col("id").alias("node_id"), "start_line", "end_line").filter("path IS NOT NULL AND start_line <= end_line AND end_line >= 0")
    refs = refs.withColumn("a", F.greatest("start_line", F.lit(0))).withColumn("n", F.col("end_line") - F.col("a") + 1)
    lens = F.slice("lens", F.col("a") + 1, "n")
    total = F.aggregate(lens, F.lit(0), lambda s, x: s + x + 1) - 1
    big = refs.join(shapes.filter("lens IS NOT NULL"), "path").filter(total > limit).select("path", "node_id", "start_line", "end_line", "a", "n", "h").distinct()
    whole = (
        shapes.filter("lens IS NOT NULL").join(nodes.select("path").distinct(), "path", "left_anti")
        .select("path", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(0).alias("a"), F.size("lens").alias("n"), "h")
    )
    wanted = big.unionByName(whole)
    texts = bodies.filter(F.length("body") > limit).groupBy("path", "h").agg(F.max("body").alias("body"))
    text = F.array_join(F.slice(lines, F.col("a") + 1, F.col("n")), "\n")
    return wanted.join(texts, ["path", "h"]).select("path", "node_id", "start_line", "end_line", text.alias("text"))


def pieces_of(nodes: DataFrame, docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized chunk and body."""
    return split_texts(oversized_items(nodes, docs, limit), ["path", "node_id", "start_line", "end_line"], "text", limit, overlap)
