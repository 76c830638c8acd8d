"""Encoding of texts with a public byte-level BPE tokenizer, as a tree reduction.

A text is halved until its parts are short, the parts are encoded on their own, and neighbours are joined by
re-encoding a window around their border. The tokenizer first cuts a text into words by a pattern that never
looks back, and merges bytes only within a word. So once a word boundary of the re-encoded window falls on
one of the right part's own boundaries, every later token of the right part is certain to stand; tokens left
of a boundary that lies clear of the left part's end stand as well. If no such boundary lies in the window,
it is doubled, at worst to both whole parts. Decoding joins the bytes of the ids in order.

Texts of more than PART characters are cut into rows of that length, encoded by as many tasks, and joined up the same
tree; where a text is cut makes no difference to its ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie on every machine; a parameter of each operator here.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the word pattern published with the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
WINDOW = 24
#: Characters of a text that one task encodes.
PART = 1 << 18
#: The pattern looks at most this far past the end of a word, apart from runs of white space.
LOOKAHEAD = 4


@lru_cache(maxsize=4)
def load(name: str, folder: str) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_words = regex.compile(PATTERN)


def _starts(text: str) -> list[int]:
    return [m.start() for m in _words.finditer(text)]


class Part:
    """An encoded stretch of text with the positions at which its words start."""

    __slots__ = ("ids", "starts", "text")

    def __init__(self, text: str, ids: list[int], starts: list[int]):
        self.text, self.ids, self.starts = text, ids, starts


def _ids(enc: tiktoken.Encoding, text: str, starts: list[int], end: int) -> list[int]:
    """The ids of text[:end], whose words start at `starts`; word by word, as the pattern looks ahead."""
    cuts = [*starts, end]
    return [t for a, b in zip(cuts[:-1], cuts[1:]) for t in enc.encode_ordinary(text[a:b])]


def join(enc: tiktoken.Encoding, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The encoding of left.text + right.text."""
    if not left.text or not right.text:
        return right if not left.text else left
    n, m = len(left.text), len(right.text)
    while True:
        at = bisect_right(left.starts, n - max(window, LOOKAHEAD)) - 1
        i = left.starts[at] if at >= 0 else 0
        e = min(m, window)
        seam = left.text[i:] + right.text[:e]
        begun = _starts(seam)
        sure = len(seam) if e == m else len(seam) - LOOKAHEAD
        for p in begun[bisect_left(begun, n - i) :]:
            j = p - (n - i)
            k = bisect_left(right.starts, j)
            if p <= sure and k < len(right.starts) and right.starts[k] == j:
                before = [x for x in begun if x < p]
                kept = len(left.ids) - len(enc.encode_ordinary(left.text[i:]))
                gone = len(_ids(enc, right.text, right.starts[:k], j))
                ids = left.ids[:kept] + _ids(enc, seam, before, p) + right.ids[gone:]
                starts = left.starts[: max(at, 0)] + [i + x for x in before] + [n + x for x in right.starts[k:]]
                return Part(left.text + right.text, ids, starts)
        if e == m and window >= m:
            kept = len(left.ids) - len(enc.encode_ordinary(left.text[i:]))
            return Part(left.text + right.text, left.ids[:kept] + enc.encode_ordinary(seam), left.starts[: max(at, 0)] + [i + x for x in begun])
        window *= 2


def encode_part(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> Part:
    if len(text) <= leaf:
        return Part(text, enc.encode_ordinary(text), _starts(text))
    half = len(text) // 2
    return join(enc, encode_part(enc, text[:half], leaf), encode_part(enc, text[half:], leaf))


def encode(enc: tiktoken.Encoding, text: str | None, leaf: int = LEAF) -> list[int]:
    """Ids of one text; none for an empty or null text."""
    if not text:
        return []
    return enc.encode_ordinary(text) if len(text) <= leaf else encode_part(enc, text, leaf).ids


def decode(enc: tiktoken.Encoding, ids: list[int]) -> str:
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def _join_all(enc: tiktoken.Encoding, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join(enc, a, b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def _long_ids(long: DataFrame, text: str, tokenizer: str, folder: str, part: int) -> DataFrame:
    """(_text, ids) of each different text, known by its SHA-256, encoded part by part."""
    number = F.sequence(F.lit(0), F.ceil(F.length(text) / part).cast("int") - 1)
    cut = long.select("_text", F.posexplode(F.transform(number, lambda i: F.substring(F.col(text), i * part + 1, F.lit(part)))).alias("n", "text"))
    one = cut.groupBy("_text", "n").agg(F.first("text").alias("text"))

    def encoded(batches):
        enc = load(tokenizer, folder)
        for b in batches:
            made = [encode_part(enc, t) for t in b.column("text").to_pylist()]
            lists = [pa.array([x.ids for x in made], pa.list_(pa.int32())), pa.array([x.starts for x in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], ["_text", "n", "text", "ids", "starts"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        parts = [Part(t, i, s) for t, i, s in zip(*(table[c].to_pylist() for c in ("text", "ids", "starts")))]
        return pa.table([table["_text"][:1], pa.array([_join_all(load(tokenizer, folder), parts).ids], pa.list_(pa.int32()))], ["_text", "ids"])

    return one.mapInArrow(encoded, "_text string, n int, text string, ids array<int>, starts array<int>").groupBy("_text").applyInArrow(joined, "_text string, ids array<int>")


def _split(df: DataFrame, key: str, text: str, part: int) -> tuple[DataFrame, DataFrame]:
    """Rows of one part (key, text), and of several (key, text, _text)."""
    several = F.coalesce(F.length(text) > part, F.lit(False))
    return df.filter(~several).select(key, text), df.filter(several).select(key, text, F.sha2(F.col(text), 256).alias("_text"))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, part: int = PART) -> DataFrame:
    """(key, ids): one row per row of df; an empty list for null and empty texts. Strings that look like
    special tokens are ordinary text. Repeated rows stay repeated; other columns are not read."""
    kind = dict(df.dtypes)[key]
    short, long = _split(df, key, text, part)

    def run(batches):
        enc = load(tokenizer, folder)
        for b in batches:
            lists = [encode(enc, t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    plain = short.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
    return plain.unionByName(long.select(key, "_text").join(_long_ids(long, text, tokenizer, folder, part), "_text").select(key, "ids"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, part: int = PART) -> DataFrame:
    """(key, n): the number of ids of each text, 0 for null and empty ones."""
    kind = dict(df.dtypes)[key]
    short, long = _split(df, key, text, part)

    def run(batches):
        enc = load(tokenizer, folder)
        for b in batches:
            n = np.fromiter((len(encode(enc, t)) for t in b.column(1).to_pylist()), dtype=np.int32, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], [key, "n"])

    counted = _long_ids(long, text, tokenizer, folder, part).select("_text", F.size("ids").alias("n"))
    return short.mapInArrow(run, f"`{key}` {kind}, n int").unionByName(long.select(key, "_text").join(counted, "_text").select(key, "n"))
