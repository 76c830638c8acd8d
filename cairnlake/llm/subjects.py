"""Subject areas of documents by class-association rules.

1. Every text is cut once into sentences (list items, turns, comments), and these into numbers of words, spelt so that
   swapped letters don't matter. All later steps read that table of numbers.
2. Rules of one item (a word) are counted. Then parallel frequent-pattern growth: every word that is not settled grows
   by the words of its conditional pattern base, sharded by word, to any length; pairs of neighbouring words are items
   of their own. A word or pattern is settled if its subject is so sure that no rule can be surer by GAIN, and no other
   subject has enough of its sentences for a rule (support counts the sentences with the items and the subject). Growth skips what lies in all sentences of a pattern (the words of
   one phrase collapse to one closed set).
3. A rule items -> subject has its smoothed confidence as evidence. It is redundant unless it is surer by GAIN than
   each part of its items (minimum improvement).
4. A sentence has the subject for which its rules give the most evidence, if that reaches a threshold chosen on
   labelled documents that are never mined; a document has each subject of at least a third of its sentences.
5. Hand labels cover few documents and words. So the rules mined from them score all documents, and the
   documents that got exactly one subject are the examples of the next round, which covers every word.

What is broadcast are rules: a word needs `share` of the sentences, so there are at most the mean number of words of a
sentence / share of them; a pattern needs MIN_PATTERN.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

NONE = "-"
PART = 1 / 3
#: Least share of the sentences that must hold a pattern of several items.
MIN_PATTERN = 1e-4
#: By how much a rule must be surer than the rules of a part of its items.
GAIN = 0.1
#: Evidence from which a rule counts, and the sentences (spread evenly) that smooth it.
SURE, STRENGTH = 0.5, 2.0
#: Every so manyth labelled document chooses thresholds and is not mined.
HELD_OUT = 5

_hidden = regex.compile(r"[^\P{C}\n\t]")
_tag = re.compile(r"<[^<>\n]{1,200}>")
_comment = re.compile(r"^\s*(?://+|#+|/\*+|\*+/?|--|;+|\"\"\"|''')\s*")
_lead = re.compile(r"^\s*(?:\[[\d:. ]+\]|[-*+•>]+|\d+[.)]|\|)\s*")
_turn = re.compile(r"^\s*(?:user|assistant|system|tool|human|agent)\s*:\s*", re.I)
_heading = re.compile(r"^\s*#{1,6}\s+\S+(?:\s+\d+)?\s*$|^\s*#{1,6}\s+[^.!?]*$")
_end = re.compile(r"(?<=[.!?…。！？])[\"'”»)]*\s+")
_word = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=200_000)
def _spelling(word: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return plain if len(plain) < 4 else "".join(sorted(plain))


def _spoken(text: str | None, kind: str | None):
    """The sentences of a text with their words; of code, those of its comments."""
    if not text:
        return
    text = _hidden.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = html.unescape(_tag.sub("\n" if kind != "code" else " ", text))
    for line in text.split("\n"):
        if kind == "code":
            m = _comment.match(line)
            if not m:
                continue
            line = line[m.end() :]
        elif "#" in line and _heading.match(line):
            continue
        while m := _lead.match(line) or (_turn.match(line) if ":" in line else None):
            line = line[m.end() :]
        for s in _end.split(line.strip().strip("*_`")):
            words = _word.findall(s.lower())
            if words and len(max(words, key=len)) >= 3:
                yield s, words


def sentences(text: str | None, kind: str | None) -> list[str]:
    """The sentences of a text; of code, those of its comments. Headings, rules and dumps are none."""
    return [s for s, _ in _spoken(text, kind)]


def items(sentence: str) -> list[str]:
    """Distinct words and pairs of neighbouring words."""
    w = [_spelling(x) for x in _word.findall(sentence.lower())]
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w[:-1], w[1:]))]))


# --- numbers of items: a word is the upper half of a long, the second word of a pair the lower half


@lru_cache(maxsize=1 << 20)
def _number(word: str) -> int:
    return zlib.crc32(_spelling(word).encode()) & 0x7FFFFFFF or 1


def item_number(item: str) -> int:
    """Of an item as items() spells it; words that share a hash of 31 bits are one word."""
    a, _, b = item.partition(" ")
    hashed = [(zlib.crc32(x.encode()) & 0x7FFFFFFF or 1) if x else 0 for x in (a, b)]
    return hashed[0] << 32 | hashed[1]


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, tongue, code, lens, words) of every row: number of words of each sentence, and all of them in a row;
    tongue is the first two letters of lang, code says that the row is code with a text."""
    key = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            lens, words = [], []
            for text, kind in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                cut = [[_number(w) for w in ws] for _, ws in _spoken(text, kind)]
                lens.append([len(x) for x in cut])
                words.append([i for x in cut for i in x])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(lens, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], ["doc_id", "tongue", "code", "lens", "words"])

    tongue = F.lower(F.substring(F.coalesce("lang", F.lit("??")), 1, 2)).alias("tongue")
    code = (F.col("kind").eqNullSafe("code") & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("code")
    return docs.select("doc_id", tongue, "text", "kind", code).mapInArrow(run, f"doc_id {key}, tongue string, code boolean, lens array<int>, words array<int>")


class Batch:
    """The sentences of a batch of tokenized rows as flat arrays."""

    def __init__(self, b: pa.RecordBatch):
        lens, words = b.column("lens"), b.column("words")
        self.size = b.num_rows
        self.per_doc = np.diff(lens.offsets.to_numpy())
        self.lens = lens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(self.size), self.per_doc)
        self.sentence = np.repeat(np.arange(len(self.lens)), self.lens)

    def pairs(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, item) of neighbouring words that are both ok."""
        at = np.flatnonzero(ok[:-1] & ok[1:] & (self.sentence[:-1] == self.sentence[1:])) if len(ok) else np.zeros(0, dtype=np.int64)
        return self.sentence[at], self.words[at] << 32 | self.words[at + 1 if len(at) else at]


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of x in a sorted table, -1 where it is not in it."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


@dataclass
class Rules:
    """Rules (items, subject, evidence) in arrays. Of a rule of several items the first one, its rarest, is looked up."""

    subjects: list[str] = field(default_factory=list)
    rules: list[tuple[tuple[int, ...], int, float]] = field(default_factory=list)

    def __post_init__(self):
        # evidence and subject in one number, so that the larger one wins; of equal evidence the later subject
        value = lambda s, e: round(e * 1_000_000) * 64 + s
        one: dict[int, int] = {}
        for x, s, e in self.rules:
            if len(x) == 1:
                one[x[0]] = max(one.get(x[0], 0), value(s, e))
        self.one = np.array(sorted(one), dtype=np.int64)
        self.one_value = np.array([one[i] for i in self.one.tolist()], dtype=np.int64)
        several = sorted((x, value(s, e)) for x, s, e in self.rules if len(x) > 1)
        self.lead, self.lead_first, self.lead_many = np.unique(np.array([x[0] for x, _ in several], dtype=np.int64), return_index=True, return_counts=True)
        self.several_value = np.array([v for _, v in several], dtype=np.int64)
        self.need = np.array([len(x) - 1 for x, _ in several], dtype=np.int64)
        self.begin = np.cumsum(self.need) - self.need
        rest = np.array([i for x, _ in several for i in x[1:]], dtype=np.int64)
        self.others, self.rest = np.unique(rest, return_inverse=True)
        second = {i for x in one if (i := x & 0xFFFFFFFF)}
        self.paired = np.array(sorted({i for x in one if x & 0xFFFFFFFF for i in (x >> 32, x & 0xFFFFFFFF)} | second), dtype=np.int64)

    def evidence(self, t: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(subject, evidence x 1e6) of each sentence; 0 evidence if it has no rule."""
        best = np.zeros(len(t.lens), dtype=np.int64)
        if not len(t.words) or not self.rules:
            return best % 64, best // 64
        whole = t.words << 32
        at = _find(self.one, whole)
        np.maximum.at(best, t.sentence[at >= 0], self.one_value[at[at >= 0]])
        if len(self.paired):
            where, item = t.pairs(_find(self.paired, t.words) >= 0)
            at = _find(self.one, item)
            np.maximum.at(best, where[at >= 0], self.one_value[at[at >= 0]])
        if len(self.lead):
            at = _find(self.lead, whole)
            hit = np.flatnonzero(at >= 0)
            many = self.lead_many[at[hit]]
            where = np.repeat(t.sentence[hit], many)
            rule = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.lead_first[at[hit]], many)
            # (sentence, item) of the items that rules need besides their first, as one sorted array
            place = _find(self.others, whole)
            some = np.flatnonzero(place >= 0)
            held = np.sort(t.sentence[some] * len(self.others) + place[some])
            for k in range(self.need.max()):
                more = self.need[rule] > k
                want = where * len(self.others) + self.rest[np.where(more, self.begin[rule] + k, 0)]
                ok = ~more | (_find(held, want) >= 0)
                where, rule = where[ok], rule[ok]
            np.maximum.at(best, where, self.several_value[rule])
        return best % 64, best // 64

    def decide(self, t: Batch, threshold: float, part: float = PART) -> np.ndarray:
        """(documents, subjects): which subjects at least a part of a document's sentences have."""
        s, e = self.evidence(t)
        named = e >= round(threshold * 1_000_000)
        count = np.bincount(t.doc[named] * len(self.subjects) + s[named], minlength=t.size * len(self.subjects)).reshape(t.size, -1)
        return (count > 0) & (count >= part * t.per_doc[:, None] - 1e-9)


# --- mining


class Classes:
    """Classes are pairs of a language and a subject; each subject weighs as if it had as many sentences of a language."""

    def __init__(self, total: dict[tuple[str, str], int], subjects: list[str]):
        self.names = sorted(total)
        self.subjects = subjects
        self.n = sum(total.values())
        k = len(subjects)
        spoken: Counter = Counter()
        for (t, _), c in total.items():
            spoken[t] += c
        self.weights = np.zeros((len(self.names), k))
        self.plain = np.zeros((len(self.names), k))
        for i, (t, s) in enumerate(self.names):
            self.plain[i, subjects.index(s)] = 1
            self.weights[i, subjects.index(s)] = spoken[t] / k / max(total[t, s], spoken[t] / k / 20)
        self.even = STRENGTH / max(k, 1)
        self.real = np.array([s != NONE for s in subjects])

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """(items, subjects) smoothed confidence from (items, classes)."""
        k = counts @ self.weights
        return np.where(self.real, (k + self.even) / (k.sum(1, keepdims=True) + STRENGTH), 0.0)

    def open(self, counts: np.ndarray, e: np.ndarray, support: int) -> np.ndarray:
        """Whether more items can still make a rule: another subject than the top one has the support of a rule, or
        the top one has it and can become surer by GAIN."""
        many = (counts @ self.plain >= support) & self.real
        top = e.argmax(1)
        other = many.copy()
        other[np.arange(len(e)), top] = False
        return other.any(1) | (many[np.arange(len(e)), top] & (e.max(1) < 1 - GAIN))


def _counted(told: DataFrame, name: str) -> DataFrame:
    """(item, cls, n) summed over all batches."""
    return materialize(told.groupBy("item", "cls").agg(F.sum("n").alias("n")), name)


#: A row for the number of sentences of a class stands under this item.
SENTENCES = 0


#: Languages that fewer rows have.
OTHER = ""


def _class_rows(marked, names: list[tuple[str, str]]):
    """Sentences of mined rows: (batch, class of each sentence, -1 if its row isn't mined)."""
    index, known = {c: i for i, c in enumerate(names)}, {t for t, _ in names}
    for b, subject in marked:
        t = Batch(b)
        tongue = b.column("tongue").to_pylist()
        row = np.array([index.get((l if l in known else OTHER, s), -1) if s is not None else -1 for l, s in zip(tongue, subject)], dtype=np.int64)
        yield t, row[t.doc] if t.size else np.zeros(0, dtype=np.int64)


def _labelled(batches):
    for b in batches:
        yield b, b.column("subject").to_pylist()


def _scored(shared):
    """Rows with at most one subject by rules are examples of it, or of none; code is none."""

    def run(batches):
        rules, threshold = shared.value
        names = [*rules.subjects, NONE]
        for b in batches:
            got = rules.decide(Batch(b), threshold)
            n = got.sum(1)
            first = np.where(n == 1, got.argmax(1), len(names) - 1)
            told = [names[i] if k <= 1 and not c else None for i, k, c in zip(first.tolist(), n.tolist(), b.column("code").to_pylist())]
            yield b, told

    return run


def _word_counts(mark, tongues: list[str], subjects: list[str]):
    names = [(t, s) for t in tongues for s in subjects]

    def run(batches):
        for t, cls in _class_rows(mark(batches), names):
            ok = cls >= 0
            per = np.bincount(cls[ok], minlength=len(names))
            some = np.flatnonzero(per)
            mine = ok[t.sentence]
            where, (place, value) = t.sentence[mine], pd.factorize(t.words[mine])
            word = pd.unique(where * max(len(value), 1) + place)  # a word counts once a sentence
            s, v = word // max(len(value), 1), word % max(len(value), 1)
            group, key = pd.factorize(v * len(names) + cls[s])
            n = np.bincount(group, minlength=len(key))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(some), SENTENCES), value[key // len(names)] << 32]).astype(np.int64)),
                pa.array(np.concatenate([some, key % len(names)]).astype(np.int32)), pa.array(np.concatenate([per[some], n]).astype(np.int64)),
            ], ["item", "cls", "n"])

    return run


#: Shards of items; a sentence goes to those of its items.
SHARDS = 1024


def _conditional(mark, names: list[tuple[str, str]], growing: np.ndarray):
    """Rows (shard, cls, ids, n): sentences as the ranks of their growing words, cut behind each word for the shard of
    that word; and pairs of neighbouring growing words, as a rank -1 and their number."""
    order = np.argsort(growing)
    table = growing[order]

    def run(batches):
        for t, cls in _class_rows(mark(batches), names):
            at = _find(table, t.words << 32)
            ok = (at >= 0) & (cls[t.sentence] >= 0)
            where, item = t.pairs(ok)
            place, value = pd.factorize(item)
            once = pd.unique(where * max(len(value), 1) + place)
            group, key = pd.factorize(once % max(len(value), 1) * len(names) + cls[once // max(len(value), 1)])
            pair = zip(value[key // len(names)].tolist(), (key % len(names)).tolist(), np.bincount(group, minlength=len(key)).tolist())
            rows = [(i % SHARDS, c, (-1, i), m) for i, c, m in pair]
            seen = np.sort(pd.unique(t.sentence[ok] * max(len(table), 1) + order[at[ok]]))
            s, r = seen // max(len(table), 1), (seen % max(len(table), 1)).tolist()
            cut = np.flatnonzero(np.diff(s, prepend=-1))
            ends = np.append(cut[1:], len(s))
            whole = Counter((c, tuple(r[i:j])) for c, i, j in zip(cls[s[cut]].tolist(), cut.tolist(), ends.tolist()))
            cuts: Counter = Counter()
            for (c, ids), m in whole.items():
                sent = set()
                for p in range(len(ids) - 1, 0, -1):
                    if (g := ids[p] % SHARDS) not in sent:
                        sent.add(g)
                        cuts[g, c, ids[: p + 1]] += m
            rows += [(g, c, ids, m) for (g, c, ids), m in cuts.items()]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int64())], ["shard", "cls", "ids", "n"])

    return run


class Base:
    """A conditional pattern base: sentences with class and count, as flat arrays of (sentence, item)."""

    def __init__(self, row: np.ndarray, item: np.ndarray, cls: np.ndarray, n: np.ndarray):
        self.row, self.item, self.cls, self.n = row, item, cls, n

    def counts(self, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, their counts by class)."""
        items_, place = np.unique(self.item, return_inverse=True)
        flat = np.bincount(place * classes + self.cls[self.row], weights=self.n[self.row], minlength=len(items_) * classes)
        return items_, flat.reshape(len(items_), classes)

    def given(self, item: int, among: np.ndarray) -> Base:
        """The sentences with the item, of their other items those in `among`; equal ones become one."""
        rows = np.zeros(len(self.cls), dtype=bool)
        rows[self.row[self.item == item]] = True
        keep = rows[self.row] & (_find(among, self.item) >= 0)
        return Base(*self._packed(self.row[keep], self.item[keep]))

    def _packed(self, row, item):
        kept, row = np.unique(row, return_inverse=True)
        return row, item, self.cls[kept], self.n[kept]


def patterns(base: Base, at: tuple[int, ...], n: float, support: int, classes: Classes):
    """(pattern, evidence by subject, 0 where it has no support) of every pattern that extends `at` by items of its base."""
    found, counts = base.counts(len(classes.names))
    m = counts.sum(1)
    # an item of all sentences of `at` adds nothing to it or to anything grown from it
    keep = (m >= support) & (m != n)
    found, counts, m = found[keep], counts[keep], m[keep]
    e = classes.evidence(counts)
    grows = classes.open(counts, e, support)
    e[counts @ classes.plain < support] = 0
    for x, i in enumerate(found.tolist()):
        here = (*at, i)
        yield here, e[x]
        if grows[x] and x:
            yield from patterns(base.given(i, found[:x]), here, m[x], support, classes)


def _grow(growing: np.ndarray, alone: np.ndarray, classes: Classes, support: int, least: int):
    """The rules of a shard: (items, the rarest first, subject, e). alone has the evidence of the growing words by themselves."""

    def rules(table: pa.Table):
        shard = table["shard"][0].as_py()
        ids = table["ids"].combine_chunks()
        cls, n = table["cls"].to_numpy(), table["n"].to_numpy()
        length = np.diff(ids.offsets.to_numpy())
        row, item = np.repeat(np.arange(len(cls)), length), ids.flatten().to_numpy()
        first = item[np.cumsum(length) - length]
        paired = first == -1
        if paired.any():
            second = item[np.cumsum(length)[paired] - 1]
            names, place = np.unique(second, return_inverse=True)
            c = np.zeros((len(names), len(classes.names)))
            np.add.at(c, (place, cls[paired]), n[paired])
            e = classes.evidence(c)
            for x, k, by in zip(names.tolist(), c.sum(1), e):
                if k >= least and by.max() >= SURE:
                    yield (x,), int(by.argmax()), float(by.max())
        for i in np.unique(item[(item % SHARDS == shard) & ~paired[row]]).tolist():
            rows = np.zeros(len(cls), dtype=bool)
            rows[row[(item == i) & ~paired[row]]] = True
            keep = rows[row] & (item < i)
            base = Base(*Base(row, item, cls, n)._packed(row[keep], item[keep]))
            best = {(i,): alone[i]}
            for x, e in patterns(base, (i,), -1, support, classes):
                best[x] = e
                s = int(e.argmax())
                # the parts that lie on the way here; _mine() looks at the others
                if e[s] >= SURE and e[s] >= GAIN + max(max(alone[j][s] for j in x), *(best[x[:k]][s] for k in range(1, len(x)))):
                    yield tuple(int(growing[j]) for j in sorted(x, reverse=True)), s, float(e[s])

    def run(table: pa.Table) -> pa.Table:
        cols = list(zip(*rules(table))) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["items", "subject", "e"])

    return run


def _mine(rows: DataFrame, mark, tongues: list[str], subjects: list[str], share: float) -> Rules:
    """Rules from tokenized rows; mark gives (batch, subject of each row or null).

    Evidence is confidence as if every subject had as many sentences of each language, smoothed by STRENGTH
    sentences that are spread evenly, so that a common subject's share of a language's words proves nothing.
    """
    schema = "item long, cls int, n long"
    every = [(t, s) for t in tongues for s in subjects]
    single = _counted(rows.mapInArrow(_word_counts(mark, tongues, subjects), schema), "words")
    total = {every[r["cls"]]: r["n"] for r in single.filter(F.col("item") == SENTENCES).collect()}
    used = sorted({s for _, s in total})
    if not total or used == [NONE]:
        return Rules([s for s in subjects if s != NONE])
    classes = Classes(total, used)
    least = max(2, math.ceil(share * classes.n))
    support = max(least, math.ceil(MIN_PATTERN * classes.n), 3)
    frequent = single.filter(F.col("item") != SENTENCES).groupBy("item").agg(F.sum("n").alias("m"), F.collect_list(F.struct("cls", "n")).alias("by")).filter(F.col("m") >= least)
    t = frequent.select("item", "by").toArrow().sort_by("item")
    item = t["item"].to_numpy()
    by = t["by"].combine_chunks()
    counts = np.zeros((len(item), len(classes.names)))
    index = {c: i for i, c in enumerate(every)}
    place = {index[c]: i for i, c in enumerate(classes.names)}
    which = np.array([place[c] for c in by.flatten().field("cls").to_pylist()], dtype=np.int64)
    counts[np.repeat(np.arange(len(item)), np.diff(by.offsets.to_numpy())), which] = by.flatten().field("n").to_numpy()
    e = classes.evidence(counts) if len(item) else np.zeros((0, len(used)))
    rules = {((int(i),), s): float(x[s]) for i, x in zip(item, e) for s in [int(x.argmax())] if x[s] >= SURE}
    at = np.flatnonzero((counts.sum(1) >= support) & classes.open(counts, e, support)) if len(item) else np.zeros(0, dtype=np.int64)
    at = at[np.argsort(-counts[at].sum(1), kind="stable")]  # the most frequent first
    if len(at):
        cuts = rows.mapInArrow(_conditional(mark, classes.names, item[at]), "shard int, cls int, ids array<long>, n long")
        cuts = cuts.groupBy("shard", "cls", "ids").agg(F.sum("n").alias("n"))
        # shards stay apart: what they grow is small to ship and long to count
        grown = cuts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").groupBy("shard").applyInArrow(_grow(item[at], e[at], classes, support, least), "items array<long>, subject int, e double").toArrow().to_pylist()
        known = {int(i): x for i, x in zip(item, e)}
        more = {(tuple(r["items"]), r["subject"]): r["e"] for r in grown}
        for (x, s), v in sorted(more.items(), key=lambda r: (len(r[0][0]), r[0])):
            parts = [known[i][s] for i in x if i in known] + [rules[y, s] for k in range(1, len(x)) for y in combinations(x, k) if (y, s) in rules]
            if len(x) == 1:  # neighbouring words
                parts = [known[i << 32][s] for i in (x[0] >> 32, x[0] & 0xFFFFFFFF)]
            if v >= max(parts, default=0.0) + GAIN:
                rules[x, s] = v
    real = [s for s in subjects if s != NONE]
    return Rules(real, [(x, real.index(used[s]), v) for (x, s), v in sorted(rules.items())])


def _tongues(rows: DataFrame) -> list[str]:
    """The languages of at least a hundredth of the rows, and OTHER, which stands for all others."""
    total = rows.count()
    return [OTHER, *(r["tongue"] for r in rows.groupBy("tongue").count().filter(F.col("count") >= total / 100).orderBy("tongue").collect())]


def _told(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, list[str]]:
    """Tokenized rows with a subject each, and the subjects they have."""
    mined = materialize(rows.join(wanted.select("doc_id", "subject"), "doc_id"), "mined")
    subjects = sorted({r["subject"] for r in mined.select("subject").distinct().collect()} | {NONE})
    return mined, subjects


def mine(docs: DataFrame, wanted: DataFrame, share: float = 1e-5) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules (items, subject, evidence) from documents with one subject each (doc_id, subject); NONE is a subject here."""
    mined, subjects = _told(tokenized(docs.select("doc_id", "text", "kind", "lang")), wanted)
    found = _mine(mined, _labelled, _tongues(mined), subjects, share)
    numbers = {i for x, _, _ in found.rules for i in x}

    def spelt(batches):
        for b in batches:
            got = {item_number(i): i for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in sentences(t, k) for i in items(s)}
            got = {n: i for n, i in got.items() if n in numbers}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.string())], ["number", "item"])

    names = {r["number"]: r["item"] for r in docs.select("text", "kind").mapInArrow(spelt, "number long, item string").distinct().toArrow().to_pylist()}
    return sorted((tuple(sorted(names[i] for i in x)), found.subjects[s], round(e, 6)) for x, s, e in found.rules)


def learn(rows: DataFrame, labels: DataFrame, rounds: int = 3, share: float = 1e-5, calibration: int = 20_000) -> tuple[Rules, float]:
    """(rules, threshold) from tokenized rows: from hand labels, then from all documents.

    `calibration` bounds the labelled documents on which thresholds are compared; these are never mined by their label.
    """
    hand = labels.select("doc_id", F.coalesce("subject", F.lit(NONE)).alias("subject")).filter("doc_id IS NOT NULL").distinct()
    one = hand.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("subject").alias("subject"), F.collect_set("subject").alias("all"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    # code has a subject of its own accord; what its comments are about is not what its label says
    prose = rows.filter("NOT code")
    mined, subjects = _told(prose, one.filter((F.col("n") == 1) & ~held))
    tongues = _tongues(prose)
    test = prose.join(one.filter(held).orderBy(F.xxhash64("doc_id")).limit(calibration).select("doc_id", "all"), "doc_id").toArrow()
    truth = [set(x) - {NONE} for x in test["all"].to_pylist()]
    batch = Batch(test.combine_chunks().to_batches()[0]) if test.num_rows else None

    def best(rules: Rules) -> float:
        tried = []
        for t in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85):
            got = [{rules.subjects[i] for i in np.flatnonzero(x)} for x in rules.decide(batch, t)] if batch and rules.rules else []
            tried.append((np.mean([x == y for x, y in zip(got, truth)]) if got else 0.0, -abs(t - 0.65), t))
        return max(tried)[2]

    rules = _mine(mined, _labelled, tongues, subjects, share)
    threshold = best(rules)
    for _ in range(rounds - 1):
        if not rules.rules:
            break
        shared = rows.sparkSession.sparkContext.broadcast((rules, threshold))
        rules = _mine(rows, _scored(shared), tongues, subjects, share)
        threshold = best(rules)
    return rules, threshold


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame | None = None, rounds: int = 3, share: float = 1e-5) -> DataFrame:
    """(doc_id, subject): a row for each subject of a document, none for documents without one.

    Null, empty and unreadable texts have no subject; code that has any text has the subject software. Of
    the labels, a null subject says that none applies, documents with contradicting or two labels are not
    mined, repeated rows count once. Subjects that `subjects` doesn't list are ignored if it is given. With no
    labels only code gets a subject. Repeated documents give repeated rows.
    """
    if subjects is not None:
        labels = labels.join(subjects.select("subject").distinct(), "subject", "left_semi").unionByName(labels.filter("subject IS NULL"))
    rows = materialize(tokenized(docs.select("doc_id", "text", "kind", "lang")), "tokens")
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, labels.select("doc_id", "subject"), rounds, share))
    key = dict(docs.dtypes)["doc_id"]

    def run(batches):
        rules, threshold = shared.value
        names = rules.subjects
        for b in batches:
            got = rules.decide(Batch(b), threshold) if rules.rules else np.zeros((b.num_rows, 0), dtype=bool)
            lists = [sorted({names[i] for i in np.flatnonzero(x)} | ({"software"} if c else set())) for x, c in zip(got, b.column("code").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "subjects"])

    return rows.mapInArrow(run, f"doc_id {key}, subjects array<string>").select("doc_id", F.explode("subjects").alias("subject"))
