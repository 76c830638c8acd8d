"""Porter's stemmer (1980), applied to distinct words only."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published suffix tables.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_vowel = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        v = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if v else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings (key..., term, tf) with their terms stemmed: each distinct term is stemmed once."""
    stem_words = F.pandas_udf(lambda words: words.map(stem, na_action="ignore"), "string")
    terms = postings.select("term").distinct().withColumn("stem", stem_words("term"))
    keys = [c for c in postings.columns if c not in ("term", "tf")]
    return postings.join(terms, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
