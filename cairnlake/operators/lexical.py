"""Lexical search: the OR gate, corpus statistics and BM25.

Statistics cover the whole domain (all rows of the corpus), whatever kind, tenant or expiry a query then
filters by. Every operator takes a corpus (key columns, tokens array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_count, word_count
from ..session import materialize

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Queries with more term rows than this are joined by shuffle.
QUERY_BROADCAST = 1_000_000


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(corpus: DataFrame, terms: list[str], keep: Column | None = None) -> DataFrame:
    """corpus without its words or tokens but with a score, only rows that have a term (and pass keep).

    The corpus has a column words (text.ident_words) or, for other tokenizers, tokens (an array). Terms are
    counted in each row where the row lies, once for the statistics, of which one row reaches the driver,
    and once for the scores. No terms: no rows. Null words count as an empty row.
    """
    column = "words" if "words" in corpus.columns else "tokens"
    if not terms:
        return corpus.limit(0).drop(column).withColumn("score", F.lit(0.0))
    if column == "words":
        words = F.coalesce("words", F.lit(""))
        length, tf = word_count(words), [term_count(words, t) for t in terms]
    else:
        tokens = F.coalesce("tokens", F.array().cast("array<string>"))
        length, tf = F.size(tokens), [_occurrences(tokens, t) for t in terms]
    # one generated row per row: a filter on counts isn't pushed below it, where it would split each text again
    counts = F.struct(length.alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    counted = corpus.withColumn("_c", F.explode(F.array(counts))).drop(column)
    stats = counted.agg(F.count("*").alias("n"), F.avg("_c.dl").alias("mean"), *[F.count(F.when(F.col(f"_c.tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]).first()
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_c.tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        weight = idf(F.lit(stats["n"]), F.lit(stats[f"df{i}"]))
        part = weight * saturation(F.col(f"_c.tf{i}"), F.col("_c.dl"), F.lit(stats["mean"]))
        score = score + F.when(F.col(f"_c.tf{i}") > 0, part).otherwise(0.0)
    return counted.filter(hit if keep is None else hit & keep).withColumn("score", score).drop("_c")


def postings(corpus: DataFrame, keys: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(keys, dl, term, tf): the inverted index, or what it holds of terms (term); rows without tokens give none.

    Words of other terms are left out before anything is shuffled; terms are broadcast if they are few.
    """
    words = corpus.select(*keys, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        asked = terms.select("term").distinct()
        words = words.join(F.broadcast(asked) if asked.limit(QUERY_BROADCAST + 1).count() <= QUERY_BROADCAST else asked, "term", "left_semi")
    return words.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row (n, mean): number of rows and mean length."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25_many(index: DataFrame, stats: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, score) for a table of queries (query_id, terms array<string>) over an inverted index.

    Only postings of queried terms are joined; queries are broadcast if they are few.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    few = asked.limit(QUERY_BROADCAST + 1).count() <= QUERY_BROADCAST
    side = F.broadcast(asked) if few else asked
    # read twice below, so written down: its plan may reach back to the texts
    wanted = materialize(index.join(F.broadcast(asked.select("term").distinct()) if few else asked.select("term").distinct(), "term", "left_semi"), "wanted")
    scored = wanted.join(document_frequency(wanted), "term").crossJoin(F.broadcast(stats)).withColumn("part", idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("mean")))
    return scored.join(side, "term").groupBy("query_id", *keys).agg(F.sum("part").alias("score"))
