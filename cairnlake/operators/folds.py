"""Order-dependent fitting of units into a budget, packing of paragraphs, and sections of markdown.

Skipping a unit changes the room left for every later one, so no running total can express the fit. It is a
fold over the ordered units of one conversation, which stream by sorted in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_of

SEGMENT = 800
KEEP_VERBATIM = 8

UNIT = "id string, role string, content string, kind string, format string, symbol string, pinned boolean, atomic string, tokensApprox double"


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with what b has under the same keys, null meeting null."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return a.join(b, on, "left").drop(*[f"_k_{k}" for k in keys])


def _fold(items: DataFrame, conv: str, limit: float) -> DataFrame:
    """items (conv, _item, pos, tok, forced, used) with _ok, whether an item fits, and _after, what is used then: the
    latest position first, from `used` on. Rows stream by in order, so of a conversation only a sum is held."""
    names = [conv, "_item", "_ok", "_after"]
    kind = dict(items.dtypes)[conv]

    def run(batches):
        begun, last, used = False, None, 0.0
        for b in batches:
            ok, after = [], []
            for c, tok, forced, base in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if not begun or c != last:
                    begun, last, used = True, c, base
                fits = forced or used + tok <= limit
                used = used + tok if fits else used
                ok.append(fits)
                after.append(used)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(after, pa.float64())], names)

    laid = items.repartition(F.col(conv)).sortWithinPartitions(F.col(conv), F.desc("pos"))
    return laid.select(conv, "_item", F.col("tok").cast("double"), "forced", "used").mapInArrow(run, f"`{conv}` {kind}, _item string, _ok boolean, _after double")


def assemble(units: DataFrame, budget: float | None, signature: Callable[[Column], Column] | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """units with kept, tokens, compressed, content: what fits into the budget, each conversation by itself.

    Pinned units are kept and charged first. The units of an atomic group are kept or dropped together, as
    fresh as their newest member, and always kept if one of them is pinned. Everything else goes newest
    first and is skipped, not the end, if it doesn't fit. Dropped code and documents whose signature(struct
    of content, format, symbol) is smaller and fits come back as that. No budget keeps everything. Order is
    by turn; rows with a null turn come first. A row of units is one unit; null ids are units of their own.
    """
    limit = float("inf") if budget is None else float(budget)
    u = units.withColumn("_tok", tokens_of(F.col("tokensApprox"), F.col("content"))).withColumn("_pin", _flag("pinned"))
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "id")
    u = u.withColumn("_pos", F.row_number().over(order))
    item = F.when(F.col("atomic").isNotNull() & (F.col("atomic") != ""), F.concat(F.lit("g"), "atomic")).otherwise(F.concat(F.lit("u"), F.col("_pos").cast("string")))
    u = u.withColumn("_item", item)
    per_item = u.groupBy(conv, "_item").agg(
        F.sum(F.when(~F.col("_pin"), F.col("_tok"))).alias("tok"), F.max(F.when(~F.col("_pin"), F.col("_pos"))).alias("pos"), F.max("_pin").alias("forced"), F.sum(F.when(F.col("_pin"), F.col("_tok"))).alias("pre")
    )
    pre = per_item.groupBy(conv).agg(F.coalesce(F.sum("pre"), F.lit(0.0)).alias("used"))
    first = _same(per_item.filter("pos IS NOT NULL"), pre, [conv]).select(conv, "_item", "pos", "tok", F.coalesce("forced", F.lit(False)).alias("forced"), "used")
    fit = _fold(first, conv, limit)
    out = _same(u, fit.select(conv, "_item", "_ok"), [conv, "_item"]).withColumn("kept", F.col("_pin") | F.coalesce("_ok", F.lit(False))).drop("_ok")
    if signature is None:
        out = out.withColumn("tokens", F.when(F.col("kept"), F.col("_tok"))).withColumn("compressed", F.lit(False))
    else:
        single = F.col("_item").startswith("u") & ~F.col("_pin") & F.col("kind").isin("code", "doc") & F.col("format").isNotNull() & (F.coalesce("content", F.lit("")) != "")
        out = out.withColumn("_sig", F.when(~F.col("kept") & single, signature(F.struct("content", "format", "symbol"))))
        out = out.withColumn("_sigtok", F.ceil(F.char_length("_sig") / 4.0).cast("double"))
        spent = _same(pre, fit.groupBy(conv).agg(F.max("_after").alias("_after")), [conv]).select(conv, F.coalesce("_after", "used").alias("used"))
        offers = out.filter("_sig IS NOT NULL AND _sigtok < _tok").select(conv, "_item", F.col("_pos").alias("pos"), F.col("_sigtok").alias("tok"), F.lit(False).alias("forced"))
        saved = _fold(_same(offers, spent, [conv]), conv, limit).select(conv, "_item", "_ok")
        out = _same(out, saved, [conv, "_item"]).withColumn("compressed", F.coalesce("_ok", F.lit(False))).drop("_ok")
        out = out.withColumn("content", F.when(F.col("compressed"), F.col("_sig")).otherwise(F.col("content"))).withColumn("kept", F.col("kept") | F.col("compressed"))
        out = out.withColumn("tokens", F.when(F.col("compressed"), F.col("_sigtok")).when(F.col("kept"), F.col("_tok")))
    reason = F.when(~F.col("kept"), F.lit("budget"))
    return out.withColumn("reason", reason).drop("_tok", "_pin", "_pos", "_item", "_sig", "_sigtok")


def summary_window(units: DataFrame, budget: float | None, summarize: Callable[[list[dict]], str] | None, keep: int = KEEP_VERBATIM, conv: str = "conv_id", turn: str = "turn", **how) -> DataFrame:
    """assemble(), with the older plain turns of a conversation over budget folded into one summary unit.

    Foldable are turns that are neither pinned, atomic, code, doc nor empty; all but the last `keep` are
    older. With fewer than two of them, or if summarize gives nothing, nothing is folded. The summary is the
    freshest unit. The reason of a folded turn is summarized if the summary was kept, else budget.
    """
    if summarize is None:
        return assemble(units, budget, conv=conv, turn=turn, **how)
    tok = tokens_of(F.col("tokensApprox"), F.col("content"))
    foldable = ~_flag("pinned") & (F.coalesce("atomic", F.lit("")) == "") & ~F.coalesce(F.col("kind").isin("code", "doc"), F.lit(False)) & (F.coalesce("content", F.lit("")) != "")
    total = units.groupBy(conv).agg(F.sum(tok).alias("_all"))
    back = Window.partitionBy(conv, "_can").orderBy(F.col(turn).desc_nulls_last(), F.desc("id"))
    u = units.join(total, conv).withColumn("_can", foldable).withColumn("_back", F.row_number().over(back))
    over = F.lit(False) if budget is None else F.col("_all") > budget
    older = F.col("_can") & (F.col("_back") > keep) & over
    u = u.withColumn("_older", older)
    kinds = dict(units.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([turn, "id"])
        text = (summarize(pdf[["role", "content"]].to_dict("records")) or "").strip() if len(pdf) > 1 else ""
        ids = pdf["id"].tolist()
        return pd.DataFrame({conv: [pdf[conv].iloc[0]], "id": [f"summary:{ids[0]}..{ids[-1]}"], "content": [text], "summarizes": [ids]})

    told = u.filter("_older").select(conv, turn, "id", "role", "content").groupBy(conv).applyInPandas(fold, f"`{conv}` {kinds[conv]}, id string, content string, summarizes array<string>").filter("content <> ''")
    done = told.select(conv, F.lit(True).alias("_done"))
    u = u.join(done, conv, "left").withColumn("_folded", F.col("_older") & _flag("_done"))
    last = units.groupBy(conv).agg(F.max(turn).alias("_last"))
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    made = told.join(last, conv).select(*[F.col(c) if c in (conv, "id", "content") else F.lit("system").alias(c) if c == "role" else (F.col("_last") + 1).cast(kinds[c]).alias(c) if c == turn else null(c) for c in units.columns])
    rest = u.filter(~F.col("_folded")).select(*units.columns)
    fitted = assemble(rest.unionByName(made), budget, conv=conv, turn=turn, **how)
    kept = fitted.filter("kept AND id LIKE 'summary:%'").select(conv, F.lit(True).alias("_kept"))
    gone = u.filter("_folded").select(*units.columns, conv).select(*units.columns).join(kept, conv, "left")
    gone = gone.select(*units.columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("tokens"), F.lit(False).alias("compressed"), F.when(_flag("_kept"), "summarized").otherwise("budget").alias("reason"))
    return fitted.select(*gone.columns).unionByName(gone)


def trim(units: DataFrame, max_tokens: float | None = None, keep_last: int | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """units with kept: by size (assemble) if max_tokens is given, else the last items by count, else all.

    Atomic groups are one item, pinned units are always kept and don't count.
    """
    if max_tokens is not None:
        return assemble(units, max_tokens, conv=conv, turn=turn)
    if keep_last is None:
        return units.withColumn("kept", F.lit(True))
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "id")
    u = units.withColumn("_pos", F.row_number().over(order)).withColumn("_pin", _flag("pinned"))
    group = F.when(F.coalesce("atomic", F.lit("")) != "", F.concat(F.lit("g"), "atomic")).otherwise(F.concat(F.lit("u"), F.col("_pos").cast("string")))
    whole = Window.partitionBy(conv, "_item")
    u = u.withColumn("_item", group).withColumn("_at", F.max(F.when(~F.col("_pin"), F.col("_pos"))).over(whole)).withColumn("_forced", F.max("_pin").over(whole))
    newest = Window.partitionBy(conv).orderBy(F.desc_nulls_last("_at"))
    return u.withColumn("_n", F.dense_rank().over(newest)).withColumn("kept", F.col("_pin") | F.col("_forced") | (F.col("_at").isNotNull() & (F.col("_n") <= keep_last))).drop("_pos", "_pin", "_item", "_at", "_forced", "_n")


def pack_paragraphs(paragraphs: Column, budget: int = SEGMENT) -> Column:
    """Paragraphs joined by newlines as long as they stay within the budget; a longer one rides alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"].isNotNull() & (F.char_length(acc["open"]) + 1 + F.char_length(x) <= budget)
        flushed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, acc["done"]).otherwise(flushed).alias("done"), F.when(fits, F.concat(acc["open"], F.lit("\n"), x)).otherwise(x).alias("open"))

    return F.aggregate(paragraphs, state, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


_WS = r"^[\s ﻿]+|[\s ﻿]+$"


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs if there is more than one, else the non-empty lines, trimmed."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\x00", "")
    cut = lambda pattern: F.filter(F.transform(F.split(clean, pattern, -1), lambda x: F.regexp_replace(x, _WS, "")), lambda x: x != "")
    blocks = cut(r"\n[ \t]*\n+")
    return F.when(F.size(blocks) > 1, blocks).otherwise(cut(r"\n"))


def pack_text(text: Column, budget: int = SEGMENT) -> Column:
    return pack_paragraphs(paragraphs(text), budget)


HEADING = r"^#{1,6}\s"


def sections(docs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, section, symbol, node_type, start_line, end_line, text): markdown cut at its headings.

    Lines before the first heading are a preamble unless blank; without a heading the whole is one `file`.
    Lines are 0-based, both ends included. Null bodies give nothing.
    """
    lines = docs.filter(F.col(body).isNotNull()).select(*keys, F.posexplode(F.split(F.regexp_replace(body, r"\r\n", "\n"), "\n", -1)).alias("line", "text"))
    run = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("section", F.sum(F.col("text").rlike(HEADING).cast("int")).over(run))
    grouped = cut.groupBy(*keys, "section").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    last = Window.partitionBy(*keys)
    typed = grouped.withColumn("text", text).withColumn("_last", F.max("section").over(last))
    kind = F.when(F.col("section") > 0, "section").when(F.col("_last") > 0, "preamble").otherwise("file")
    title = F.when(F.col("section") > 0, F.regexp_replace(F.element_at("rows", 1)["text"], r"^#{1,6}\s+|\s+#*\s*$", ""))
    out = typed.withColumn("node_type", kind).withColumn("symbol", title).filter((F.col("node_type") != "preamble") | F.col("text").rlike(r"\S"))
    return out.select(*keys, "section", "symbol", "node_type", "start_line", "end_line", "text")


def segments(docs: DataFrame, keys: list[str], body: str = "body", budget: int = SEGMENT) -> DataFrame:
    """(keys, segment, text): markdown with headings by sections, everything else packed to the budget."""
    text = docs.filter(F.col(body).isNotNull())
    headed = F.col(body).rlike(r"(?m)^#{1,6}\s")
    parts = sections(text.filter(headed), keys, body)
    nth = Window.partitionBy(*keys).orderBy("section")
    by_section = parts.select(*keys, (F.row_number().over(nth) - 1).alias("segment"), "text")
    flat = text.filter(~headed).select(*keys, F.posexplode(pack_text(F.col(body), budget)).alias("segment", "text"))
    return by_section.unionByName(flat)
