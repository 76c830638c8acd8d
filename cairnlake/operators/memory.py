"""Written memory: an append-only log of puts and deletes, its current state, and aggregates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fences import GLOBAL, Fence, by_prefix, in_session, live, owned

DAY = 86_400_000
REVIEW, PROMOTION, EPISODE_DAYS = 5, 10, 30
MEM_KINDS = ("fact", "episode")
WRITTEN = (*MEM_KINDS, "doc")

OPS = """seq long, op string, owner string, id string, kind string, format string, provenance string, session string,
occurred_at long, created_at long, expires_at long, text string, meta string, bytes binary, vec array<float>"""


def current(ops: DataFrame) -> DataFrame:
    """The rows that are live: of each (owner, id) the operation with the largest seq, if it is a put.

    Aggregated by max_by, so a key with many operations is combined before it is shuffled. The owner and
    the id together are the key; a null owner is the shared tier.
    """
    rest = [c for c in ops.columns if c not in ("owner", "id")]
    last = ops.groupBy("owner", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return last.filter("r.op = 'put'").select("owner", "id", *[F.col(f"r.{c}").alias(c) for c in rest if c != "op"])


#: Between owner and id in a row key; neither may hold it.
SEPARATOR = "\x1f"


def row_key(owner: Column, id_: Column) -> Column:
    """One string for (owner, id), the id alone in the shared tier; demand is logged under it, so tenants share none."""
    return F.when(owner.isNull(), id_).otherwise(F.concat(owner, F.lit(SEPARATOR), id_))


def demand(log: DataFrame) -> DataFrame:
    """The access log in order: one row per id, actions in lower case (null: recall), times in ms."""
    ms = F.when(F.col("ts") < 100_000_000_000, F.col("ts") * 1000).otherwise(F.col("ts"))
    one = log.groupBy("id").agg(F.max(F.struct("path", "kind", "symbol", F.lower(F.coalesce("action", F.lit("recall"))).alias("action"), ms.alias("ts"))).alias("r"))
    return one.select("id", "r.*")


def history(log: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows of the log (path, seq) that came after the last delete of their row, path being its row_key: an upsert
    keeps a row's demand, a delete drops it."""
    gone = ops.filter("op = 'del'").groupBy(row_key(F.col("owner"), F.col("id")).alias("_p")).agg(F.max("seq").alias("_del"))
    return log.join(gone, log["path"] == gone["_p"], "left").filter("_del IS NULL OR seq > _del").drop("_p", "_del")


# --- counts


def count_rows(docs: DataFrame, mem: DataFrame) -> DataFrame:
    return docs.select(F.lit(1).alias("x")).unionByName(mem.select(F.lit(1).alias("x"))).agg(F.count("*").alias("n"))


def count_by_kind(rows: DataFrame, f: Fence, kinds: tuple[str, ...] = WRITTEN) -> DataFrame:
    """(kind, n) of the fenced, live rows; another session's episodes don't count."""
    ok = owned(F.col("owner"), f) & in_session(F.col("session"), f) & live(F.col("expires_at"), f.now) & F.col("kind").isin(*kinds)
    return rows.filter(ok).groupBy("kind").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, log: DataFrame) -> DataFrame:
    """One row (nodes, edges, vectors, recalls)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = n(nodes.select("id").distinct(), "nodes")
    for part in (n(edges.select("src_path", "dst_path").distinct(), "edges"), n(vectors.select("path").distinct(), "vectors"), n(log.filter("action = 'recall'"), "recalls")):
        row = row.crossJoin(part)  # each side is one row
    return row


# --- demand


def use_counts(mem: DataFrame, log: DataFrame) -> DataFrame:
    """mem with use: how often each row was recalled, 0 if never. Only recalls count, not fetches."""
    used = log.filter("action = 'recall'").groupBy("path").agg(F.count("*").alias("use"))
    return mem.join(used, "path", "left").withColumn("use", F.coalesce("use", F.lit(0)).cast("long"))


def candidates(mem: DataFrame, log: DataFrame, kind: str, threshold: int, f: Fence = Fence(), since: int | None = None) -> DataFrame:
    """(path, hits): rows an agent wrote of a kind that were recalled at least threshold times."""
    rows = mem.filter(F.col("kind").eqNullSafe(kind) & (F.col("provenance") == "agent") & owned(F.col("owner"), f))
    if since is not None:
        rows = rows.filter(F.col("occurred_at") >= since)
    hits = log.filter("action = 'recall'").groupBy("path").agg(F.count("*").alias("hits")).filter(F.col("hits") >= threshold)
    return rows.select("path").distinct().join(hits, "path")


def review_candidates(mem: DataFrame, log: DataFrame, threshold: int = REVIEW, f: Fence = Fence(), kind: str = "fact") -> DataFrame:
    return candidates(mem, log, kind, threshold, f)


def promotion_candidates(mem: DataFrame, log: DataFrame, now: int, threshold: int = PROMOTION, days: int = EPISODE_DAYS, f: Fence = Fence(), kind: str = "episode") -> DataFrame:
    return candidates(mem, log, kind, threshold, f, now - days * DAY)


def recent_activity(edits: DataFrame, now: int, days: int = 7, limit: int = 20) -> DataFrame:
    """(path, symbol, kind, last, edits) of the chunks touched in the last days, newest first."""
    rows = edits.filter((F.col("ts") >= now - days * DAY) & (F.col("ts") <= now))
    seen = rows.groupBy("path", "symbol").agg(F.max("ts").alias("last"), F.countDistinct("ts").alias("edits"), F.max_by("kind", F.struct("ts", "kind")).alias("kind"))
    return seen.orderBy(F.desc("last"), "path", F.asc_nulls_first("symbol")).limit(limit)


# --- lists


def recent_docs(rows: DataFrame, f: Fence, n: int = 20) -> DataFrame:
    ok = owned(F.col("owner"), f) & live(F.col("expires_at"), f.now)
    return rows.filter((F.col("kind") == "doc") & ok).orderBy(F.desc_nulls_last("created_at"), "path").limit(n)


def recent_memory(rows: DataFrame, f: Fence, n: int = 20, kinds: tuple[str, ...] = MEM_KINDS) -> DataFrame:
    if set(kinds) - set(MEM_KINDS):
        raise ValueError("recent memory lists facts and episodes, recent documents are a list of their own")
    ok = F.col("kind").isin(*kinds) & owned(F.col("owner"), f) & in_session(F.col("session"), f)
    return rows.filter(ok).withColumn("at", F.coalesce("occurred_at", "created_at")).orderBy(F.desc_nulls_last("at"), "path").limit(n)


def enumerate_page(rows: DataFrame, offset: int, limit: int, order: str = "seq") -> DataFrame:
    """A page in the order of the latest write."""
    return rows.orderBy(order).offset(offset).limit(limit)


def next_offset(offset: int, limit: int, total: int) -> int | None:
    return offset + limit if offset + limit < total else None


# --- deletions, as operations to append


def _del(rows: DataFrame, seq: int) -> DataFrame:
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit("del").alias("op"), "owner", "id", "kind")


def forget(rows: DataFrame, seq: int, id: str | None = None, prefix: str | None = None, kind: str | None = None, by: str | None = None, scope=None) -> DataFrame:
    """Deletes for the written rows that all given conditions meet.

    scope (a tenant or GLOBAL) limits them to exactly that tier of memory and can't be joined with by. No
    condition at all is an error; a file's rows and parked texts are never among the rows.
    """
    if id is None and prefix is None and kind is None and by is None:
        raise ValueError("state what to forget")
    if scope is not None and by is not None:
        raise ValueError("scope and by can't be joined")
    ok: Column = F.col("kind").isin(*WRITTEN)
    if id is not None:
        ok &= by_prefix(F.col("id"), id)
    if prefix is not None:
        ok &= F.col("id").startswith(prefix)
    if kind is not None:
        ok &= F.col("kind") == kind
    if by is not None:
        ok &= F.col("provenance") == by
    if scope is not None:
        ok &= F.col("kind").isin(*MEM_KINDS) & (F.col("owner").isNull() if scope is GLOBAL else F.col("owner") == scope)
    return _del(rows.filter(ok), seq)


def purge(rows: DataFrame, now: int, seq: int) -> DataFrame:
    """Deletes for what has expired at now."""
    return _del(rows.filter(F.col("expires_at") <= now), seq)


def prune_episodes(rows: DataFrame, now: int, seq: int, days: float = EPISODE_DAYS) -> DataFrame:
    """Deletes for episodes older than the window, of all owners."""
    if not days > 0 or days == float("inf"):
        raise ValueError("the window must be a positive number of days")
    return _del(rows.filter((F.col("kind") == "episode") & (F.col("occurred_at") < now - days * DAY)), seq)


def lookup(ids: DataFrame, mem: DataFrame, direct: DataFrame, files: DataFrame, stash: DataFrame, f: Fence) -> DataFrame:
    """(id, tier, text): for each id what the caller sees: own memory, shared memory, a live direct document,
    a file, a parked text, in that order."""
    mine = mem.filter(owned(F.col("owner"), f) & in_session(F.col("session"), f))
    tier = F.when(F.col("owner").isNotNull(), F.lit(0)).otherwise(F.lit(1))
    parts = [
        mine.select("id", tier.alias("p"), "text"),
        direct.filter(owned(F.col("owner"), f) & live(F.col("expires_at"), f.now)).select("id", F.lit(2).alias("p"), "text"),
        files.select("id", F.lit(3).alias("p"), "text"), stash.select("id", F.lit(4).alias("p"), "text"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("p", "text"), F.struct("p", "text")).alias("r"))
    names = F.array(*map(F.lit, ("own memory", "shared memory", "document", "file", "stash")))
    return best.select("id", F.element_at(names, F.col("r.p") + 1).alias("tier"), F.col("r.text").alias("text"))


def evict(stash: DataFrame, id: str | None = None, older_than: int | None = None, keep_newest: int | None = None) -> DataFrame:
    """(id) of the parked texts to drop: the id, those made before a time, or beyond the newest n of the
    rest, in this order of the policies."""
    if id is not None:
        return stash.filter(F.col("id") == id).select("id")
    old = stash.filter(F.col("created_at") < older_than) if older_than is not None else stash.limit(0)
    out = old.select("id")
    if keep_newest is not None:
        rest = stash.join(out, "id", "left_anti")
        spared = rest.orderBy(F.desc("created_at"), F.desc("id")).limit(keep_newest)
        out = out.unionByName(rest.select("id").join(spared.select("id"), "id", "left_anti"))
    return out


def trace_edges(calls: DataFrame) -> DataFrame:
    """Calls of a session (session, seq, id) with the one before them."""
    return calls.withColumn("prev", F.lag("id").over(Window.partitionBy("session").orderBy("seq")))
