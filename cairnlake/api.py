"""A session over the engine: written memory in a versioned table, scopes, write gate, audit and trace."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import parse
from .functions import text as T
from .functions.stem import stem, stem_postings
from .operators import folds, lexical, memory, rank
from .operators.fences import GLOBAL, Fence, fence_of, in_session, live, owned
from .operators.incremental import VersionConflict, VersionedTable
from .session import materialize
from .sources import files
from .sources.files import apply_alias, load_ts_paths  # noqa: F401 - part of this interface

#: Rows of a kind that are fused with cosine, at least.
SEMANTIC_POOL = 400
CACHED_QUERIES = 128
#: Tries of a write that meets others; files of the log from which on a write also compacts it.
RETRIES, COMPACT_AT = 5, 256


class WriteDenied(PermissionError):
    """The host's gate has refused a write; nothing has been stored."""


class Trace:
    """Calls in order, each linked to the one before."""

    # Fixed value: what each verb belongs to.
    PRIMITIVES = {"remember": "Write", "ingest": "Write", "forget": "Write", "purge": "Write", "recall": "Select", "get": "Select", "related": "Select", "impact": "Select", "assemble": "Compress", "trim": "Compress", "stash": "Isolate", "peek": "Isolate", "evict": "Isolate", "node": "Select"}

    def __init__(self):
        self.nodes: list[dict] = []
        self.taps: dict[str, list[Callable[[dict], None]]] = {}

    def tap(self, verb: str, call: Callable[[dict], None]) -> None:
        self.taps.setdefault(verb, []).append(call)

    def record(self, verb: str, args: dict, result: str) -> None:
        node = {"id": f"n{len(self.nodes) + 1}", "verb": verb, "primitive": self.PRIMITIVES.get(verb, "Select"), "args": args, "result": result}
        self.nodes.append(node)
        for call in self.taps.get(verb, []):
            call(node)

    def edges(self) -> list[tuple[str, str]]:
        return [(a["id"], b["id"]) for a, b in zip(self.nodes[:-1], self.nodes[1:])]

    def json(self) -> str:
        return json.dumps({"nodes": self.nodes, "edges": [{"from": a, "to": b} for a, b in self.edges()]}, ensure_ascii=False, default=str)

    def mermaid(self) -> str:
        return "\n".join(["flowchart TD", *(f'  {n["id"]}["{n["primitive"]}: {n["verb"]}"]' for n in self.nodes), *(f"  {a} --> {b}" for a, b in self.edges())])


class Engine:
    """remember, recall, get, count, list, forget, purge and stash over one root folder.

    Every write appends operations to the table `ops`; reads are its live rows (memory.current). seq and now
    can be passed for reproducible runs.
    """

    def __init__(
        self, spark: SparkSession, root: str, owner: str | None = None, session: str | None = None, strict: bool = False, episode_days: float = memory.EPISODE_DAYS,
        gate: Callable[[dict], str] | None = None, audit: Callable[[dict], None] | None = None, redact: Callable[[dict], dict] | None = None,
        embed: Callable[[str], list[float]] | None = None, clock: Callable[[], int] = lambda: int(time.time() * 1000), trace: Trace | None = None,
        embed_weight: float = rank.EMBED_WEIGHT, nominees: int = rank.NOMINEES,
    ):
        if not 0 < episode_days < float("inf"):
            raise ValueError("episode_days must be a positive number")
        self.spark, self.owner, self.session, self.strict, self.days = spark, owner, session, strict, episode_days
        self.gate, self.audit, self.redact, self.embed, self.clock, self.trace = gate, audit, redact, embed, clock, trace
        self.embed_weight, self.nominees = embed_weight, nominees
        self._asked = lru_cache(CACHED_QUERIES)(lambda query: [float(x) for x in embed(query)]) if embed else None
        self.ops = VersionedTable(spark, f"{root}/ops", memory.OPS)
        self.log = VersionedTable(spark, f"{root}/log", "seq long, path string, kind string, symbol string, action string, ts long")
        self.parked = VersionedTable(spark, f"{root}/stash", "seq long, op string, id string, text string, created_at long")

    # --- scopes

    def _fence(self, scope) -> Fence:
        if scope is None and self.owner is not None:
            scope = self.owner
        return fence_of(scope, self.strict, self.session, self.clock())

    def _written_owner(self, scope) -> str | None:
        """Whose row a write makes; a strict engine without an owner must be told."""
        if scope is None and self.owner is None:
            fence_of(None, self.strict)
        return None if scope is GLOBAL else scope if scope is not None else self.owner

    def scoped(self, scope: str) -> Scoped:
        if scope is None:
            raise ValueError("a scope is needed")
        return Scoped(self, scope)

    def _note(self, verb: str, args: dict, result: str) -> None:
        if self.trace is not None:
            self.trace.record(verb, args, result)

    def _allow(self, action: dict) -> None:
        decision = self.gate(action) if self.gate else "allow"
        if self.audit:
            entry = {**action, "decision": decision, "reason": None if self.gate else "no-gate"}
            self.audit(self.redact(entry) if self.redact else entry)
        if decision == "deny":
            raise WriteDenied(action["id"])

    # --- state

    def rows(self) -> DataFrame:
        return memory.current(self.ops.read())

    def _seq(self) -> int:
        return self.ops.latest() + 1

    def _append(self, rows: list[dict]) -> int:
        """Commit rows on top of the latest version; a writer that was faster is let go first."""
        names = self.ops.schema.names
        for left in reversed(range(RETRIES)):
            seq = self._seq()
            data = [tuple({**r, "seq": seq}.get(n) for n in names) for r in rows]
            try:
                version = self.ops.append(self.spark.createDataFrame(data, self.ops.schema), base=seq - 1)
            except VersionConflict:
                if not left:
                    raise
                continue
            return self.ops.compact(1) if len(self.ops.manifest(version).files) > COMPACT_AT else version
        raise AssertionError

    def _delete(self, rows: DataFrame, seq: int) -> int:
        n = rows.count()
        if n:
            full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(self.ops.schema.names, self.ops.schema.fields)])
            self.ops.append(full, base=seq - 1)
        return n

    # --- writes

    def remember(self, id: str, text: str, kind: str, by: str = "agent", scope=None, occurred_at: int | None = None, expires_at: int | None = None, meta: Any = None) -> None:
        """Write or replace the row (owner, id); its demand history stays, what is left out is cleared."""
        if kind not in memory.WRITTEN:
            raise ValueError(f"kind must be one of {memory.WRITTEN}")
        if by not in ("human", "agent"):
            raise ValueError("by must be human or agent")
        owner = self._written_owner(scope)
        if memory.SEPARATOR in id or memory.SEPARATOR in (owner or ""):
            raise ValueError("ids and owners may not hold the unit separator")
        now = self.clock()
        self._allow({"verb": "remember", "id": id, "kind": kind, "by": by, "owner": owner, "text": text})
        if kind == "episode":
            self._delete(memory.prune_episodes(self.rows(), now, self._seq(), self.days), self._seq())
        row = {
            "op": "put", "owner": owner, "id": id, "kind": kind, "format": "md", "provenance": by, "session": self.session if kind == "episode" else None,
            "occurred_at": occurred_at if occurred_at is not None else now if kind == "episode" else None, "created_at": now, "expires_at": expires_at, "text": text,
            "meta": json.dumps(meta) if meta is not None else None, "vec": self.embed(text) if self.embed else None,
        }
        self._append([row])
        self._note("remember", {"id": id, "kind": kind}, "1 row")

    def ingest(self, name: str, content: bytes, by: str = "human", scope=None, expires_at: int | None = None) -> list[str]:
        """Store an upload as one commit: the segments that replace earlier ones of the same id and scope."""
        owner = self._written_owner(scope)
        made = files.ingest(self.spark.createDataFrame([(name, bytearray(content))], "name string, content binary")).collect()
        for r in made:
            if r["error"]:
                raise files.UploadRejected(r["error"])
            self._allow({"verb": "ingest", "id": r["id"], "kind": "doc", "by": by, "owner": owner, "text": r["text"]})
        base = made[0]["id"].split("#")[0]
        old = self.rows().filter(F.col("owner").eqNullSafe(owner) & (F.col("kind") == "doc") & ((F.col("id") == base) | F.col("id").startswith(base + "#"))).select("id").collect()
        now, keep = self.clock(), {r["id"] for r in made}
        puts = [{"op": "put", "owner": owner, "id": r["id"], "kind": "doc", "format": r["format"], "provenance": by, "created_at": now, "expires_at": expires_at, "text": r["text"], "bytes": r["bytes"]} for r in made]
        self._append([*puts, *({"op": "del", "owner": owner, "id": r["id"], "kind": "doc"} for r in old if r["id"] not in keep)])
        self._note("ingest", {"name": name}, f"{len(made)} segments")
        return [r["id"] for r in made]

    def forget(self, **what) -> int:
        if self.strict and what.get("scope") is None and what.get("by") is None:
            fence_of(None, True)
        n = self._delete(memory.forget(self.rows(), self._seq(), **what), self._seq())
        self._note("forget", what, f"{n} rows")
        return n

    def purge(self) -> int:
        n = self._delete(memory.purge(self.rows(), self.clock(), self._seq()), self._seq())
        self._note("purge", {}, f"{n} rows")
        return n

    # --- reads

    def recall(self, query: str, kinds: tuple[str, ...] = memory.WRITTEN, n: int | None = None, scope=None, log: bool = True) -> DataFrame:
        """(kind, rank, id, score, text, use, cosine, owner, provenance, meta) of the best rows of each kind.

        Facts and episodes are one domain with stemmed terms, documents another; statistics of a domain cover all its
        rows, whoever owns them. With embed, the best rows by words and, of memory, the `nominees` nearest by cosine
        are put in the order of both; the score stays that of the words, 0 for a nominee, and cosine is given for
        memory only. use counts earlier recalls of the row.
        """
        f = self._fence(scope)
        n = n or (10 if len(kinds) == 1 else 5)
        rows = self.rows().withColumn("path", memory.row_key(F.col("owner"), F.col("id")))
        keep = owned(F.col("owner"), f) & in_session(F.col("session"), f) & live(F.col("expires_at"), f.now)
        terms, best = T.query_terms(query), None
        for kind in kinds:
            one = self._ranked(rows, kind, terms, query, n, keep)
            best = one if best is None else best.unionByName(one)
        used = memory.use_counts(best.join(rows, ["path", "kind"]), memory.history(self.log.read(), self.ops.read()))
        used = used.select("kind", "rank", "id", "score", "text", "use", "cosine", "owner", "provenance", "meta")
        out = self.spark.createDataFrame(used.collect(), used.schema)  # at most n rows of each kind
        if log:
            self._log(out, "recall")
        self._note("recall", {"query": query, "kinds": kinds}, f"{n} of each kind")
        return out.orderBy("kind", "rank")

    def _scores(self, rows: DataFrame, kind: str, terms: list[str]) -> DataFrame:
        """(path, score) of the rows of a kind by the words of their domain."""
        mine = memory.MEM_KINDS if kind in memory.MEM_KINDS else (kind,)
        domain = rows.filter(F.col("kind").isin(*mine))
        corpus = domain.select("path", "kind", T.index_tokens(F.col("id"), F.lit(None).cast("array<string>"), F.col("text")).alias("tokens"))
        if kind not in memory.MEM_KINDS:
            return lexical.bm25(corpus, terms).select("path", "score")
        index = stem_postings(lexical.postings(corpus, ["path"]))
        asked = self.spark.createDataFrame([("q", sorted({stem(t) for t in terms}))], "query_id string, terms array<string>")
        return lexical.bm25_many(index, lexical.corpus_stats(corpus), asked, ["path"]).select("path", "score")

    def _ranked(self, rows: DataFrame, kind: str, terms: list[str], query: str, n: int, keep: Column) -> DataFrame:
        """(path, kind, rank, score, cosine) of the n best rows of one kind."""
        seen = rows.filter((F.col("kind") == kind) & keep)
        scored = self._scores(rows, kind, terms).join(seen.select("path"), "path")
        if self._asked is None or not terms:
            order = rank.top(scored, n).withColumn("order", F.col("score")).withColumn("cosine", F.lit(None).cast("double"))
        else:
            pool = materialize(rank.top(scored, max(n, SEMANTIC_POOL)), "pool")
            vectors = rank.usable(seen.select("path", F.size("vec").alias("dim"), "vec"))
            near = materialize(rank.similarity(vectors, self._asked(query)), "near")
            extra = rank.nominees(near, pool, self.nominees) if kind in memory.MEM_KINDS else None
            fused = rank.fuse(pool, near, extra, self.embed_weight).drop("score").join(pool, "path", "left")
            cosine = F.coalesce("cosine", F.lit(0.0)) if kind in memory.MEM_KINDS else F.lit(None).cast("double")
            order = fused.select("path", F.coalesce("score", F.lit(0.0)).alias("score"), cosine.alias("cosine"), F.coalesce("fused", "score", "cosine").alias("order"))
        return rank.top_per(order.withColumn("kind", F.lit(kind)), ["kind"], n, "order").select("path", "kind", "rank", "score", "cosine")

    def _log(self, hits: DataFrame, action: str) -> None:
        key = memory.row_key(F.col("owner"), F.col("id")).alias("path")
        rows = hits.select(F.lit(self.ops.latest() + 1).cast("long").alias("seq"), key, "kind", F.lit(None).cast("string").alias("symbol"), F.lit(action).alias("action"), F.lit(self.clock()).alias("ts"))
        self.log.append(rows)

    def _visible(self, id: str, f: Fence) -> Row | None:
        """The written row that an id means to a caller: own memory, shared memory, a live document."""
        seen = self.rows().filter((F.col("id") == id) & owned(F.col("owner"), f) & live(F.col("expires_at"), f.now))
        doc = (F.col("kind") == "doc").cast("int")
        return seen.filter(in_session(F.col("session"), f) | (doc == 1)).orderBy(doc, F.col("owner").isNull(), "owner").first()

    def get(self, id: str, scope=None) -> str | None:
        f = self._fence(scope)
        row = self._visible(id, f)
        if row is None:
            row = self.stashed().filter(F.col("id") == id).select(F.lit(None).cast("string").alias("owner"), "id", F.lit("stash").alias("kind"), "text").first()
        if row:
            self._log(self.spark.createDataFrame([(row["owner"], id, row["kind"])], "owner string, id string, kind string"), "fetch")
        self._note("get", {"id": id}, "found" if row else "none")
        return row["text"] if row else None

    def node(self, id: str, scope=None) -> dict | None:
        """A written memory as a node of the graph, which has no edges; None for documents and parked texts."""
        row = self._visible(id, self._fence(scope))
        if row is None or row["kind"] not in memory.MEM_KINDS:
            return None
        return {"path": id, "kind": row["kind"], "format": row["format"], "chunks": [], "imports": 0, "imported_by": 0}

    def count(self, scope=None, kinds: tuple[str, ...] = memory.WRITTEN) -> int:
        return sum(r["n"] for r in memory.count_by_kind(self.rows(), self._fence(scope), kinds).collect())

    def recent(self, scope=None, n: int = 20, kind: str = "memory") -> DataFrame:
        f, rows = self._fence(scope), self.rows().withColumn("path", F.col("id"))
        return memory.recent_docs(rows, f, n) if kind == "doc" else memory.recent_memory(rows, f, n)

    def enumerate(self, kind: str, offset: int = 0, limit: int = 100, scope=None) -> dict:
        f = self._fence(scope)
        rows = self.rows().filter((F.col("kind") == kind) & owned(F.col("owner"), f) & in_session(F.col("session"), f) & live(F.col("expires_at"), f.now))
        total = rows.count()
        page = rows.orderBy("seq", "id").offset(offset).limit(limit).select("id", "kind", "text", "created_at").collect()
        return {"items": [r.asDict() for r in page], "total": total, "next_offset": memory.next_offset(offset, limit, total)}

    def review(self, scope=None, threshold: int = memory.REVIEW, kind: str = "fact") -> DataFrame:
        """(id, owner, hits): what agents wrote and was recalled often, to be reviewed by a human."""
        return self._often(scope, lambda rows, log, f: memory.review_candidates(rows, log, threshold, f, kind))

    def promotions(self, scope=None, threshold: int = memory.PROMOTION, days: int = memory.EPISODE_DAYS, kind: str = "episode") -> DataFrame:
        """(id, owner, hits): recent episodes that were recalled often enough to become facts."""
        return self._often(scope, lambda rows, log, f: memory.promotion_candidates(rows, log, self.clock(), threshold, days, f, kind))

    def _often(self, scope, pick: Callable[[DataFrame, DataFrame, Fence], DataFrame]) -> DataFrame:
        f = self._fence(scope)
        rows = self.rows().withColumn("path", memory.row_key(F.col("owner"), F.col("id")))
        found = pick(rows, memory.history(self.log.read(), self.ops.read()), f)
        return rows.join(found, "path").select("id", "owner", "hits").orderBy(F.desc("hits"), "id")

    # --- fitting

    def assemble(self, units: DataFrame, budget: float | None, **how) -> DataFrame:
        self._note("assemble", {"budget": budget}, "")
        return folds.assemble(units, budget, **how)

    def summary_window(self, units: DataFrame, budget: float, summarize: Callable[[list[dict]], str] | None = None, **how) -> DataFrame:
        self._note("assemble", {"budget": budget, "summarize": summarize is not None}, "")
        return folds.summary_window(units, budget, summarize, **how)

    def trim(self, units: DataFrame, **how) -> DataFrame:
        self._note("trim", how, "")
        return folds.trim(units, **how)

    def compress(self, text: str, level: str, format: str | None = None, symbol: str | None = None) -> str:
        return parse.compress(text, level, format, symbol)

    # --- parked texts

    def stashed(self) -> DataFrame:
        last = self.parked.read().groupBy("id").agg(F.max_by(F.struct("op", "text", "created_at"), "seq").alias("r"))
        return last.filter("r.op = 'put'").select("id", "r.text", "r.created_at")

    def stash(self, id: str, text: str) -> None:
        seq = self.parked.latest() + 1
        self.parked.append(self.spark.createDataFrame([(seq, "put", id, text, self.clock())], self.parked.schema), base=seq - 1)
        self._note("stash", {"id": id}, f"{len(text)} characters")

    def peek(self, id: str) -> dict | None:
        row = self.stashed().filter(F.col("id") == id).select(T.peek(F.col("text")).alias("p")).first()
        return row["p"].asDict() if row else None

    def evict(self, **policy) -> int:
        gone = memory.evict(self.stashed(), **policy).distinct()
        seq, n = self.parked.latest() + 1, gone.count()
        if n:
            self.parked.append(gone.select(F.lit(seq).cast("long").alias("seq"), F.lit("del").alias("op"), "id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("created_at")), base=seq - 1)
        return n


class Scoped:
    """An engine seen by one tenant: the bound scope goes before any other."""

    VERBS = ("remember", "ingest", "forget", "recall", "get", "node", "count", "recent", "enumerate", "review", "promotions")

    def __init__(self, engine: Engine, scope):
        self._engine, self._scope = engine, scope

    def __getattr__(self, verb: str):
        if verb not in self.VERBS:
            raise AttributeError(f"{verb} is not offered by a scoped view")
        call = getattr(self._engine, verb)
        return lambda *a, **k: call(*a, **{**k, "scope": self._scope})


class StoreAdapter:
    """A host's store interface: reserved keys kind and by are split from the metadata and put back on read."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def store(self, text: str, metadata: dict | None = None) -> str:
        meta = dict(metadata or {})
        kind, by = meta.pop("kind", "fact"), meta.pop("by", "agent")
        key = f"{kind}:{uuid.uuid4()}"
        self.engine.remember(key, text, kind, by, meta=meta or None)
        return key

    def _row(self, r) -> dict:
        return {"id": r["id"], "text": r["text"], "metadata": {**json.loads(r["meta"] or "{}"), "kind": r["kind"], "by": r["provenance"]}}

    def get(self, key: str) -> dict | None:
        r = self.engine._visible(key, self.engine._fence(None))
        return self._row(r) if r else None

    def search(self, query: str, n: int = 10) -> list[dict]:
        """The n best rows of each kind that the engine's own fence lets through."""
        return [self._row(r) for r in self.engine.recall(query, n=n).collect()]

    def delete(self, key: str) -> bool:
        return self.engine.forget(id=key) > 0
