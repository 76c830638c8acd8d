"""Command line: tab-separated rows over one root folder."""

from __future__ import annotations

import argparse
import sys

from . import session
from .api import Engine
from .functions import text as T
from .index import SourceIndex
from .operators.fences import GLOBAL


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairnlake")
    p.add_argument("--root", required=True)
    p.add_argument("--scope", help="a tenant, or - for the shared tier")
    sub = p.add_subparsers(dest="verb", required=True)
    r = sub.add_parser("remember")
    r.add_argument("id")
    r.add_argument("text")
    r.add_argument("--kind", default="fact")
    r.add_argument("--by", default="human")
    q = sub.add_parser("recall")
    q.add_argument("query")
    q.add_argument("--kind")
    q.add_argument("-n", type=int)
    for verb in ("get", "forget"):
        sub.add_parser(verb).add_argument("id")
    sub.add_parser("ingest").add_argument("file")
    for verb in ("recent", "count", "promotions"):
        sub.add_parser(verb)
    i = sub.add_parser("index", help="bring the index of a source folder up to date")
    i.add_argument("source")
    i.add_argument("pathspecs", nargs="*")
    i.add_argument("--force", action="store_true")
    m = sub.add_parser("impact", help="what a change of symbols would touch, by the index of a source folder")
    m.add_argument("source")
    m.add_argument("symbols", nargs="+")
    sub.add_parser("help")
    a = p.parse_args(argv)
    if a.verb == "help":
        p.print_help()
        return 0
    spark = session.build()
    e = Engine(spark, a.root)
    scope = GLOBAL if a.scope == "-" else a.scope
    if a.verb == "remember":
        e.remember(a.id, a.text, a.kind, a.by, scope=scope)
    elif a.verb == "recall":
        for r in e.recall(a.query, (a.kind,) if a.kind else ("fact", "episode", "doc"), a.n, scope).collect():
            print(r["kind"], r["rank"], r["id"], f"{r['score']:.4f}", r["use"], sep="\t")
    elif a.verb == "get":
        text = e.get(a.id, scope)
        if text is None:
            return 1
        print(text)
    elif a.verb == "forget":
        print(e.forget(id=a.id, scope=scope))
    elif a.verb == "ingest":
        with open(a.file, "rb") as f:
            print(*e.ingest(a.file.rsplit("/", 1)[-1], f.read(), scope=scope), sep="\n")
    elif a.verb == "recent":
        from pyspark.sql import functions as F

        for r in e.recent(scope).withColumn("age", T.relative_age(F.lit(e.clock()) - F.col("at"))).collect():
            print(r["id"], r["kind"], r["age"], sep="\t")
    elif a.verb == "promotions":
        for r in e.promotions(scope).collect():
            print(r["id"], r["hits"], sep="\t")
    elif a.verb == "index":
        for status, n in SourceIndex(spark, f"{a.root}/index", a.source).build(a.pathspecs or None, a.force).items():
            print(status, n, sep="\t")
    elif a.verb == "impact":
        for r in SourceIndex(spark, f"{a.root}/index", a.source).impact(*a.symbols).orderBy("symbol").collect():
            print(r["symbol"], r["risk"], r["ref_count"], r["complexity"], "; ".join(r["hedges"]), sep="\t")
    else:
        print(e.count(scope))
    session.release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
