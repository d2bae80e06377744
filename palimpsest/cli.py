"""Command line: insert, update, delete, search, stats over one store."""

from __future__ import annotations

import argparse

from palimpsest.session import local_session
from palimpsest.store import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--store", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("insert").add_argument("text")
    u = sub.add_parser("update")
    u.add_argument("id", type=int)
    u.add_argument("text")
    sub.add_parser("delete").add_argument("id", type=int)
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("k", type=int, nargs="?", default=10)
    sub.add_parser("stats")
    a = p.parse_args(argv)
    spark = local_session("*")
    e = Engine(spark, a.store)
    if a.command in ("insert", "update") and a.text in ("", "-"):
        p.error("a text is needed")
    if a.command == "insert":
        print(e.insert(spark.createDataFrame([(a.text,)], "text string")).first()["id"])
    elif a.command == "update":
        e.update(spark.createDataFrame([(a.id, a.text)], "id long, text string"))
    elif a.command == "delete":
        e.delete(spark.createDataFrame([(a.id,)], "id long"))
    elif a.command == "search":
        e.search(spark.createDataFrame([(0, a.text)], "qid long, text string"), min(max(a.k, 1), 100)).orderBy("rank").show(truncate=False)
    else:
        e.stats().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
