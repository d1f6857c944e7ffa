"""Command line: ``python -m plinth {index,search,query,status,graph} ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from plinth.plans.pipeline import Engine
from plinth.session import session


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="plinth")
    parser.add_argument("--store", required=True, help="folder of the tables")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="read a folder of source files")
    index.add_argument("folder")
    index.add_argument("owner")
    index.add_argument("name")
    index.add_argument("--replace", action="store_true", help="put the new state in place of the old one")
    for name in ("search", "query"):
        ask = sub.add_parser(name)
        ask.add_argument("repository")
        ask.add_argument("text")
    sub.add_parser("status").add_argument("repository")
    graph = sub.add_parser("graph")
    graph.add_argument("repository")
    graph.add_argument("--focus")
    graph.add_argument("--hops", type=int)
    given = parser.parse_args(args)
    engine = Engine(spark or session(), given.store)
    out: list = []
    if given.command == "index":
        out = [engine.index(given.folder, given.owner, given.name, "replace" if given.replace else "insert_only")]
    elif given.command == "status":
        out = [engine.status(given.repository)]
    elif engine.status(given.repository)["state"] != "ready":
        print(f"repository {given.repository} is not indexed", file=sys.stderr)
        return 1
    elif given.command == "graph":
        out = (r.asDict() for r in engine.graph(given.repository, given.focus, given.hops).toLocalIterator())
    else:
        asked = engine.spark.createDataFrame([(1, given.text)], "query_id int, query string")
        found = engine.search(given.repository, asked).orderBy("rank") if given.command == "search" else engine.ask(given.repository, asked)
        out = [r.asDict() for r in found.collect()]  # as many rows as a result has
    for row in out:
        print(json.dumps(row, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
