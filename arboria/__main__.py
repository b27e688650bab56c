"""Command line: index, status, zoom, context, watch, over a store given by --db."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.api import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arboria", description=__doc__)
    p.add_argument("--db", default=".arboria", help="folder or URI of the store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="index a source tree")
    c.add_argument("path")
    c.add_argument("--reset", action="store_true", help="forget all roots first")
    c.add_argument("--max-files", type=int, default=2000)
    c.add_argument("--max-symbols", type=int, default=20000)
    c = sub.add_parser("status", help="counts and roots")
    c.add_argument("--compact", action="store_true", help="few enough lines for a prompt")
    c = sub.add_parser("focus", help="the node meant by an id or words, and the camera for it")
    c.add_argument("node")
    c.add_argument("--zoom", type=float, default=0.0)
    c.add_argument("--closed", action="store_true", help="look at it without opening it")
    sub.add_parser("repair", help="find damaged buckets; the next index writes them again")
    c = sub.add_parser("migrate", help="take over a graph that is one JSON document")
    c.add_argument("document")
    c = sub.add_parser("zoom", help="ranked nodes of a query")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=8)
    c = sub.add_parser("context", help="context of a query within a budget of characters")
    c.add_argument("query")
    c.add_argument("--budget", type=int, default=1500)
    c.add_argument("--root")
    c = sub.add_parser("watch", help="index changes as they happen")
    c.add_argument("path")
    c.add_argument("--quiet", type=float, default=0.15, help="seconds for which a file has to stay as it is")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("arboria").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.db)
    match a.command:
        case "index":
            out = e.index(a.path, a.reset, a.max_files, a.max_symbols)
        case "status":
            out = e.compact_status() if a.compact else e.status()
        case "focus":
            out = e.focus(a.node, not a.closed, a.zoom)
        case "repair":
            out = e.store.repair()
        case "migrate":
            out = e.store.migrated(a.document)
        case "zoom":
            out = e.zoom_query(a.query, a.limit)
        case "context":
            out = e.context(a.query, a.budget, a.root)
        case _:
            e.watch(a.path, f"{a.db}/_watch", said=lambda x: print(json.dumps(x)), quiet=a.quiet).awaitTermination()
            return 0
    print(json.dumps(out, default=str) if a.json or a.command != "context" else out["compiled_context"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
