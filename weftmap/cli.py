"""Commands: map, stats, impact, search, serve (the default). Results on standard output, all else on standard error."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .errors import WeftError


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("weftmap").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("WEFTMAP_PARTITIONS", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftmap")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--root", default=".")
    p.add_argument("--resolution", choices=("compat", "strict"), default="compat")
    sub = p.add_subparsers(dest="command")
    m = sub.add_parser("map")
    m.add_argument("path", nargs="?", help="file to rank for, as --focus")
    m.add_argument("--focus", help="file to rank for")
    m.add_argument("--budget", default="2048")
    sub.add_parser("stats")
    sub.add_parser("impact").add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--kind")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    args = parser().parse_args(argv)
    out = out or sys.stdout
    from .plans import queries as q
    from .plans.index import build_index
    from .sources.tree import resolved, rooted

    try:
        spark = spark or session()
        root = rooted(args.root)
        if args.command in (None, "serve"):
            from .serve import serve

            serve(spark, root, sys.stdin, out)
            return 0
        index = build_index(spark, root, (args.focus or args.path) if args.command == "map" else None, args.resolution)
        if args.command == "map":
            text = q.map_text(index, q.checked_budget(args.budget))
        elif args.command == "stats":
            text = q.stats_text(index)
        elif args.command == "impact":
            text = q.impact_report(index, resolved(root, args.path))
        else:
            text = q.search_report(index, args.query, args.kind)
        out.write(text + "\n")
        return 0
    except WeftError as e:
        sys.stderr.write(f"Error: {e.message}\nHint: {e.hint}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
