"""Command line: analyze, symbols, deps, stats, graph, config."""

from __future__ import annotations

import argparse
import json
import os
import sys

from codeloom import config, model


def _print(rows, fmt: str) -> None:
    data = [r.asDict(recursive=True) for r in rows]
    if fmt == "json":
        print(json.dumps(data, default=str, ensure_ascii=False, indent=2))
    else:
        for r in data:
            print("\t".join("" if v is None else str(v) for v in r.values()))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--limit", type=int, default=100, help="rows shown")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "stats", "validate"):
        sub.add_parser(name).add_argument("root")
    for name in ("symbols", "deps"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("what", help="kind of symbols, or part of a name")
    sub.add_parser("languages")
    sub.add_parser("config")
    args = p.parse_args(argv)
    if args.command == "languages":
        print("\n".join(model.LANGUAGES))
        return 0
    if args.command == "config":
        print(json.dumps(config.load(environ=dict(os.environ)), indent=2))
        return 0
    from pyspark.sql import SparkSession

    from codeloom.api import analyze
    from codeloom.sources import files

    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    a = analyze(spark, args.root, config.load(environ=dict(os.environ)))
    table = {
        "analyze": lambda: a.summary(),
        "stats": lambda: files.loc_by_language(a.texts),
        "validate": lambda: a.validate(),
        "symbols": lambda: a.by_kind(args.what).select("file_path", "start_line", "kind", "qualified_name").orderBy("file_path", "start_line"),
        "deps": lambda: a.find_dependencies(args.what),
    }[args.command]()
    _print(table.limit(args.limit).collect(), args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
