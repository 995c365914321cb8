"""Runs a query from the command line: python -m rillframe QUERY FOLDER TARGET, or --list."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import os

from rillframe.plans import catalogue
from rillframe.session import build_session, make_importable
from rillframe.sinks.bundle import publish


def main(args: list[str] | None = None) -> None:
    names = dict(catalogue.QUERIES)
    if importlib.util.find_spec("rillframe.llm") is not None:
        names |= importlib.import_module("rillframe.llm.catalogue").QUERIES
    parser = argparse.ArgumentParser(prog="rillframe")
    parser.add_argument("query", nargs="?", choices=sorted(names), metavar="QUERY")
    parser.add_argument("folder", nargs="?", help="folder of the tables")
    parser.add_argument("target", nargs="?", help="where the result goes")
    parser.add_argument("--list", action="store_true", help="name the queries")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    given = parser.parse_args(args)
    if given.list:
        print("\n".join(sorted(names)))
        return
    if not given.target:
        parser.error("QUERY, FOLDER and TARGET are needed")
    spark = build_session(given.master)
    make_importable(spark)
    publish(names[given.query](spark, given.folder), given.target, overwrite=given.overwrite, fmt=given.format)


if __name__ == "__main__":
    main()
