"""Runs a query by name: python -m mosaicq list | run NAME --tables FOLDER [--out FOLDER] [--rows N] [--sql]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from mosaicq.plans.all_queries import ORACLES, QUERIES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mosaicq", description=__doc__)
    kinds = p.add_subparsers(dest="do", required=True)
    kinds.add_parser("list", help="names of all queries").add_argument("--like", default="", help="only names that hold this")
    run = kinds.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(QUERIES), metavar="NAME")
    run.add_argument("--tables", required=True, help="folder or address of the tables' Parquet files")
    run.add_argument("--out", help="write the whole result there as Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show if nothing is written")
    run.add_argument("--sql", action="store_true", help="show the query's SQL for another engine instead")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.do == "list":
        print("\n".join(n for n in sorted(QUERIES) if a.like in n))
        return 0
    if a.sql:
        print(ORACLES.get(a.name, "this query has no SQL"))
        return int(a.name not in ORACLES)
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    df = QUERIES[a.name](spark, a.tables.rstrip("/"))
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
