"""Runs a query by name: ``python -m verigate QUERY TABLES [OUT]`` prints its rows, or writes them as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from verigate.plans import catalogue


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m verigate", description="Run a query of the catalogue over a folder of tables.")
    ap.add_argument("query", choices=sorted(catalogue.QUERIES))
    ap.add_argument("tables", help="folder with one Parquet file or folder for each table")
    ap.add_argument("out", nargs="?", help="where to write the rows; without it they are shown")
    ap.add_argument("--rows", type=int, default=20, help="how many rows to show")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = catalogue.QUERIES[args.query](spark, args.tables)
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
    else:
        found.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
