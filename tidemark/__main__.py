"""Command line: list the queries, run one and write or show its result.

    python -m tidemark list
    python -m tidemark run session_bars /data/sf0.1 --out /data/out/session_bars
    python -m tidemark explain asof_backward /data/sf0.1
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import catalog
from .operators.publish import content_id


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries, and whether SQL checks them")
    for name in ("run", "explain"):
        one = commands.add_parser(name)
        one.add_argument("query", choices=sorted(catalog.queries()))
        one.add_argument("tables", help="folder of the tables")
        if name == "run":
            one.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
            one.add_argument("--id", action="store_true", help="print the content id of the result")
    args = parser.parse_args(argv)
    if args.command == "list":
        checked = catalog.oracle_sql()
        for name in sorted(catalog.queries()):
            print(name, "sql" if name in checked else "-")
        return 0
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = catalog.queries()[args.query](spark, args.tables)
    if args.command == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").parquet(args.out)
    else:
        df.show(20, truncate=60)
    if args.command == "run" and args.id:
        print(content_id(df, args.query))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
