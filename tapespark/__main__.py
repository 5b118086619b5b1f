"""python -m tapespark list | run QUERY TABLES [OUT] | catalogue FOLDER | check LOG [--repair]."""

from __future__ import annotations

import argparse

from . import catalogue, session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tapespark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables; print it or write Parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out", nargs="?")
    logs = commands.add_parser("catalogue", help="streams and time bounds of a folder of Parquet records")
    logs.add_argument("folder")
    check = commands.add_parser("check", help="check a record log")
    check.add_argument("log")
    check.add_argument("--repair", action="store_true", help="cut off what wasn't committed")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
    elif args.command == "check":
        from .sources import recordlog

        print("frames %d, rows %d, bytes cut off %d" % recordlog.check(args.log, args.repair, payloads=True))
    else:
        spark = session.local()
        session.prepare(spark)
        if args.command == "run":
            out = catalogue.queries()[args.query](spark, args.tables)
            out.write.parquet(args.out) if args.out else out.show(50, truncate=False)
        else:
            from pyspark.sql import functions as F

            from .sources import files

            rows = spark.read.parquet(args.folder).select(F.regexp_replace("_metadata.file_name", r"\.parquet$", "").alias("stem"), "local_ts_ns")
            files.catalogue(rows, "stem", "local_ts_ns").show(100, truncate=False)


if __name__ == "__main__":
    main()
