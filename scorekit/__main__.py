"""Command line: list or run registered queries.

    python -m scorekit list
    python -m scorekit run credibility_rank --data /root/testdata/sf0.01 [--out DIR] [--csv]
      [--show N] [--master local[8]]

``run`` writes the full result to ``--out`` (Parquet, or CSV with a header);
without ``--out`` it prints the first ``--show`` rows.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from scorekit.plans.registry import all_queries

    ap = argparse.ArgumentParser(prog="scorekit")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--data", required=True, help="folder with the input Parquet tables")
    run.add_argument("--out", help="write the whole result here")
    run.add_argument("--csv", action="store_true", help="write CSV instead of Parquet")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    queries = all_queries()
    if args.cmd == "list":
        for name in queries:
            print(name)
        return 0
    if args.query not in queries:
        print(f"unknown query {args.query!r}; see `python -m scorekit list`", file=sys.stderr)
        return 2
    from scorekit.session import get_spark, release_intermediates
    spark = get_spark("scorekit-cli", master=args.master)
    df = queries[args.query](spark, args.data)
    if args.out:
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(args.out) if args.csv else writer.parquet(args.out))
    else:
        df.show(args.show, truncate=False)
    release_intermediates(spark)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
