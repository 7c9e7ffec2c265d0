"""Command line: run one query and log its time.

    python -m shoal run --query 0 --sf-dir /data/sf100           # 0 join, 1 aggregation, 2 filter
    python -m shoal run --query pricing_summary --sf-dir ... --log run1/shuffle/scale1.log
    python -m shoal explain --query market_share --sf-dir ...      # physical plan (M7)
    python -m shoal list

The query runs to completion (``noop`` sink, or ``--show`` for the first rows);
the elapsed milliseconds go to ``--log`` as the line the latency operators
parse (``... INFO TpchQuery: End executing query. Time: <ms>``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
import time

STUDY_QUERIES = {"0": "join_orders_lineitem", "1": "count_by_shipmode", "2": "filter_discount"}


def _log(path: str | None, message: str) -> None:
    line = f"{dt.datetime.now().strftime('%y/%m/%d %H:%M:%S')} INFO TpchQuery: {message}"
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "a") as f:
            f.write(line + "\n")
    print(line, file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m shoal")
    sub = parser.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="run one registered query")
    run.add_argument("--query", required=True, help="0 join, 1 aggregation, 2 filter, or a query name")
    run.add_argument("--sf-dir", required=True, help="folder with the <table>.parquet files")
    run.add_argument("--strategy", choices=["auto", "sort_merge", "shuffle_hash", "broadcast", "bucketed"],
                     help="join strategy for the join query")
    run.add_argument("--log", help="append the timing line to this file")
    run.add_argument("--show", action="store_true", help="print the first rows instead of a full run")
    run.add_argument("--master", help="e.g. local[8]; omit under spark-submit")
    exp = sub.add_parser("explain", help="print the physical plan of a query (M7)")
    exp.add_argument("--query", required=True)
    exp.add_argument("--sf-dir", required=True)
    exp.add_argument("--mode", default="formatted", choices=["simple", "extended", "formatted", "cost"])
    exp.add_argument("--master")
    sub.add_parser("list", help="list query names")
    args = parser.parse_args(argv)

    from shoal.plans import catalog
    if args.cmd == "list":
        print("\n".join(sorted(catalog.RAW)))
        return 0

    from shoal.session import build_session
    spark = build_session(args.master, app_name=f"shoal {args.query}")
    name = STUDY_QUERIES.get(args.query, args.query)
    if args.cmd == "explain":
        catalog.RAW[name](spark, args.sf_dir).explain(args.mode)
        return 0
    if name == "join_orders_lineitem" and args.strategy:
        name = "join_orders_lineitem" if args.strategy == "auto" else f"join_{args.strategy}"
    df = catalog.RAW[name](spark, args.sf_dir)
    _log(args.log, "Begin executing query")
    t0 = time.perf_counter()
    if args.show:
        df.show()
    else:
        df.write.format("noop").mode("overwrite").save()
    _log(args.log, f"End executing query. Time: {int((time.perf_counter() - t0) * 1000)}")
    spark.catalog.clearCache()
    return 0


if __name__ == "__main__":
    sys.exit(main())
