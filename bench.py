"""Timed runs of the headline queries (M5, M8).

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion into the ``noop`` sink (every row produced,
nothing collected): one warm-up, then the median of ``BENCH_REPEAT`` (default
3) runs. Queries are timed with their native output types (``catalog.RAW``);
the DECIMAL->DOUBLE / DATE->text normalisation of ``queries()`` exists only for
the DuckDB comparison and is not timed. Shuffle bytes per query come from the session's own event log, read
back with ``shoal.sources.runlogs.read_event_log`` -- the same reader the
stage-metrics query uses. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shoal.plans import catalog  # noqa: E402
from shoal.session import build_session  # noqa: E402

HEADLINE = [
    # the three study queries (join, aggregation, filter) and the join strategies
    "join_orders_lineitem", "count_by_shipmode", "filter_discount",
    "join_sort_merge", "join_shuffle_hash", "join_broadcast", "join_bucketed",
    "join_no_key_filter", "join_key_filter",
    # TPC-H templates and variants
    "pricing_summary", "market_share", "shipmode_priority", "customer_distribution",
    "promo_effect", "top_supplier",
    # checks, refresh, windows, run logs
    "fk_violations", "order_rollup", "refresh_delete_lineitem", "chunk_assign",
    "trim_per_group", "footprint", "latency_by_run",
    # table generation: lineitem regenerated for every order key of the input
    "gen_lineitem",
]


def shuffle_bytes_by_group(spark, log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, from the event log of this session."""
    from shoal.sources.runlogs import TASK_END_SCHEMA
    from pyspark.sql import types as T
    schema = T.StructType(TASK_END_SCHEMA.fields + [
        T.StructField("Job ID", T.LongType()),
        T.StructField("Stage IDs", T.ArrayType(T.LongType())),
        T.StructField("Properties", T.MapType(T.StringType(), T.StringType()))])
    ev = spark.read.schema(schema).option("recursiveFileLookup", "true").json(log_dir)
    jobs = (ev.filter(F.col("Event") == "SparkListenerJobStart")
            .select(F.col("Properties")["spark.jobGroup.id"].alias("grp"),
                    F.explode("Stage IDs").alias("stage")))
    tasks = (ev.filter(F.col("Event") == "SparkListenerTaskEnd")
             .select(F.col("Stage ID").alias("stage"),
                     F.col("Task Metrics")["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("b")))
    per = tasks.join(jobs, "stage").groupBy("grp").agg(F.sum("b").alias("b"))
    return {r["grp"]: int(r["b"] or 0) for r in per.collect() if r["grp"]}


def _session(cpus: int, app: str, extra: dict | None = None):
    conf = {"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="shoal-bench-wh-")}
    conf.update(extra or {})
    return build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name=app, extra=conf)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE

    # 1. timing: no event log (writing every task event would be timed too)
    spark = _session(cpus, "shoal-bench")
    # JVM warm-up (class loading, JIT of scan/join/aggregate code) before any timing
    for name in ("join_orders_lineitem", "pricing_summary", "order_rollup"):
        catalog.RAW[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        fn = catalog.RAW[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs), 3)
    # the baseline's one figure is input rows per second of the orders x lineitem join
    from shoal.sources.tables import load
    join_rows = load(spark, sf_dir, "orders").count() + load(spark, sf_dir, "lineitem").count()
    spark.stop()

    # 2. shuffle bytes: one more run per query with the event log on, read back with Spark
    shuffle: dict[str, int] = {}
    if os.environ.get("BENCH_SHUFFLE", "1") == "1":
        log_dir = tempfile.mkdtemp(prefix="shoal-bench-events-")
        spark = _session(cpus, "shoal-bench-shuffle",
                         {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                          "spark.eventLog.compress": "false"})
        for name in names:
            spark.sparkContext.setJobGroup(name, name)   # what building the query runs and writes is its own
            df = catalog.RAW[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        spark.stop()  # flush the event log
        spark = _session(2, "shoal-bench-report", {"spark.eventLog.enabled": "false"})
        try:
            by_group = shuffle_bytes_by_group(spark, log_dir)
            shuffle = {n: by_group.get(n, 0) for n in names}
        except Exception:  # noqa: BLE001 -- the report must still print
            shuffle = {}
        spark.stop()

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "shuffle_bytes": shuffle,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus,
                      "repeat": repeat, "join_input_rows": join_rows,
                      "join_rows_per_sec": (round(join_rows / times["join_orders_lineitem"])
                                            if times.get("join_orders_lineitem") else None)}))


if __name__ == "__main__":
    main()
