"""Mode sweep: the study's experiment run on Spark itself (M5, M8, M9).

For each concurrency level c (1, 2, 4, ...), c copies of the measured join run
at once (threads sharing one session, like applications started together), in
two modes: ``shuffle`` (sort-merge join, both sides hash-partitioned) and
``noshuffle`` (bucketed tables, no Exchange in the join). Each run appends the
study's log line ``... TpchQuery: End executing query. Time: <ms>`` to
``<root>/run<k>/<mode>/scale<j>.log``; the latency operators then read those
files back (``runs.file_latency``, ``latency_by_run``, ``latency_gap``).

The runs themselves are Spark jobs; only the timing lines are written by the
driver (one short line per run).
"""

from __future__ import annotations

import datetime as dt
import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from shoal.operators.joins import bucketed_join, equi_join, write_bucketed
from shoal.plans import runs
from shoal.sources import runlogs
from shoal.sources.tables import load

MODES = ("shuffle", "noshuffle")


def _join(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    if mode == "shuffle":
        return equi_join(o, li, "o_orderkey", "l_orderkey", "sort_merge")
    return bucketed_join(spark, "sweep_orders", "sweep_lineitem", "o_orderkey", "l_orderkey")


def _write_tables(spark: SparkSession, sf_dir: str) -> None:
    """The bucketed copies of the ``noshuffle`` mode, written anew for each sweep."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(load(spark, sf_dir, "orders"), "sweep_orders", "o_orderkey", n)
    write_bucketed(load(spark, sf_dir, "lineitem"), "sweep_lineitem", "l_orderkey", n)


def _timed_run(spark: SparkSession, sf_dir: str, mode: str, path: str) -> int:
    t0 = time.perf_counter()
    _join(spark, sf_dir, mode).write.format("noop").mode("overwrite").save()
    ms = int((time.perf_counter() - t0) * 1000)
    stamp = dt.datetime.now().strftime("%y/%m/%d %H:%M:%S")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a") as f:
        f.write(f"{stamp} INFO TpchQuery: Begin executing query\n")
        f.write(f"{stamp} INFO TpchQuery: End executing query. Time: {ms}\n")
    return ms


def run_mode_sweep(spark: SparkSession, sf_dir: str, root: str, levels=(1, 2), repeats: int = 1) -> str:
    """Run the sweep, writing latency logs under ``root``; returns ``root``.

    ``root`` must be a folder the driver can write and Spark can read (a shared
    folder on a cluster). Bucketed tables are written once, before timing.
    """
    _write_tables(spark, sf_dir)  # before any timing
    for k, c in enumerate(levels):
        for mode in MODES:
            for r in range(repeats):
                with ThreadPoolExecutor(max_workers=c) as pool:
                    paths = [os.path.join(root, f"run{k}", mode, f"scale{r * c + j}.log") for j in range(c)]
                    list(pool.map(lambda p: _timed_run(spark, sf_dir, mode, p), paths))
    return root


def analyze(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(latency per run and mode with concurrency, relative gap per run) from the logs."""
    files = runs.file_latency(runlogs.parse_latency(runlogs.read_latency_logs(spark, root)))
    return runs.latency_by_run(files), runs.latency_gap(files)
