"""Run-log analytics: latency per run and mode, transfer footprints, stage metrics.

The reference walks folders in one Python process, keeps dicts per file and
draws plots. Here each step is a grouped aggregate over all runs at once; the
plots' data come out as tables.

Latency (M9, D10, D11, D14, D15, E4)
    file latency = elapsed ms of the *last* matching line of the file (max_by
    on the line number); per (run, mode): mean and population deviation in
    seconds; concurrency of a run = 2^(rank of its folder name - 1), a double.
Transfer (M10, D8, D9, D12, D13, E7, H8-H10)
    bytes per (run, process, second); totals and active seconds per process;
    per-second series in Mbps indexed 0.. and zero-padded to the longest + 1.

Byte sums are exact; mean and deviation are Spark's own aggregates, rounded so
that the order of summation does not show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import cut_lineage

MIB = 1024 * 1024


# --------------------------------------------------------------------------- latency
def file_latency(parsed: DataFrame) -> DataFrame:
    """(run, mode, name, latency_ms): the last matching line of each file wins."""
    return (parsed.groupBy("run", "mode", "name")
            .agg(F.max_by("elapsed_ms", "line_no").alias("latency_ms")))


def concurrency(runs: DataFrame) -> DataFrame:
    """(run, concurrency): folder order 1, 2, 4, ... as a double (E4); one row holds the names of the run folders."""
    names = runs.agg(F.array_sort(F.collect_set("run")).alias("names"))
    return names.select(F.posexplode("names").alias("pos", "run")).select("run", F.pow(F.lit(2.0), F.col("pos")).alias("concurrency"))


def latency_by_run(files: DataFrame) -> DataFrame:
    """(run, concurrency, mode, files, mean_s, std_s).

    Mean and population deviation of the file latencies in seconds, fractions of
    a millisecond included, to six places.
    """
    s = F.col("latency_ms") / 1000
    out = files.groupBy("run", "mode").agg(
        F.count(F.lit(1)).alias("files"), F.round(F.avg(s), 6).alias("mean_s"), F.round(F.stddev_pop(s), 6).alias("std_s"))
    return out.join(concurrency(files), "run")


def latency_gap(files: DataFrame) -> DataFrame:
    """(run, shuffle_ms, noshuffle_ms, gap): first file of each mode, ``round((f-s)/s, 4)`` half-even."""
    first = (files.groupBy("run").agg(
        F.min_by(F.when(F.col("mode") == "shuffle", F.col("latency_ms")),
                 F.when(F.col("mode") == "shuffle", F.col("name"))).alias("shuffle_ms"),
        F.min_by(F.when(F.col("mode") == "noshuffle", F.col("latency_ms")),
                 F.when(F.col("mode") == "noshuffle", F.col("name"))).alias("noshuffle_ms")))
    gap = F.bround((F.col("shuffle_ms") - F.col("noshuffle_ms")) / F.nullif(F.col("noshuffle_ms"), F.lit(0.0)), 4)
    return first.withColumn("gap", gap)


def latency_box(files: DataFrame) -> DataFrame:
    """(mode, n, p0, p25, p50, p75, p100) in seconds: the box-plot numbers.

    Exact quantiles (as ``percentile``) from counts per (mode, latency), so a
    mode's values are never gathered into one task.
    """
    from shoal.operators.windows import exact_quantiles
    names = ["p0", "p25", "p50", "p75", "p100"]
    q = exact_quantiles(files, ["mode"], "latency_ms", [0.0, 0.25, 0.5, 0.75, 1.0], names)
    return q.select("mode", "n", *[(F.col(n) / 1000).alias(n) for n in names])


SKETCH_K = 800              # size of a sketch; about 4 k numbers at most
SKETCH_ERROR = 3 * 2.296 / SKETCH_K ** 0.9723      # three times the sketch's stated error of a normalised rank (99 % of cases)


def latency_sketches(files: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(run, mode, n, sketch): a quantile sketch of each run's latencies; a new run adds rows, no old one is read again."""
    return files.groupBy("run", "mode").agg(F.count("latency_ms").alias("n"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(mode, n, p, latency_ms): quantiles over all runs from their merged sketches, of bounded size whatever the runs."""
    merged = sketches.groupBy("mode").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = F.array(*(F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("latency_ms")) for p in probs))
    return merged.select("mode", "n", F.inline(at))


def rank_errors(files: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(mode, n, p, latency_ms, error): how far p lies from the exact ranks of the quantile, 0 between them."""
    counts = files.groupBy("mode", "latency_ms").agg(F.count("*").alias("c"))       # one row per value
    met = counts.withColumnRenamed("latency_ms", "value").join(quantiles, "mode").groupBy("mode", "n", "p", "latency_ms").agg(
        F.sum(F.when(F.col("value") < F.col("latency_ms"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("latency_ms"), F.col("c")).otherwise(0)).alias("upto"))
    return met.select("mode", "n", "p", "latency_ms", F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0)).alias("error"))


# --------------------------------------------------------------------------- transfer
def transfer_per_second(parsed: DataFrame) -> DataFrame:
    """(run, pid, second, bytes): amount per process per second over all files of a run."""
    return parsed.groupBy("run", "pid", "second").agg(F.sum("bytes").alias("bytes"))


def mbps(bytes_col) -> F.Column:
    """Whole Mbps from bytes per second: ``int(MiB * 8 * 1024 * 1024 / 1e6)``."""
    mib = bytes_col.cast("double") / MIB
    return F.floor(mib * 8 * 1024 * 1024 / 1000000).cast("long")


def transfer_totals(per_second: DataFrame) -> DataFrame:
    """(run, pid, total_mib, active_seconds, peak_mbps) per process."""
    return (per_second.groupBy("run", "pid")
            .agg((F.sum("bytes").cast("double") / MIB).alias("total_mib"),
                 F.count(F.lit(1)).alias("active_seconds"),
                 F.max(mbps(F.col("bytes"))).alias("peak_mbps")))


def footprint(per_second: DataFrame) -> DataFrame:
    """(run, pid, idx, mbps): each process's series by position, zero-padded to the
    run's longest series + 1 (E7). Gaps in time are dropped, as in the plot."""
    # position in the series without a per-process window: hour blocks bound every
    # window to 3,600 rows, a running sum over one row per hour adds the offset
    from shoal.operators.windows import block_row_number
    per_second = cut_lineage(per_second)                # aggregated once, read four times
    series = (block_row_number(per_second, ["run", "pid"], "second", 3600)
              .select("run", "pid", (F.col("rn") - 1).alias("idx"), mbps(F.col("bytes")).alias("mbps")))
    lengths = per_second.groupBy("run", "pid").agg(F.count(F.lit(1)).alias("len"))
    span = lengths.groupBy("run").agg(F.max("len").alias("index_num"))
    padding = (lengths.join(span, "run")                          # one row per process
               .select("run", "pid", F.explode(F.sequence(F.col("len"), F.col("index_num"))).alias("idx"), F.lit(0).cast("long").alias("mbps")))
    return series.unionByName(padding)


def first_process_series(parsed: DataFrame) -> DataFrame:
    """(file_tag, pid, second, mib): the series of the first process seen in each file.

    ``file_tag`` is the part of the base name between ``_`` and ``.``.
    """
    tag = F.element_at(F.split(F.element_at(F.split("name", "_"), 2), r"\."), 1)
    tagged = parsed.withColumn("file_tag", tag)
    per = tagged.groupBy("run", "name", "file_tag", "pid", "second").agg(F.sum("bytes").alias("bytes"), F.min("line_no").alias("line_no"))
    first = per.groupBy("run", "name").agg(F.min_by("pid", "line_no").alias("pid"))
    return (per.join(first, ["run", "name", "pid"]).groupBy("run", "file_tag", "pid", "second")
            .agg((F.sum("bytes").cast("double") / MIB).alias("mib")))


# --------------------------------------------------------------------------- event logs
def stage_metrics(events: DataFrame) -> DataFrame:
    """Per application, stage and attempt: task count and summed task metrics from task-end events."""
    m = F.col("Task Metrics")
    sums = {"run_time_ms": m["Executor Run Time"], "cpu_time_ns": m["Executor CPU Time"], "gc_time_ms": m["JVM GC Time"],
            "shuffle_bytes_written": m["Shuffle Write Metrics"]["Shuffle Bytes Written"],
            "remote_bytes_read": m["Shuffle Read Metrics"]["Remote Bytes Read"],
            "local_bytes_read": m["Shuffle Read Metrics"]["Local Bytes Read"],
            "input_bytes": m["Input Metrics"]["Bytes Read"], "input_records": m["Input Metrics"]["Records Read"],
            "spilled_bytes": m["Memory Bytes Spilled"], "disk_spilled_bytes": m["Disk Bytes Spilled"]}
    return (events.filter(F.col("Event") == "SparkListenerTaskEnd")
            .groupBy("application", F.col("Stage ID").alias("stage_id"), F.col("Stage Attempt ID").alias("attempt"))
            .agg(F.count(F.lit(1)).alias("tasks"), *(F.sum(c).alias(n) for n, c in sums.items())))
