"""Run logs as DataFrames.

Three inputs the benchmark study produces:

* latency logs ``<root>/<run>/<mode>/scale*``: text lines, one of which ends
  ``TpchQuery: End executing query. Time: <ms>`` (A8);
* transfer logs ``<root>/<run>/shuffle/workerLoad*``: TSV
  ``epoch_ms <TAB> x <TAB> bytes [<TAB> pid@host]`` (A9);
* Spark event logs: one JSON object per line (A10).

Readers take folders of real files. ``*_from_events`` derive the same record
shapes from the driver ``events`` table, so analytics run on data that grows
with the input. Every reader returns (file, line_no, value) or parsed columns;
line order inside a file is kept explicitly (``line_no``), since row order of a
text scan is not a contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The latency line pattern (date, time, level, elapsed ms).
LATENCY_REGEX = r"^(\S+) (\S+) (\S+) TpchQuery: End executing query\. Time: (\S+)"


# --------------------------------------------------------------------------- text files with line numbers
def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value) for every line of every file (G1).

    Files are split like any text input, so a large log is many tasks. ``line_no``
    is (start of the split, place in it): it orders the lines of a file and is
    unique in it, without counting the lines before.
    """
    return (spark.read.text(paths)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("line_no"),
                    "value"))


def path_parts(file: Column) -> list[Column]:
    """run (grand-parent folder), mode (parent folder) and base name of a log path (H7)."""
    return [F.element_at(F.split(file, "/"), -3).alias("run"),
            F.element_at(F.split(file, "/"), -2).alias("mode"),
            F.element_at(F.split(file, "/"), -1).alias("name")]


# --------------------------------------------------------------------------- latency
def parse_latency(lines: DataFrame) -> DataFrame:
    """Keep matching lines and extract date, time, level and elapsed ms."""
    v = F.col("value")
    return (lines.filter(v.rlike(LATENCY_REGEX))
            .withColumn("log_date", F.regexp_extract(v, LATENCY_REGEX, 1))
            .withColumn("log_time", F.regexp_extract(v, LATENCY_REGEX, 2))
            .withColumn("level", F.regexp_extract(v, LATENCY_REGEX, 3))
            .withColumn("elapsed_ms", F.regexp_extract(v, LATENCY_REGEX, 4).try_cast("double"))
            .filter("elapsed_ms is not null"))


def bad_lines(lines: DataFrame, kind: str) -> DataFrame:
    """(run, bad_lines): lines that look like records of ``kind`` but hold a field that is no number."""
    v = F.col("value")
    if kind == "latency":
        bad = v.rlike(LATENCY_REGEX) & F.regexp_extract(v, LATENCY_REGEX, 4).try_cast("double").isNull()
    else:
        f = F.split(v, "\t")
        bad = (F.size(f) >= 3) & _transfer_fields(f)[3]
    return lines.groupBy("run").agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_lines"))


def read_latency_logs(spark: SparkSession, root: str) -> DataFrame:
    """All ``<root>/<run>/<mode>/scale*`` files as (run, mode, name, line_no, value)."""
    lines = read_lines(spark, f"{root.rstrip('/')}/*/*/scale*")
    return lines.select(*path_parts(F.col("file")), "line_no", "value")


def _ts_text(ts: Column) -> tuple[Column, Column]:
    return F.date_format(ts, "yy/MM/dd"), F.date_format(ts, "HH:mm:ss")


def latency_lines_from_events(events: DataFrame) -> DataFrame:
    """Latency log lines derived from ``events`` (one line per event).

    run = ``run<user_id % 4>``; mode = shuffle for even event ids, noshuffle for
    odd; file = ``scale<user_id>.log``; line order = event id. Error events
    write a line that does not match; the others end with ``Time:
    <floor(value * 100)>`` and a fraction of quarters, but for every 97th, whose
    number is spoiled by a letter.
    """
    d, t = _ts_text(F.col("ts"))
    msg = F.when(F.col("event_type") == "error",
                 F.concat(d, F.lit(" "), t, F.lit(" ERROR TaskSetManager: Lost task 0.0 in stage 1.0")))\
           .otherwise(F.concat(d, F.lit(" "), t, F.lit(" INFO TpchQuery: End executing query. Time: "),
                               F.floor(F.col("value") * 100).cast("string"), F.lit("."), (F.col("event_id") % 4 * 25).cast("string"),
                               F.when(F.col("event_id") % 97 == 0, "x").otherwise("")))
    return events.select(
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run"),
        F.when(F.col("event_id") % 2 == 0, "shuffle").otherwise("noshuffle").alias("mode"),
        F.concat(F.lit("scale"), F.col("user_id").cast("string"), F.lit(".log")).alias("name"),
        F.col("event_id").alias("line_no"), msg.alias("value"))


# --------------------------------------------------------------------------- transfer
def _transfer_fields(f: Column) -> tuple[Column, Column, Column, Column]:
    """(epoch_ms, bytes, pid, bad) of the split fields of a line with three or more."""
    ms, amount = F.get(f, F.lit(0)).try_cast("long"), F.get(f, F.lit(2)).try_cast("long")
    pid = F.when(F.size(f) == 3, F.lit(-1)).otherwise(F.element_at(F.split(F.get(f, F.lit(3)), "@"), 1).try_cast("int"))
    return ms, amount, pid, ms.isNull() | amount.isNull() | pid.isNull()


def parse_transfer(lines: DataFrame) -> DataFrame:
    """TSV fields to (epoch_ms, second, bytes, pid); lines with < 3 fields dropped.

    pid is -1 for 3-field lines, else the number before ``@`` in field 4 (H9). A
    line with a field that is no number is dropped; ``bad_lines`` counts them.
    """
    f = F.split(F.col("value"), "\t")
    ms, amount, pid, bad = _transfer_fields(f)
    return (lines.filter((F.size(f) >= 3) & ~bad)
            .withColumn("epoch_ms", ms).withColumn("second", F.floor(F.col("epoch_ms") / 1000).cast("long"))
            .withColumn("bytes", amount).withColumn("pid", pid).drop("value"))


def read_transfer_logs(spark: SparkSession, root: str) -> DataFrame:
    """All ``<root>/<run>/shuffle/workerLoad*`` files as (run, mode, name, line_no, value)."""
    lines = read_lines(spark, f"{root.rstrip('/')}/*/shuffle/workerLoad*")
    return lines.select(*path_parts(F.col("file")), "line_no", "value")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 for a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def transfer_lines_from_events(events: DataFrame) -> DataFrame:
    """Transfer log lines derived from ``events``.

    run = ``run<user_id % 4>``; file = ``workerLoad<event_id % 2>``; line =
    ``epoch_ms(ts) TAB 0 TAB floor(value * 1e6)`` plus ``TAB <user_id % 8>@host``
    except for every fifth event id; error events write a 2-field line.
    """
    ms = epoch_millis(F.col("ts")).cast("string")
    amount = F.floor(F.col("value") * 1000000).cast("string")
    three = F.concat_ws("\t", ms, F.lit("0"), amount)
    line = (F.when(F.col("event_type") == "error", F.concat_ws("\t", ms, F.lit("0")))
            .when(F.col("event_id") % 5 == 0, three)
            .otherwise(F.concat_ws("\t", three, F.concat((F.col("user_id") % 8).cast("string"), F.lit("@host")))))
    return events.select(
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run"),
        F.lit("shuffle").alias("mode"),
        F.concat(F.lit("workerLoad_"), (F.col("event_id") % 2).cast("string"), F.lit(".tsv")).alias("name"),
        F.col("event_id").alias("line_no"), line.alias("value"))


# --------------------------------------------------------------------------- Spark event logs (A10)
TASK_END_SCHEMA = T.StructType([
    T.StructField("Event", T.StringType()),
    T.StructField("Stage ID", T.LongType()),
    T.StructField("Stage Attempt ID", T.LongType()),
    T.StructField("Task Type", T.StringType()),
    T.StructField("Task Metrics", T.StructType([
        T.StructField("Executor Run Time", T.LongType()),
        T.StructField("Executor CPU Time", T.LongType()),
        T.StructField("JVM GC Time", T.LongType()),
        T.StructField("Memory Bytes Spilled", T.LongType()),
        T.StructField("Disk Bytes Spilled", T.LongType()),
        T.StructField("Shuffle Read Metrics", T.StructType([
            T.StructField("Remote Bytes Read", T.LongType()),
            T.StructField("Local Bytes Read", T.LongType()),
            T.StructField("Total Records Read", T.LongType())])),
        T.StructField("Shuffle Write Metrics", T.StructType([
            T.StructField("Shuffle Bytes Written", T.LongType()),
            T.StructField("Shuffle Records Written", T.LongType())])),
        T.StructField("Input Metrics", T.StructType([
            T.StructField("Bytes Read", T.LongType()),
            T.StructField("Records Read", T.LongType())])),
    ])),
])


def read_event_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Spark event-log JSON lines with the task-end fields typed (other events keep nulls) and the
    application, by the id in the file's or folder's name.

    Folders are searched recursively: Spark 4 writes rolling logs as
    ``eventlog_v2_<app>/events_<n>_<app>`` directories.
    """
    path = F.col("_metadata.file_path")
    app = F.regexp_extract(path, r"((?:app|local|application)[-_][0-9][0-9_-]*)", 1)
    return (spark.read.schema(TASK_END_SCHEMA).option("recursiveFileLookup", "true").json(paths)
            .withColumn("application", F.when(app != "", app).otherwise(F.element_at(F.split(path, "/"), -1))))


def parse_event_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Same as ``read_event_log`` for JSON text already in a column, with its application."""
    return lines.select("application", F.from_json(F.col(column), TASK_END_SCHEMA).alias("e")).select("application", "e.*")


def event_json_from_events(events: DataFrame) -> DataFrame:
    """Event-log JSON lines derived from ``events``: two applications, each with the same stage
    numbers; views become task starts, the rest task ends of stage ``user_id % 8``, attempt
    ``event_id % 2``, with run and CPU time, shuffle, spill and input metrics."""
    v = F.col("value")
    metrics = F.struct(
        F.floor(v * 1000).alias("Executor Run Time"),
        F.floor(v * 900000).alias("Executor CPU Time"),
        F.floor(v * 100).alias("JVM GC Time"),
        F.lit(0).alias("Memory Bytes Spilled"),
        F.col("user_id").alias("Disk Bytes Spilled"),
        F.struct(F.floor(v * 3000).alias("Remote Bytes Read"), F.floor(v * 4000).alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
        F.struct(F.floor(v * 1000000).alias("Shuffle Bytes Written"),
                 F.col("user_id").alias("Shuffle Records Written")).alias("Shuffle Write Metrics"),
        F.struct(F.floor(v * 2000000).alias("Bytes Read"),
                 F.col("user_id").alias("Records Read")).alias("Input Metrics"))
    end = F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), (F.col("user_id") % 8).alias("Stage ID"),
                   (F.col("event_id") % 2).alias("Stage Attempt ID"), F.lit("ShuffleMapTask").alias("Task Type"),
                   metrics.alias("Task Metrics"))
    start = F.struct(F.lit("SparkListenerTaskStart").alias("Event"), (F.col("user_id") % 8).alias("Stage ID"))
    return events.select(F.concat(F.lit("app-"), (F.col("user_id") % 3 % 2).cast("string")).alias("application"),
                         F.when(F.col("event_type") == "view", F.to_json(start)).otherwise(F.to_json(end)).alias("value"))


APP_STAGES, JOB_STAGES, NODE_STAGES = 64, 16, 8     # stages of an application, of a job, of a plan node


def _plan_text() -> str:
    """Plan tree of a derived application: a chain of nodes with a scan beside each, whose metrics are its stages' accumulators."""
    node = ""
    for k in range(APP_STAGES // NODE_STAGES):
        metrics = ",".join(f'{{"name":"rows","accumulatorId":{10 * s + 1},"metricType":"sum"}}' for s in range(NODE_STAGES * k, NODE_STAGES * (k + 1)))
        scan = f'{{"nodeName":"Scan {k}","simpleString":"","children":[],"metrics":[]}}'
        node = f'{{"nodeName":"Step {k}","simpleString":"step {k}","children":[{node + "," if node else ""}{scan}],"metrics":[{metrics}]}}'
    return node


def app_log_from_events(events: DataFrame) -> DataFrame:
    """Event-log lines (application, value) of whole applications derived from ``events``: every 64
    consecutive event ids are one application, each its stage ``event_id % 64`` of ``floor(value * 1000)`` ms
    with parents ``(s - 1) div 2`` and ``(s - 1) div 3``; a job starts with every 16th, the SQL execution with the first.
    The events are dealt out first: a line is many times their stored size, and few tasks would write all of them."""
    events = events.select("event_id", "ts", "value").repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = F.col("event_id") % APP_STAGES
    start = epoch_millis(F.col("ts"))
    parents = F.when(s == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(F.array(F.floor((s - 1) / 2), F.floor((s - 1) / 3))))
    info = F.struct(s.alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"), F.concat(F.lit("stage "), s.cast("string")).alias("Stage Name"),
                    parents.alias("Parent IDs"), start.alias("Submission Time"), (start + F.floor(F.col("value") * 1000)).alias("Completion Time"),
                    F.array(F.struct((s * 10 + 1).alias("ID"), F.lit("rows").alias("Name"))).alias("Accumulables"))
    stage = F.to_json(F.struct(F.lit("SparkListenerStageCompleted").alias("Event"), info.alias("Stage Info")))
    job = F.to_json(F.struct(F.lit("SparkListenerJobStart").alias("Event"), F.floor(s / JOB_STAGES).alias("Job ID"),
                             F.sequence(s, s + JOB_STAGES - 1).alias("Stage IDs")))
    plan = F.lit('{"Event":"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart","executionId":0,"sparkPlanInfo":' + _plan_text() + "}")
    lines = F.array(stage, F.when(s % JOB_STAGES == 0, job), F.when(s == 0, plan))
    app = F.concat(F.lit("app-"), F.floor(F.col("event_id") / APP_STAGES).cast("string"))
    return events.select(app.alias("application"), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value"))


def read_app_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole event-log files as (application, value), a line a row; the application is the id in the file's or folder's name."""
    path = F.col("_metadata.file_path")
    app = F.regexp_extract(path, r"((?:app|local|application)[-_][0-9][0-9_-]*)", 1)
    return (spark.read.option("recursiveFileLookup", "true").text(paths)
            .select(F.when(app != "", app).otherwise(F.element_at(F.split(path, "/"), -1)).alias("application"), "value"))
