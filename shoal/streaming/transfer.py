"""Transfer logs as a stream (D8, incremental).

New ``workerLoad*`` files landing under ``<root>/<run>/shuffle/`` are parsed as
they arrive and summed per (run, process, second). Files of different runs cover
the same seconds and arrive in any order, so no second is ever closed: there is
no watermark, the query runs in update mode, and its state is one sum per (run,
process, second) -- the size of the result. The result equals the batch
``plans.runs.transfer_per_second`` on the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.session import checkpoint_dir
from shoal.sources.runlogs import parse_transfer


def transfer_stream(spark: SparkSession, root: str, layout: str = "runs", files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (run, pid, second, bytes) over transfer-log files.

    ``layout="runs"`` reads ``<root>/<run>/shuffle/workerLoad*``;
    ``layout="partitioned"`` reads ``<root>/run=<run>/*`` (a partitioned text write).
    ``files_per_trigger`` sizes micro-batches; it does not change the result.
    """
    path = F.col("_metadata.file_path")
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if layout == "runs":
        lines = reader.option("pathGlobFilter", "workerLoad*").load(f"{root.rstrip('/')}/*/shuffle/")
        run = F.element_at(F.split(path, "/"), -3)
    else:
        lines = reader.load(f"{root.rstrip('/')}/run=*/")
        run = F.regexp_extract(path, r"run=([^/]+)/", 1)
    parsed = parse_transfer(lines.select(run.alias("run"), "value"))
    return parsed.groupBy("run", "pid", "second").agg(F.sum("bytes").alias("bytes"))


def start(spark: SparkSession, root: str, out_path: str, name: str, layout: str = "runs",
          files_per_trigger: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Run the stream: each micro-batch appends the rows it changed, with its batch id, to ``out_path``.

    A retried batch rewrites the same rows under the same id. Progress and state
    are kept in the shared ``spark.checkpoint.dir``, so a restarted query of the
    same name resumes where it stopped.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)

    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    writer = (transfer_stream(spark, root, layout, files_per_trigger).writeStream.outputMode("update")
              .foreachBatch(sink).option("checkpointLocation", ckpt).queryName(name))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """(run, pid, second, bytes): the value of each key's last batch."""
    return (spark.read.parquet(out_path).groupBy("run", "pid", "second")
            .agg(F.max_by("bytes", "batch_id").alias("bytes")))


def replay(spark: SparkSession, root: str, out_path: str, name: str, layout: str = "runs",
           files_per_trigger: int | None = None) -> DataFrame:
    """The stream over the files present, to their end."""
    start(spark, root, out_path, name, layout, files_per_trigger, available_now=True).awaitTermination()
    return latest(spark, out_path)
