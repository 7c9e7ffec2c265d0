"""Session construction and cluster-facing settings.

Library code never creates machine-local scratch space on a cluster: lineage is
cut into the folder the cluster names in ``spark.checkpoint.dir`` and tables go
to ``spark.sql.warehouse.dir``. Only local-mode sessions (tests, bench) get a
private folder when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours carries. AQE re-plans at runtime: it coalesces
# small shuffle partitions, splits skewed join partitions and turns a sort-merge
# join into a broadcast join only once the *measured* build side is below
# spark.sql.adaptive.autoBroadcastJoinThreshold, i.e. behind a size check.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "shoal", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the settings above.

    On a cluster, leave ``master`` None and size ``shuffle_partitions`` to about
    total input bytes / 128 MiB; AQE then coalesces what is left over.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("SHOAL_DRIVER_MEMORY", "16g"))
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, read from ``spark.checkpoint.dir``.

    A local session without the setting (tests, bench) gets a fresh private
    folder; a cluster session without it is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS)")
        configured = tempfile.mkdtemp(prefix="shoal-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local-only)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
