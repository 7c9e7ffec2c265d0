"""Lasting buckets: reuse by the files' state, unequal numbers of buckets, pruning, dropping."""

import os
import time

from pyspark.sql import functions as F

from shoal.operators import joins


def test_buckets_are_written_once_and_dropped(spark, tmp_path):
    joins.drop_bucketed(spark)
    left, right = str(tmp_path / "l.parquet"), str(tmp_path / "r.parquet")
    spark.range(2000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("x")).write.parquet(left)
    spark.range(5000).select((F.col("id") % 2500).alias("b"), F.col("id").alias("y")).write.parquet(right)
    names = joins.bucketed_copy(spark, left, "a", 8), joins.bucketed_copy(spark, right, "b", 32)
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {names[0]}").filter("col_name = 'Location'").first().data_type.removeprefix("file:")
    written = {f: os.stat(os.path.join(place, f)).st_mtime_ns for f in os.listdir(place)}
    assert (joins.bucketed_copy(spark, left, "a", 8), joins.bucketed_copy(spark, right, "b", 32)) == names
    assert {f: os.stat(os.path.join(place, f)).st_mtime_ns for f in os.listdir(place)} == written
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.bucketed_join(spark, *names, "a", "b")
        assert joins.count_exchanges(joined) == 0 and "SortMergeJoin" in joins.physical_plan(joined, "simple")
        assert joined.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")        # so that the plan tells
    try:
        assert "SelectedBucketsCount: 1 out of 32" in joins.physical_plan(spark.table(names[1]).filter("b = 77"), "simple")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    time.sleep(0.02)
    spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("x")).write.mode("append").parquet(left)
    again = joins.bucketed_copy(spark, left, "a", 8)
    assert again != names[0] and spark.table(again).count() == 2010
    assert set(joins.drop_bucketed(spark)) == {*names, again}
    assert not os.path.exists(place) and not [t for t in spark.catalog.listTables() if t.name.startswith(joins.PREFIX)]
