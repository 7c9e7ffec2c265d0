"""The key bitmap: the join's rows are those of the plain join, and fewer rows reach the shuffle."""

import pytest
from pyspark.sql import functions as F

from shoal.operators import joins, keyfilter


@pytest.mark.parametrize("bits", [1 << 20, 64, 4096])
def test_rows_equal_the_plain_join(spark, bits):
    few = spark.range(0, 30000, 97).select(F.col("id").alias("a"), (F.col("id") * 2).alias("x")).union(spark.createDataFrame([(None, 1), (97, 5)], "a long, x long"))
    many = spark.range(40000).select((F.col("id") % 20000).alias("b"), F.col("id").alias("y")).union(spark.createDataFrame([(None, 2)], "b long, y long"))
    want = sorted(map(tuple, joins.equi_join(few, many, "a", "b").collect()))
    got = sorted(map(tuple, keyfilter.filtered_join(few, many, "a", "b", "sort_merge", bits).collect()))
    assert got == want and len(want) > 300
    kept = keyfilter.probe(many, "b", keyfilter.key_bitmap(few, "a", bits), bits)
    partners = joins.equi_join(few, many, "a", "b").select("y").distinct().count()
    assert partners <= kept.count() <= 40000
    if bits == 1 << 20:
        assert kept.count() < 1.1 * partners


def test_bitmap_is_bounded_and_nothing_is_shuffled_by_the_probe(spark):
    keys = spark.range(100000)
    assert keyfilter.key_bitmap(keys, "id", 4096).count() == 64
    plan = joins.physical_plan(keyfilter.probe(keys, "id", keyfilter.key_bitmap(keys.filter("id % 50 = 0"), "id")), "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan        # the bitmap's own sum


def test_empty_sides(spark):
    none = spark.range(0).select(F.col("id").alias("a"))
    some = spark.range(5).select(F.col("id").alias("b"))
    assert keyfilter.filtered_join(none, some, "a", "b").count() == 0
    assert keyfilter.filtered_join(some.withColumnRenamed("b", "a"), none.withColumnRenamed("a", "b"), "a", "b").count() == 0
