"""Hash trees: planted differences are found, and rows are read in the differing ranges only."""

import pytest
from pyspark.sql import functions as F

from shoal.operators import hashtree, refresh


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    one = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("b"))
    two = (one.filter("k <> 777").withColumn("a", F.expr("IF(k = 12345, 'x', a)")).withColumn("b", F.expr("IF(k = 3, 0.0, b)"))
           .unionByName(one.filter("k = 15000")).unionByName(spark.createDataFrame([(70000, "z", None)], one.schema)))
    return one, two, str(tmp_path_factory.mktemp("trees"))


def test_planted_rows_are_found(spark, copies):
    one, two, path = copies
    a, b = hashtree.build_tree(one, "k", f"{path}/a", 16, 8), hashtree.build_tree(two.repartition(5), "k", f"{path}/b", 16, 8)
    nodes, compared = hashtree.differing_leaves(a, b, 8)
    assert sorted(r.node for r in nodes.collect()) == sorted({777 // 16, 12345 // 16, 3 // 16, 15000 // 16, 70000 // 16})
    assert max(compared[1:]) <= 5 * 8 * 2                        # children of differing nodes only, of 1,250 leaves
    got = sorted(tuple(r) for r in hashtree.copy_diff(one, two, "k", nodes, 16).collect())
    assert got == [(3, "changed"), (777, "missing"), (12345, "changed"), (15000, "changed"), (70000, "extra")]


def test_equal_copies_stop_at_the_root(spark, copies):
    one, _, path = copies
    a, b = hashtree.build_tree(one, "k", f"{path}/c"), hashtree.build_tree(one.repartition(7), "k", f"{path}/d")
    nodes, compared = hashtree.differing_leaves(a, b)
    assert nodes.isEmpty() and compared == [1]


def test_empty_copy(spark, copies):
    one, _, path = copies
    few = one.filter("k < 40")
    a, b = hashtree.build_tree(few, "k", f"{path}/e", 4, 2), hashtree.build_tree(few.limit(0), "k", f"{path}/f", 4, 2)
    nodes, _ = hashtree.differing_leaves(a, b, 2)
    assert {tuple(r) for r in hashtree.copy_diff(few, few.limit(0), "k", nodes, 4).collect()} == {(k, "missing") for k in range(40)}


def test_only_differing_ranges_are_read(spark, copies):
    one, two, path = copies
    stored = []
    for df, name in ((one, "g"), (two, "h")):
        refresh.write_ranges(df, "k", 500, f"{path}/{name}")
        stored.append(spark.read.parquet(f"{path}/{name}"))
    trees = [hashtree.build_tree(df.drop("key_range"), "k", f"{path}/{n}-tree", 500) for df, n in zip(stored, "gh", strict=True)]
    nodes, _ = hashtree.differing_leaves(*trees)
    diff = hashtree.copy_diff(*stored, "k", nodes, 500, range_col="key_range")
    assert sorted(r.k for r in diff.collect()) == [3, 777, 12345, 15000, 70000]
    plan = diff._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [key_range" in x.replace("isnotnull(key_range", "key_range") for x in scans)
    read = {name: {r.f.split("key_range=")[1].split("/")[0] for r in df.filter(F.col("key_range").isin([r.node for r in nodes.collect()]))
                   .select(F.input_file_name().alias("f")).distinct().collect()} for df, name in zip(stored, "gh", strict=True)}
    assert read["g"] == {"0", "1", "24", "30"} and read["h"] == {"0", "1", "24", "30", "140"}


def test_many_scattered_leaves(spark):
    one = spark.range(hashtree.LISTED * 40).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    two = one.withColumn("v", F.expr("IF(k % 40 = 7, 2, v)"))
    nodes = one.filter("k % 40 = 7").select(F.expr("k div 4").alias("node"))
    assert nodes.count() == hashtree.LISTED
    got = hashtree.copy_diff(one, two, "k", nodes, 4)
    assert sorted(map(tuple, got.collect())) == [(k, "changed") for k in range(7, hashtree.LISTED * 40, 40)]


def test_spans_hold_all_nodes_and_split_at_the_widest_gaps():
    assert hashtree._spans([]) == [] and hashtree._spans([5]) == [(5, 5)]
    assert hashtree._spans([9, 1, 2, 3, 50], 3) == [(1, 3), (9, 9), (50, 50)]
    assert hashtree._spans([9, 1, 2, 3, 50], 2) == [(1, 9), (50, 50)]
    assert hashtree._spans([3, 1, 2], 3) == [(1, 3)]
