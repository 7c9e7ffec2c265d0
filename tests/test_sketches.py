"""Quantile sketches per run: merged, they stay within the stated rank error of the exact quantiles."""

from pyspark.sql import functions as F

from shoal.plans import runs


def test_merged_sketches_are_within_their_bound(spark):
    files = spark.range(60000).select(F.concat(F.lit("run"), (F.col("id") % 23).cast("string")).alias("run"),
                                      F.when(F.col("id") % 3 == 0, "shuffle").otherwise("noshuffle").alias("mode"),
                                      (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + F.col("id") % 7).alias("latency_ms"))
    sketches = runs.latency_sketches(files)
    assert sketches.count() == 46
    sizes = [r.b for r in sketches.select(F.length("sketch").alias("b")).collect()]
    assert max(sizes) < 64 * 1024
    found = runs.rank_errors(files, runs.sketched_quantiles(sketches, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])).collect()
    assert len(found) == 14 and {r.n for r in found} == {20000, 40000}
    assert all(r.error <= runs.SKETCH_ERROR for r in found) and any(r.error < 0.002 for r in found)


def test_a_new_run_adds_its_sketch_alone(spark):
    old = spark.createDataFrame([(f"run{k % 2}", "shuffle", float(k)) for k in range(40)], "run string, mode string, latency_ms double")
    new = spark.createDataFrame([("run9", "shuffle", 1000.0 + k) for k in range(40)], "run string, mode string, latency_ms double")
    both = runs.latency_sketches(old).unionByName(runs.latency_sketches(new))
    got = {r.p: r.latency_ms for r in runs.sketched_quantiles(both, [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 0.0 and got[1.0] == 1039.0 and 38.0 <= got[0.5] <= 1000.0            # few values: exact
