"""Tables stored by month: a dimension's days prune them at run time."""

from pyspark.sql import functions as F

from shoal.generate import tables as G
from shoal.operators import joins, months


def test_days_of_a_dimension_prune_the_months(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3000).select("id", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("day"))
    months.write_by_month(rows, "day", path)
    stored = spark.read.parquet(path)
    assert stored.select(months.MONTH).distinct().count() == 30 and stored.count() == 3000
    days = G.date_dimension(spark).select(F.to_date("t_alpha").alias("d")).filter((F.col("d") >= "1995-11-20") & (F.col("d") < "1996-02-03"))
    got = months.of_days(stored, days)
    assert got.columns == ["id", "day"]
    want = sorted(r.id for r in rows.filter((F.col("day") >= "1995-11-01") & (F.col("day") < "1996-03-01")).collect())
    assert sorted(r.id for r in got.collect()) == want
    assert "dynamicpruningexpression" in joins.physical_plan(got, "simple")
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in scan
    read = {r.f.split(f"{months.MONTH}=")[1].split("/")[0] for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {"199511", "199512", "199601", "199602"}


def test_no_day_reads_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    months.write_by_month(spark.range(10).select("id", F.lit("1995-01-01").cast("date").alias("day")), "day", path)
    assert months.of_days(spark.read.parquet(path), G.date_dimension(spark).select(F.to_date("t_alpha").alias("d")).filter("d > '2100-01-01'")).count() == 0
