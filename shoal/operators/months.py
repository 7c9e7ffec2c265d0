"""A table stored by month, and reads that dates from another table prune.

A date range given as a literal prunes partitions when the query is planned. Where the
range comes from rows of a date dimension, Spark prunes when the query runs: the
filtered dimension is broadcast for the join (one row per month of a calendar) and the
scan reads the partitions that it names (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "month_key"


def month_of(day) -> Column:
    """A date's month as the number yyyymm."""
    return F.year(day) * 100 + F.month(day)


def write_by_month(df: DataFrame, day: str, path: str) -> None:
    """Store ``df`` partitioned by the month of ``day``; Spark splits a large month over tasks and files."""
    df.withColumn(MONTH, month_of(day)).hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(path)


def of_days(stored: DataFrame, days: DataFrame, day: str = "d") -> DataFrame:
    """Rows of the months in which ``days`` lie; only those months are read."""
    months = days.select(month_of(day).alias(MONTH)).distinct()
    return stored.join(F.broadcast(months), MONTH, "left_semi").drop(MONTH)
