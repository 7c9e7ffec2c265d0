"""Join strategies for the orders x lineitem equi-join and friends.

The reference measures one join (``select * from orders, lineitem where
l_orderkey = o_orderkey``) planned as a shuffle sort-merge join, and compares it
with a mode that moves less data. Here each mode is a plan choice on the same
logical join, and all return the same rows:

* ``sort_merge``   hash-partition both sides on the key, sort, merge (the recorded plan);
* ``shuffle_hash`` hash-partition both sides, build a hash table per partition
                   from the smaller side (no sort);
* ``broadcast``    ship a side to every task, no shuffle of the other -- where its
                   measured bytes are below the session's broadcast thresholds,
                   which Catalyst and AQE check; beyond them a sort-merge join;
* ``bucketed``     both sides written once by an explicit call, bucketed and sorted
                   by the key under names the caller chooses; every later join
                   reads co-partitioned buckets and plans no Exchange at all.
"""

from __future__ import annotations

import hashlib
import io
import re
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession

STRATEGIES = ("auto", "sort_merge", "shuffle_hash", "broadcast", "bucketed")


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              strategy: str = "auto", how: str = "inner") -> DataFrame:
    """``left JOIN right ON left_key = right_key`` under a chosen physical strategy.

    ``auto`` and ``broadcast`` carry no hint: a side is broadcast only when its
    size in bytes, estimated or measured at run time, is below
    ``spark.sql.autoBroadcastJoinThreshold`` /
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}; pick one of {STRATEGIES}")
    if strategy == "bucketed":
        raise ValueError("bucketed joins need tables: use write_bucketed() and bucketed_join()")
    cond = left[left_key] == right[right_key]
    hint = {"sort_merge": "merge", "shuffle_hash": "shuffle_hash"}.get(strategy)
    return (left.hint(hint) if hint else left).join(right, cond, how)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, location: str | None = None) -> str:
    """Write ``df`` as table ``name``, bucketed and sorted by ``key``.

    Pay one shuffle here; every later join on ``key`` against a table with the
    same bucket count reads matching buckets and skips the Exchange. The caller
    names the table and decides when to write it again: nothing is reused by
    guess. ``location`` defaults to a folder of that name below the shared
    checkpoint folder, which on a cluster must be set.
    """
    from shoal.session import checkpoint_dir
    location = location or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/bucketed/{name}"
    df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key).option("path", location).saveAsTable(name))
    return name


def stored_state(spark: SparkSession, path: str) -> str:
    """What the files of a stored table are now: a digest of their names, lengths and times."""
    files = sorted(spark.read.parquet(path).inputFiles())
    hadoop = spark._jsc.hadoopConfiguration()
    found = hashlib.md5(usedforsecurity=False)
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(hadoop).getFileStatus(p)
        found.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    return found.hexdigest()


PREFIX = "shoal_bk_"


def bucketed_copy(spark: SparkSession, path: str, key: str, buckets: int) -> str:
    """Name of the bucketed copy of the table stored at ``path``, written if there is none of its present files.

    The name follows from the files' state, the key and the number of buckets, so a
    copy of older files is never taken for a new one. Copies stay until ``drop_bucketed``.
    """
    name = PREFIX + hashlib.md5(f"{stored_state(spark, path)} {key} {buckets}".encode(), usedforsecurity=False).hexdigest()
    if not spark.catalog.tableExists(name):
        write_bucketed(spark.read.parquet(path), name, key, buckets)
    return name


def drop_bucketed(spark: SparkSession) -> list[str]:
    """Drop all copies of ``bucketed_copy`` with their files; their names."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(PREFIX))
    for name in names:
        place = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").filter("col_name = 'Location'").first().data_type
        spark.sql(f"DROP TABLE `{name}`")
        folder = spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return names


def bucketed_join(spark: SparkSession, left_table: str, right_table: str, left_key: str, right_key: str,
                  how: str = "inner") -> DataFrame:
    """Co-located sort-merge join of two tables that ``write_bucketed`` wrote (no Exchange).

    With ``spark.sql.bucketing.coalesceBucketsInJoin.enabled`` the numbers of buckets may differ
    by a factor of up to four: a task then reads several buckets of the finer table.
    """
    lt, rt = spark.table(left_table), spark.table(right_table)
    return lt.join(rt, lt[left_key] == rt[right_key], how)


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_exchanges(df: DataFrame) -> int:
    """Number of hash-partitioning shuffles in the plan (for tests and reports)."""
    return len(re.findall(r"Exchange hashpartitioning", physical_plan(df, "simple")))
