"""Refresh sets: insert new orders with their lines, delete old ones.

One set after the other (``apply_refresh_sets``), a run of sets compacted to their net
change and applied once (``net_change``, ``apply_net``), or a set applied to a stored
table of which only the touched key ranges are rewritten (``write_ranges``,
``refresh_ranges``).

Applying a set is a union (inserts) and a left anti join on the order key
(deletes) -- both touch every base row once, neither sorts. The delete keys are
0.1 % of orders; they are counted first and sent to every task when they are at most
``BROADCAST_KEYS``, so the base is not shuffled. Catalyst decides otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.keys import div, sparse_key
from shoal.session import cut_lineage
from shoal.sources.fixtures import REFRESH_MODULUS


BROADCAST_KEYS = 1 << 20        # 8 MiB of keys


def delete_keys(orders: DataFrame, modulus: int = REFRESH_MODULUS, residue: int = 0) -> DataFrame:
    """Order keys of the delete set: one order in ``modulus``."""
    return orders.filter(F.col("o_orderkey") % modulus == residue).select("o_orderkey")


def sparse_form(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its dense order key as a sparse key: base rows carry sequence bits 0,
    so a key with other bits is never one of theirs, whatever their number."""
    return df.withColumn(key, sparse_key(F.col(key)))


def insert_orders(orders: DataFrame, modulus: int = REFRESH_MODULUS, residue: int = 1, seq: int = 1) -> DataFrame:
    """New orders for a base in ``sparse_form``: copies of one dense order in ``modulus`` with sequence bits ``seq``."""
    return (orders.filter(F.col("o_orderkey") % modulus == residue)
            .withColumn("o_orderkey", sparse_key(F.col("o_orderkey"), seq)))


def insert_lineitem(lineitem: DataFrame, modulus: int = REFRESH_MODULUS, residue: int = 1, seq: int = 1) -> DataFrame:
    """Lines of the new orders, keyed like ``insert_orders``."""
    return (lineitem.filter(F.col("l_orderkey") % modulus == residue)
            .withColumn("l_orderkey", sparse_key(F.col("l_orderkey"), seq)))


def apply_inserts(base: DataFrame, inserts: DataFrame) -> DataFrame:
    """``base UNION ALL inserts`` by column name."""
    return base.unionByName(inserts.select(*base.columns))


def apply_deletes(base: DataFrame, keys: DataFrame, base_key: str,
                  key_col: str = "o_orderkey") -> DataFrame:
    """Rows of ``base`` whose key is not in ``keys``."""
    k = keys.select(F.col(key_col).alias("_del_key"))
    if k.count() <= BROADCAST_KEYS:
        k = F.broadcast(k)
    return base.join(k, F.col(base_key) == F.col("_del_key"), "left_anti")


def apply_refresh_sets(orders: DataFrame, lineitem: DataFrame, sets: list[tuple[DataFrame, DataFrame, DataFrame]],
                       checkpoint_every: int = 4) -> tuple[DataFrame, DataFrame]:
    """Apply a sequence of (insert_orders, insert_lines, delete_keys) sets in order.

    Each set adds a union and an anti join to the plan; every
    ``checkpoint_every`` sets the two tables are checkpointed into the shared
    checkpoint folder so the lineage (and a recompute after a lost executor)
    stays short.
    """
    for n, (ins_o, ins_l, dels) in enumerate(sets, start=1):
        orders = apply_deletes(apply_inserts(orders, ins_o), dels, "o_orderkey")
        lineitem = apply_deletes(apply_inserts(lineitem, ins_l), dels, "l_orderkey")
        if checkpoint_every and n % checkpoint_every == 0:
            orders, lineitem = cut_lineage(orders), cut_lineage(lineitem)
    return orders, lineitem


# -- a run of sets, compacted ----------------------------------------------------------

SET = "refresh_set"


def net_change(inserts: DataFrame, deletes: DataFrame, key: str, delete_key: str = "o_orderkey", set_col: str = SET) -> tuple[DataFrame, DataFrame]:
    """Net effect of ordered sets, each of which inserts before it deletes: (rows to insert, keys to delete first).

    A key's last deletion decides: one aggregate over all delete keys, combined
    map-side, then one join that keeps the inserts of later sets. The plan does not
    depend on the number of sets. Of a join only the keys, once each, are held in memory,
    so the rows are not sorted.
    """
    last = deletes.groupBy(F.col(delete_key).alias("_net_key")).agg(F.max(set_col).alias("_net_set"))
    rows = inserts.join(last.hint("shuffle_hash"), F.col(key) == F.col("_net_key"), "left").filter(F.col("_net_set").isNull() | (F.col(set_col) > F.col("_net_set")))
    return rows.drop("_net_key", "_net_set", set_col), last.select(F.col("_net_key").alias(delete_key))


def apply_net(base: DataFrame, net_inserts: DataFrame, net_deletes: DataFrame, key: str, delete_key: str = "o_orderkey") -> DataFrame:
    """``base`` after a run of sets: one anti join, one union."""
    gone = net_deletes.select(F.col(delete_key).alias("_del_key")).hint("shuffle_hash")
    return apply_inserts(base.join(gone, F.col(key) == F.col("_del_key"), "left_anti"), net_inserts)


def run_of_sets(df: DataFrame, key: str, sets: int, back: int = 7, again: int = 20) -> tuple[DataFrame, DataFrame]:
    """(inserts, delete keys) of ``sets`` ordered sets made from the rows of ``df``, with keys that come back.

    Set s deletes the keys with remainder s by 64; ``back`` sets later they return; every
    third of them goes again ``again`` sets after its first deletion and returns once more
    ``back + 3`` sets after that.
    """
    r, third = F.col(key) % 64, F.col(key) % 3 == 0

    def in_sets(rows: DataFrame, first: int, second: int) -> DataFrame:
        both = F.array(F.when((r >= 1) & (r + first <= sets), r + first), F.when(third & (r >= 1) & (r + second <= sets), r + second))
        return rows.withColumn(SET, F.explode(both)).filter(F.col(SET).isNotNull())

    deletes = in_sets(df.select(key), 0, again).withColumnRenamed(key, "o_orderkey")
    return in_sets(df, back, again + back + 3), deletes


# -- a stored table, rewritten by key range ----------------------------------------------

RANGE = "key_range"


def write_ranges(df: DataFrame, key: str, width: int, path: str) -> None:
    """Store ``df`` partitioned by ranges of ``width`` keys."""
    df.withColumn(RANGE, div(F.col(key), width)).repartition(RANGE).write.partitionBy(RANGE).parquet(path)


def refresh_ranges(spark: SparkSession, path: str, key: str, width: int, inserts: DataFrame, deletes: DataFrame, delete_key: str = "o_orderkey") -> list[int]:
    """Apply a set to a table of ``write_ranges``; the ranges that were rewritten.

    Only partitions that hold an inserted or deleted key are read and written, by
    dynamic partition overwrite: Spark moves a partition's new files into place when the
    whole job has succeeded. A partition that loses its last row is not written by such a
    job, so its folder is removed after it. What reaches the driver is range numbers, of
    which Spark lists one per partition anyway.
    """
    spans = inserts.select(div(F.col(key), width).alias(RANGE)).unionByName(deletes.select(div(F.col(delete_key), width).alias(RANGE)))
    touched = sorted(r[0] for r in spans.distinct().collect())
    if not touched:
        return []
    table = spark.read.parquet(path)
    old = table.filter(F.col(RANGE).isin(touched)).drop(RANGE)
    new = apply_deletes(apply_inserts(old, inserts), deletes, key, delete_key).withColumn(RANGE, div(F.col(key), width))
    before = {r[0] for r in table.filter(F.col(RANGE).isin(touched)).select(RANGE).distinct().collect()}
    left = {r[0] for r in new.select(RANGE).distinct().collect()}
    (new.repartition(RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path))
    for r in sorted(before - left):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RANGE}={r}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
