"""Full-column TPC-H views over the driver tables.

The driver tables carry a subset of the TPC-H columns, with money as double and
dates as timestamps. These views cast money to DECIMAL(15,2), dates to DATE,
and derive the missing columns from the keys with fixed integer rules, so every
reference query runs unchanged. The same rules are written in DuckDB SQL in
``shoal.plans.oracle``; both are pure column expressions (no shuffle) except
``partsupp``, which reads the supplier count once as a scalar subquery.

What moves or picks whole rows can be given as ``through``: it gets the stored columns
(of ``partsupp`` the part key and slot), and the derived ones are made after it, so a
shuffle does not carry them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.keys import div, partsupp_bridge
from shoal.generate.vocab import CONTAINER_S1, CONTAINER_S2, INSTRUCTIONS, SHIP_MODES
from shoal.sources.schemas import MONEY
from shoal.sources.tables import load

# Refresh sets: one order in a thousand (the TPC-H refresh fraction) is deleted,
# and one in a thousand is inserted again under a key with sequence bits.
REFRESH_MODULUS = 1000


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer column (fixed list, codegen'd)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def phone(nationkey: Column, key: Column) -> Column:
    """Fixture phone ``cc-aaa-eee-nnnn`` with ``cc = 10 + nation`` and key-derived rest."""
    return F.format_string("%02d-%03d-%03d-%04d", (nationkey + 10).cast("int"),
                           (key % 900 + 100).cast("int"), ((key * 7) % 900 + 100).cast("int"),
                           ((key * 13) % 9000 + 1000).cast("int"))


Through = Callable[[DataFrame], DataFrame]


def _as_they_are(df: DataFrame) -> DataFrame:
    return df


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def region(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    r = through(load(spark, sf_dir, "region"))
    return r.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name",
                    F.concat(F.lit("region "), F.col("r_name")).alias("r_comment"))


def nation(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    n = through(load(spark, sf_dir, "nation"))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name",
                    F.col("n_regionkey").cast("long").alias("n_regionkey"),
                    F.concat(F.lit("nation "), F.col("n_name")).alias("n_comment"))


def supplier(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    s = through(load(spark, sf_dir, "supplier"))
    return s.select(
        "s_suppkey", "s_name",
        F.concat(F.lit("Address "), F.col("s_suppkey").cast("string")).alias("s_address"),
        F.col("s_nationkey").cast("long").alias("s_nationkey"),
        phone(F.col("s_nationkey"), F.col("s_suppkey")).alias("s_phone"),
        money("s_acctbal").alias("s_acctbal"),
        F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("s_comment"))


def customer(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    c = through(load(spark, sf_dir, "customer"))
    return c.select(
        "c_custkey", "c_name",
        F.concat(F.lit("Address "), F.col("c_custkey").cast("string")).alias("c_address"),
        F.col("c_nationkey").cast("long").alias("c_nationkey"),
        phone(F.col("c_nationkey"), F.col("c_custkey")).alias("c_phone"),
        money("c_acctbal").alias("c_acctbal"), "c_mktsegment",
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("c_comment"))


def part(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    p = through(load(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", "p_name",
        F.concat(F.lit("Manufacturer#"), (k % 5 + 1).cast("string")).alias("p_mfgr"),
        "p_brand", "p_type", "p_size",
        F.concat(pick(CONTAINER_S1, k % 5), F.lit(" "),
                 pick(CONTAINER_S2, div(k, 5) % 8)).alias("p_container"),
        money("p_retailprice").alias("p_retailprice"),
        F.concat(F.lit("part "), k.cast("string")).alias("p_comment"))


def partsupp(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    """Four suppliers per part with the TPC-H bridge formula (0-based keys).

    ``S`` (supplier count) is a scalar subquery: evaluated once, inlined as a
    literal, so the part scan stays a narrow, shuffle-free stage.
    """
    n_supp = load(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    p = F.col("p_partkey") + 1
    s = F.col("slot")
    rows = through(load(spark, sf_dir, "part").select("p_partkey")
                   .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))))
    supp = partsupp_bridge(p, s, n_supp) - 1
    return rows.select(
        F.col("p_partkey").alias("ps_partkey"),
        supp.cast("long").alias("ps_suppkey"),
        ((p * 7 + s * 13) % 9999 + 1).cast("int").alias("ps_availqty"),
        (((p * 31 + s * 17) % 99901 + 100) / 100).cast(MONEY).alias("ps_supplycost"),
        F.concat(F.lit("partsupp "), F.col("p_partkey").cast("string"), F.lit(" "),
                 s.cast("string")).alias("ps_comment"))


def orders(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    o = through(load(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority",
        F.concat(F.lit("Clerk#"), F.lpad((k % 1000 + 1).cast("string"), 9, "0")).alias("o_clerk"),
        F.lit(0).alias("o_shippriority"),
        F.when(k % 7 == 0, F.lit("the special packages requests"))
         .otherwise(F.lit("furious deposits")).alias("o_comment"))


def lineitem(spark: SparkSession, sf_dir: str, through: Through = _as_they_are) -> DataFrame:
    li = through(load(spark, sf_dir, "lineitem"))
    h = F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7
    ship = F.col("l_shipdate").cast("date")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        money("l_quantity").alias("l_quantity"), money("l_extendedprice").alias("l_extendedprice"),
        money("l_discount").alias("l_discount"), money("l_tax").alias("l_tax"),
        "l_returnflag", "l_linestatus", ship.alias("l_shipdate"),
        F.date_add(ship, (h % 61 - 30).cast("int")).alias("l_commitdate"),
        F.date_add(ship, ((h * 13) % 30 + 1).cast("int")).alias("l_receiptdate"),
        pick(INSTRUCTIONS, h % 4).alias("l_shipinstruct"),
        pick(SHIP_MODES, h % 7).alias("l_shipmode"),
        F.concat(F.lit("line "), h.cast("string")).alias("l_comment"))


BUILDERS = {"region": region, "nation": nation, "supplier": supplier, "customer": customer,
            "part": part, "partsupp": partsupp, "orders": orders, "lineitem": lineitem}


def table(spark: SparkSession, sf_dir: str, name: str, through: Through = _as_they_are) -> DataFrame:
    """One full view (a lazy plan)."""
    return BUILDERS[name](spark, sf_dir, through)


class Tables(dict):
    """The eight full views, each built on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise KeyError(name)
        df = table(self._spark, self._dir, name)
        self[name] = df
        return df

    def materialize(self) -> "Tables":
        for name in BUILDERS:
            self[name]
        return self


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy mapping name -> full view; only the tables a query touches are read."""
    return Tables(spark, sf_dir)


def register(spark: SparkSession, sf_dir: str, suffix: str = "") -> dict[str, DataFrame]:
    """Register all eight full views as temp views ``<table><suffix>``."""
    out = tables(spark, sf_dir).materialize()
    for name, df in out.items():
        df.createOrReplaceTempView(name + suffix)
    return out
