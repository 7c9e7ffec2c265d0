"""TPC-H tables generated as Spark jobs.

One row per key of ``spark.range``; every value is a number of the row's own part
of a random stream, reached from its 64-bit key by repeated squaring (``draws``), so
a table is the same for any partition count or task retry. An order's total and status fold over its own line draws in the same row (no
shuffle); ``lineitem`` explodes the line numbers and recomputes the same draws
as plain column expressions. Output chunks are a function of the key.

Keys can also come from an existing table (``key_source``): the registered
``gen_*`` queries regenerate rows for the keys of the given tables, so their
work grows with the input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import keys as K
from shoal.functions import text as X
from shoal.functions import draws
from shoal.functions.dates import CURRENT_DATE, ORDER_DATE_MAX, START_DATE
from shoal.functions.money import cents_to_decimal, charged_cents
from shoal.generate import vocab
from shoal.sources.schemas import MONEY, SCHEMAS

# Base row counts at scale factor 1.
BASE = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000}
ORDERS_PER_REFRESH = 1500   # per scale factor unit: 0.1 % of orders
MOST_LINES = 7              # lines of an order
UPDATES_PER_SEQUENCE = 1000  # sparse-key sequence bits advance every 1,000 refresh sets

# Draw streams: one per generated column so columns are independent.
S = {name: i for i, name in enumerate(
    "r_comment n_comment s_address s_nation s_phone s_acctbal s_comment s_bbb c_address c_nation "
    "c_phone c_acctbal c_segment c_comment p_name p_mfgr p_brand p_type p_size p_container "
    "p_comment ps_qty ps_cost ps_comment o_cust o_date o_prio o_clerk o_comment o_lines l_qty "
    "l_disc l_tax l_instr l_mode l_comment l_part l_supp l_ship l_commit l_receipt l_rflag".split(), 1)}


def scaled(sf: float, table: str) -> int:
    """Row count of a table at ``sf``: below 1 the base shrinks in steps of 0.001 (at
    least one row), above 1 the scale factor is truncated to an integer (I13)."""
    base = BASE[table]
    if sf < 1:
        return max(int(base * (int(sf * 1000) / 1000)), 1)
    return base * int(sf)


def _keys(spark: SparkSession, n: int, partitions: int | None) -> DataFrame:
    return spark.range(1, n + 1, numPartitions=partitions or spark.sparkContext.defaultParallelism)


def _size(sf: float, sizes: dict[str, int] | None, table: str) -> int:
    """Rows of a parent table: the given count where rows are made for given tables, else by scale factor."""
    return (sizes or {}).get(table) or scaled(sf, table)


def _spread(keys: DataFrame, partitions: int | None) -> DataFrame:
    """Given keys, dealt to ``partitions`` tasks if that is asked for (one key column moves)."""
    return keys.repartition(partitions) if partitions else keys


#: the state of a row's part of the stream, and of a line's part of its order's
ROW = ("_r1", "_r2")


def _state(names: tuple[str, str] = ROW) -> draws.State:
    return tuple(F.col(n) for n in names)


def _rows(keys: DataFrame, name: str, *salt: int) -> DataFrame:
    """The first column of ``keys`` as ``name``, with the state of each row: computed once, drawn from by every column."""
    keys = keys.select(F.col(keys.columns[0]).alias(name))
    return keys.withColumns(dict(zip(ROW, draws.jump(F.col(name), *salt), strict=True)))


def _with_text(df: DataFrame, column: str, pool: X.Pool | None = None) -> DataFrame:
    lo, hi = vocab.bounds(column)
    return X.add_comment(df, column, _state(), S[column], lo, hi, pool)


def _conform(df: DataFrame, table: str) -> DataFrame:
    schema = SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# --------------------------------------------------------------------------- I1, I2
def region(spark: SparkSession) -> DataFrame:
    rows = [(i, name) for i, name in enumerate(vocab.REGIONS)]
    df = spark.createDataFrame(rows, "r_regionkey long, r_name string").withColumns(dict(zip(ROW, draws.jump(F.col("r_regionkey")), strict=True)))
    return _conform(_with_text(df, "r_comment"), "region")


def nation(spark: SparkSession) -> DataFrame:
    """Region key = running sum of the listed deltas."""
    rows = [(i, name, delta) for i, (name, delta) in enumerate(vocab.NATIONS)]
    df = spark.createDataFrame(rows, "n_nationkey long, n_name string, delta long")
    w = Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)  # 25 rows
    df = df.withColumn("n_regionkey", F.sum("delta").over(w)).withColumns(dict(zip(ROW, draws.jump(F.col("n_nationkey")), strict=True)))
    return _conform(_with_text(df, "n_comment"), "nation")


# --------------------------------------------------------------------------- I3, I4
def supplier(spark: SparkSession, sf: float, partitions: int | None = None,
             key_source: DataFrame | None = None, pool: X.Pool | None = None) -> DataFrame:
    k, row = F.col("s_suppkey"), _state()
    keys = _spread(key_source, partitions) if key_source is not None else _keys(spark, scaled(sf, "supplier"), partitions)
    lo, hi = vocab.bounds("s_address")
    base = _rows(keys, "s_suppkey").select(
        "s_suppkey", *ROW,
        X.tagged("Supplier#", k).alias("s_name"),
        X.random_string(lo, hi, S["s_address"], row).alias("s_address"),
        X._int(0, len(vocab.NATIONS) - 1, S["s_nation"], row).alias("s_nationkey"),
        cents_to_decimal(X._int(-99999, 999999, S["s_acctbal"], row)).alias("s_acctbal"))
    base = _with_text(base, "s_comment", pool)
    base = base.withColumn("s_phone", X.phone(F.col("s_nationkey"), S["s_phone"], row))
    # about 10 in 10,000 suppliers carry "Customer ... Complaints|Recommends"
    bad = X._int(1, 10000, S["s_bbb"], row, 1) <= vocab.BBB_PER_10000
    kind = F.when(X._int(0, 100, S["s_bbb"], row, 2) < vocab.BBB_COMPLAIN_PCT, F.lit(vocab.BBB_COMPLAIN)) \
            .otherwise(F.lit(vocab.BBB_COMMEND))
    clen = F.length("s_comment")
    span = len(vocab.BBB_BASE) + len(vocab.BBB_COMPLAIN)
    noise = X._h(S["s_bbb"], row, 3) % (F.greatest(clen - span, F.lit(0)) + 1)
    offset = X._h(S["s_bbb"], row, 4) % (F.greatest(clen - span - noise, F.lit(0)) + 1)
    marked = F.overlay(F.overlay(F.col("s_comment"), F.lit(vocab.BBB_BASE), (offset + 1).cast("int")),
                       kind, (offset + len(vocab.BBB_BASE) + noise + 1).cast("int"))
    base = base.withColumn("s_comment", F.when(bad & (clen >= span), marked).otherwise(F.col("s_comment")))
    return _conform(base, "supplier")


def customer(spark: SparkSession, sf: float, partitions: int | None = None,
             key_source: DataFrame | None = None, pool: X.Pool | None = None) -> DataFrame:
    k, row = F.col("c_custkey"), _state()
    keys = _spread(key_source, partitions) if key_source is not None else _keys(spark, scaled(sf, "customer"), partitions)
    lo, hi = vocab.bounds("c_address")
    df = _rows(keys, "c_custkey").select(
        "c_custkey", *ROW,
        X.tagged("Customer#", k).alias("c_name"),
        X.random_string(lo, hi, S["c_address"], row).alias("c_address"),
        X._int(0, len(vocab.NATIONS) - 1, S["c_nation"], row).alias("c_nationkey"),
        cents_to_decimal(X._int(-99999, 999999, S["c_acctbal"], row)).alias("c_acctbal"),
        X.pick(vocab.SEGMENTS, S["c_segment"], row).alias("c_mktsegment"))
    df = _with_text(df, "c_comment", pool)
    df = df.withColumn("c_phone", X.phone(F.col("c_nationkey"), S["c_phone"], row))
    return _conform(df, "customer")


# --------------------------------------------------------------------------- I5, I6
def part(spark: SparkSession, sf: float, partitions: int | None = None,
         key_source: DataFrame | None = None, pool: X.Pool | None = None) -> DataFrame:
    k, row = F.col("p_partkey"), _state()
    keys = _spread(key_source, partitions) if key_source is not None else _keys(spark, scaled(sf, "part"), partitions)
    m = X._int(1, 5, S["p_mfgr"], row)
    df = _rows(keys, "p_partkey").select(
        "p_partkey", *ROW,
        X.distinct_picks(vocab.COLORS, 5, S["p_name"], row).alias("p_name"),
        F.concat(F.lit("Manufacturer#"), m.cast("string")).alias("p_mfgr"),
        F.concat(F.lit("Brand#"), m.cast("string"), X._int(1, 5, S["p_brand"], row).cast("string")).alias("p_brand"),
        X.pick(vocab.PART_TYPES, S["p_type"], row).alias("p_type"),
        X._int(1, 50, S["p_size"], row).alias("p_size"),
        X.pick(vocab.CONTAINERS, S["p_container"], row).alias("p_container"),
        K.retail_price(k).alias("p_retailprice"))
    return _conform(_with_text(df, "p_comment", pool), "part")


def partsupp(spark: SparkSession, sf: float, partitions: int | None = None,
             key_source: DataFrame | None = None, sizes: dict[str, int] | None = None, pool: X.Pool | None = None) -> DataFrame:
    """Four rows per part, suppliers through the bridge formula."""
    n_supp = _size(sf, sizes, "supplier")
    keys = _spread(key_source, partitions) if key_source is not None else _keys(spark, scaled(sf, "part"), partitions)
    rows = keys.select(F.col(keys.columns[0]).alias("ps_partkey"),
                       F.explode(F.sequence(F.lit(0), F.lit(K.SUPP_PER_PART - 1))).alias("slot"))
    p, s, row = F.col("ps_partkey"), F.col("slot"), _state()
    rows = rows.withColumns(dict(zip(ROW, draws.jump(p * K.SUPP_PER_PART + s), strict=True)))
    df = rows.select(
        "ps_partkey", *ROW,
        K.partsupp_bridge(p, s, n_supp).alias("ps_suppkey"),
        X._int(1, 9999, S["ps_qty"], row).alias("ps_availqty"),
        cents_to_decimal(X._int(100, 100000, S["ps_cost"], row)).alias("ps_supplycost"))
    return _conform(_with_text(df, "ps_comment", pool), "partsupp")


# --------------------------------------------------------------------------- I7, I8, I9
def _order_rows(keys: DataFrame, sf: float, upd: int = 0, sizes: dict[str, int] | None = None) -> DataFrame:
    """Order headers before totals: one row per order index, with its line count."""
    n_cust = _size(sf, sizes, "customer")
    i, row = F.col("o_index"), _state()
    seq = 0 if upd == 0 else 1 + upd // UPDATES_PER_SEQUENCE
    odate_day = X._int(0, (ORDER_DATE_MAX - START_DATE).days, S["o_date"], row)
    odate = F.date_add(F.lit(START_DATE), odate_day.cast("int"))
    clerks = max(_size(sf, sizes, "orders") // ORDERS_PER_REFRESH, 1000)
    # refresh sets draw from their own streams
    return _rows(keys, "o_index", *([upd] if upd else [])).select(
        "o_index", *ROW,
        K.sparse_key(i, seq).alias("o_orderkey"),
        K.active_customer(X._int(1, n_cust, S["o_cust"], row), n_cust).alias("o_custkey"),
        odate.alias("o_orderdate"),
        X.pick(vocab.PRIORITIES, S["o_prio"], row).alias("o_orderpriority"),
        X.tagged("Clerk#", X._int(1, clerks, S["o_clerk"], row)).alias("o_clerk"),
        F.lit(0).alias("o_shippriority"),
        X._int(1, MOST_LINES, S["o_lines"], row).alias("n_lines"))


class _Line:
    """Draws of a line of an order. The same expressions serve the header (inside
    ``aggregate`` over the lines' states) and the exploded lineitem rows (plain,
    code-generated columns), so both see the same values."""

    def __init__(self, sf: float, row: draws.State, sizes: dict[str, int] | None = None):
        self.n_part, self.n_supp = _size(sf, sizes, "part"), _size(sf, sizes, "supplier")
        self.row = row

    def int(self, lo: int, hi: int, stream: str) -> Column:
        return X._int(lo, hi, S[stream], self.row)

    @property
    def partkey(self) -> Column:
        return self.int(1, self.n_part, "l_part")

    def eprice_cents(self) -> Column:
        return K.retail_price_cents(self.partkey) * self.int(1, 50, "l_qty")

    def ship(self) -> Column:
        return F.date_add(F.col("o_orderdate"), self.int(1, 121, "l_ship").cast("int"))


def _orders_from_rows(rows: DataFrame, sf: float, sizes: dict[str, int] | None = None, pool: X.Pool | None = None) -> DataFrame:
    """Order header from its own lines (D16, H21): truncating cents, F/O/P status.

    A per-row fold over the line numbers (no shuffle): only the draws the total
    and the status need are evaluated.
    """
    def step(acc, n):
        ln = _Line(sf, (n["a"], n["b"]), sizes)
        charged = charged_cents(ln.eprice_cents(), ln.int(0, 10, "l_disc"), ln.int(0, 8, "l_tax"))
        shipped = (ln.ship() <= F.lit(CURRENT_DATE)).cast("int")
        return F.struct((acc["total"] + charged).alias("total"), (acc["f"] + shipped).alias("f"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("f"))
    lines = F.transform(F.sequence(F.lit(1), F.col("n_lines").cast("int")),
                        lambda n: F.struct(*(c.alias(x) for c, x in zip(draws.advance(_state(), n, MOST_LINES), "ab", strict=True))))
    fold = F.aggregate(lines, zero, step)
    status = (F.when(fold["f"] == F.col("n_lines"), "F").when(fold["f"] > 0, "P").otherwise("O"))
    df = rows.withColumn("o_totalprice", cents_to_decimal(fold["total"])).withColumn("o_orderstatus", status)
    return _conform(_with_text(df, "o_comment", pool), "orders")


def _lines_from_rows(rows: DataFrame, sf: float, sizes: dict[str, int] | None = None, pool: X.Pool | None = None) -> DataFrame:
    """``explode`` the line numbers, then every line column as a plain expression."""
    li = rows.select("o_orderkey", *ROW, "o_orderdate",
                     F.explode(F.sequence(F.lit(1), F.col("n_lines").cast("int"))).alias("l_linenumber"))
    li = li.withColumns(dict(zip(ROW, draws.advance(_state(), F.col("l_linenumber"), MOST_LINES), strict=True)))
    ln = _Line(sf, _state(), sizes)
    partkey = ln.partkey
    ship = ln.ship()
    receipt = F.date_add(F.col("l_shipdate"), ln.int(1, 30, "l_receipt").cast("int"))
    li = li.select(
        F.col("o_orderkey").alias("l_orderkey"), *ROW, "l_linenumber",
        partkey.alias("l_partkey"),
        K.partsupp_bridge(partkey, ln.int(0, 3, "l_supp"), ln.n_supp).alias("l_suppkey"),
        ln.int(1, 50, "l_qty").cast(MONEY).alias("l_quantity"),
        cents_to_decimal(ln.eprice_cents()).alias("l_extendedprice"),
        cents_to_decimal(ln.int(0, 10, "l_disc")).alias("l_discount"),
        cents_to_decimal(ln.int(0, 8, "l_tax")).alias("l_tax"),
        ship.alias("l_shipdate"),
        F.date_add(F.col("o_orderdate"), ln.int(30, 90, "l_commit").cast("int")).alias("l_commitdate"),
        X.pick(vocab.INSTRUCTIONS, S["l_instr"], ln.row).alias("l_shipinstruct"),
        X.pick(vocab.SHIP_MODES, S["l_mode"], ln.row).alias("l_shipmode"),
        X.pick(vocab.RETURN_FLAGS, S["l_rflag"], ln.row).alias("_flag"))
    li = li.withColumn("l_receiptdate", receipt)
    li = (li.withColumn("l_returnflag", F.when(F.col("l_receiptdate") <= F.lit(CURRENT_DATE), F.col("_flag"))
                        .otherwise(F.lit("N")))
            .withColumn("l_linestatus", F.when(F.col("l_shipdate") <= F.lit(CURRENT_DATE), F.lit("F"))
                        .otherwise(F.lit("O"))))
    li = _with_text(li, "l_comment", pool)
    return _conform(li, "lineitem")


def orders_and_lineitem(spark: SparkSession, sf: float, partitions: int | None = None, key_source: DataFrame | None = None,
                        sizes: dict[str, int] | None = None, pool: X.Pool | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables from one master/detail row set (I7, I8). ``sizes``: rows of given parent tables."""
    keys = _spread(key_source, partitions) if key_source is not None else _keys(spark, scaled(sf, "orders"), partitions)
    rows = _order_rows(keys, sf, sizes=sizes)
    return _orders_from_rows(rows, sf, sizes, pool), _lines_from_rows(rows, sf, sizes, pool)


def refresh_set(spark: SparkSession, sf: float, update: int, partitions: int | None = None, key_source: DataFrame | None = None,
                sizes: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refresh set ``update`` (1-based): new orders with lines, and the keys to delete.

    Both cover order indices ``[(u-1)*n + 1, u*n]`` with ``n`` a thousandth of the
    orders; the inserts carry sequence bits ``1 + u div 1000``, the deletes ``u div
    1000``. With ``key_source`` (the dense 1-based indices of given orders) the set
    takes those of them that lie in the range, in as many tasks as they are read in.
    """
    n = max(_size(sf, sizes, "orders") // UPDATES_PER_SEQUENCE, 1)
    lo = (update - 1) * n + 1
    if key_source is not None:
        c = F.col(key_source.columns[0])
        keys = _spread(key_source.filter(c.between(lo, lo + n - 1)), partitions)
    else:
        keys = spark.range(lo, lo + n, numPartitions=partitions or spark.sparkContext.defaultParallelism)
    rows = _order_rows(keys, sf, upd=update, sizes=sizes)
    deletes = keys.select(K.sparse_key(F.col(keys.columns[0]), update // UPDATES_PER_SEQUENCE).alias("o_orderkey"))
    return _orders_from_rows(rows, sf, sizes), _lines_from_rows(rows, sf, sizes), deletes


def generate(spark: SparkSession, table: str, sf: float, partitions: int | None = None, pool_bytes: int = X.POOL_BYTES) -> DataFrame:
    """One table by name at a scale factor (I13), its comments from a pool of ``pool_bytes``."""
    if table == "region":
        return region(spark)
    if table == "nation":
        return nation(spark)
    pool = X.text_pool(spark, pool_bytes)
    if table in ("orders", "lineitem"):
        o, li = orders_and_lineitem(spark, sf, partitions, pool=pool)
        return o if table == "orders" else li
    return {"supplier": supplier, "customer": customer, "part": part, "partsupp": partsupp}[table](
        spark, sf, partitions, pool=pool)


def write_chunked(df: DataFrame, key: str, chunks: int, path: str) -> None:
    """Chunked output (I12): chunk of a dense 1-based key, one folder per chunk."""
    total = df.select(F.count(F.lit(1))).scalar()
    per = F.greatest(K.div(total, chunks), F.lit(1))
    chunk = F.least(K.div(F.col(key) - 1, per) + 1, F.lit(chunks)).cast("int")
    df.withColumn("chunk", chunk).write.mode("overwrite").partitionBy("chunk").parquet(path)


def date_dimension(spark: SparkSession, start: dt.date = START_DATE, days: int = 2557) -> DataFrame:
    """The 2,557-day calendar of the generator."""
    from shoal.functions.dates import date_parts
    d = spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    return d.select(*date_parts(F.col("d")))
