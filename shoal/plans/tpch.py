"""The reference's queries as DataFrame plans, plus their SQL text.

Three study queries (join, aggregation, filter), the Q1 template and the
approved variants 8a, 12a, 13a, 14a and 15a. Each builder takes a dict of
tables (``shoal.sources.fixtures.tables``) and the query parameters; money is
aggregated exactly in DECIMAL and reported as DOUBLE, ratios are computed in
DOUBLE (DECIMAL division scales differ between engines).

Scale notes are next to each plan: which side shuffles, what is pre-aggregated,
what is broadcast and why its size is bounded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order priorities counted as "high" in Q12.
HIGH_PRIORITIES = ["1-URGENT", "2-HIGH"]


def _date(d: str | dt.date) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def _money_sum(c: Column, name: str) -> Column:
    return F.sum(c).cast("double").alias(name)


def revenue_expr() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


# --------------------------------------------------------------------------- study queries
def join_orders_lineitem(orders: DataFrame, lineitem: DataFrame, strategy: str = "auto") -> DataFrame:
    """``select * from orders, lineitem where l_orderkey = o_orderkey``.

    Both sides shuffle on the order key (or the strategy of ``operators.joins``
    avoids it); every column of both sides is returned.
    """
    from shoal.operators.joins import equi_join
    return equi_join(orders, lineitem, "o_orderkey", "l_orderkey", strategy).select("*")


def count_by(lineitem: DataFrame, column: str = "l_shipmode", alias: str = "cnt") -> DataFrame:
    """``select c, count(c) from lineitem group by c`` (D1): map-side partial counts."""
    return lineitem.groupBy(column).agg(F.count(column).alias(alias))


def filter_discount(lineitem: DataFrame, low: float = 0.05, high: float = 0.1) -> DataFrame:
    """``select * from lineitem where l_discount >= low and l_discount <= high`` (B2).

    A closed range on one column: pushed into the Parquet scan as two filters,
    row groups outside the range are skipped by their min/max statistics.
    """
    d = F.col("l_discount")
    return lineitem.filter((d >= F.lit(low)) & (d <= F.lit(high)))


def count_before(lineitem: DataFrame, cutoff: str = "1997-01-01",
                 column: str = "l_shipdate") -> DataFrame:
    """``select count(*) from lineitem where col < date``."""
    return (lineitem.filter(F.col(column) < _date(cutoff))
            .agg(F.count(F.lit(1)).alias("cnt")))


# --------------------------------------------------------------------------- Q1
def pricing_summary(t: dict[str, DataFrame], delta_days: int = 90,
                    base: str = "1998-12-01") -> DataFrame:
    """Q1: eight aggregates over two low-cardinality keys.

    Partial aggregation in every scan task, so the shuffle carries a handful of
    rows per task whatever the table size; the final sort is over 4-6 rows.
    """
    li = t["lineitem"]
    disc_price = revenue_expr()
    charge = disc_price * (1 + F.col("l_tax"))
    return (li.filter(F.col("l_shipdate") <= F.date_sub(_date(base), delta_days))
            .groupBy("l_returnflag", "l_linestatus")
            .agg(_money_sum(F.col("l_quantity"), "sum_qty"),
                 _money_sum(F.col("l_extendedprice"), "sum_base_price"),
                 _money_sum(disc_price, "sum_disc_price"),
                 _money_sum(charge, "sum_charge"),
                 (F.sum("l_quantity").cast("double") / F.count("l_quantity")).alias("avg_qty"),
                 (F.sum("l_extendedprice").cast("double") / F.count("l_extendedprice")).alias("avg_price"),
                 (F.sum("l_discount").cast("double") / F.count("l_discount")).alias("avg_disc"),
                 F.count(F.lit(1)).alias("count_order"))
            .orderBy("l_returnflag", "l_linestatus"))


# --------------------------------------------------------------------------- Q8a
def market_share(t: dict[str, DataFrame], nation: str = "BRAZIL", region: str = "AMERICA",
                 part_type: str = "ECONOMY ANODIZED STEEL",
                 start: str = "1995-01-01", end: str = "1996-12-31") -> DataFrame:
    """Share of one supplier nation in a region's revenue, per year (C4, D3).

    ``region`` (5 rows) and ``nation`` (25 rows) are fixed-size by definition
    and broadcast. The customer side is reduced to the region's customers before
    it meets orders; lineitem meets the filtered part set first (the most
    selective join), then orders, then suppliers. Catalyst adds runtime bloom
    filters on the big side of these joins.
    """
    nat, reg = t["nation"], t["region"]
    n1 = nat.select(F.col("n_nationkey").alias("n1_nationkey"), F.col("n_regionkey").alias("n1_regionkey"))
    n2 = nat.select(F.col("n_nationkey").alias("n2_nationkey"), F.col("n_name").alias("nation"))
    region_nations = (n1.join(F.broadcast(reg.filter(F.col("r_name") == region)),
                              F.col("n1_regionkey") == F.col("r_regionkey"))
                      .select("n1_nationkey"))
    cust = (t["customer"].select("c_custkey", "c_nationkey")
            .join(F.broadcast(region_nations), F.col("c_nationkey") == F.col("n1_nationkey"), "left_semi"))
    orders = (t["orders"].filter(F.col("o_orderdate").between(_date(start), _date(end)))
              .select("o_orderkey", "o_custkey", "o_orderdate")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))
    parts = t["part"].filter(F.col("p_type") == part_type).select("p_partkey")
    lines = (t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
             .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
             .join(F.broadcast(n2), F.col("s_nationkey") == F.col("n2_nationkey")))
    all_nations = lines.select(F.year("o_orderdate").alias("o_year"),
                               revenue_expr().alias("volume"), "nation")
    return (all_nations.groupBy("o_year")
            .agg((F.sum(F.when(F.col("nation") == nation, F.col("volume")).otherwise(0)).cast("double")
                  / F.nullif(F.sum("volume").cast("double"), F.lit(0.0))).alias("mkt_share"))
            .orderBy("o_year"))


# --------------------------------------------------------------------------- Q12a
def shipmode_priority(t: dict[str, DataFrame], mode1: str = "MAIL", mode2: str = "SHIP",
                      start: str = "1994-01-01") -> DataFrame:
    """high/low priority line counts per ship mode.

    Lineitem filters (mode list, column-to-column date order, a one-year receipt
    window) run in the scan stage before the shuffle on the order key.
    """
    li = (t["lineitem"]
          .filter(F.col("l_shipmode").isin(mode1, mode2)
                  & (F.col("l_commitdate") < F.col("l_receiptdate"))
                  & (F.col("l_shipdate") < F.col("l_commitdate"))
                  & (F.col("l_receiptdate") >= _date(start))
                  & (F.col("l_receiptdate") < F.add_months(_date(start), 12)))
          .select("l_orderkey", "l_shipmode"))
    o = t["orders"].select("o_orderkey", "o_orderpriority")
    high = F.col("o_orderpriority").isin(*HIGH_PRIORITIES)
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_shipmode")
            .agg(F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"),
                 F.sum(F.when(high, 0).otherwise(1)).alias("low_line_count"))
            .orderBy("l_shipmode"))


# --------------------------------------------------------------------------- Q13a
def customer_distribution(t: dict[str, DataFrame], word1: str = "special",
                          word2: str = "requests") -> DataFrame:
    """How many customers have k orders, excluding orders whose comment
    matches ``%word1%word2%`` (C5, D5, F2, A7).

    The LIKE belongs to the outer join's ON clause: a customer whose orders all
    match still appears with a count of 0. Orders are counted per customer
    *before* the join (map-side partial counts, so a customer holding a third
    of all orders costs one row per task), then the customer table is
    left-joined to the counts on the already-partitioned key.
    """
    pattern = f"%{word1}%{word2}%"
    per_cust = (t["orders"].filter(~F.col("o_comment").like(pattern))
                .groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")))
    orders_per_cust = (t["customer"].select("c_custkey")
                       .join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
                       .select(F.col("c_custkey").alias("custkey"),
                               F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("ordercount")))
    return (orders_per_cust.groupBy("ordercount").agg(F.count(F.lit(1)).alias("custdist"))
            .orderBy(F.desc("custdist"), F.desc("ordercount")))


def customer_distribution_join_first(t: dict[str, DataFrame], word1: str = "special",
                                     word2: str = "requests") -> DataFrame:
    """Q13a written as in the template: outer join with the LIKE inside ON, then count."""
    pattern = f"%{word1}%{word2}%"
    c, o = t["customer"], t["orders"]
    cond = (F.col("c_custkey") == F.col("o_custkey")) & ~F.col("o_comment").like(pattern)
    orders_per_cust = (c.select("c_custkey").join(o.select("o_orderkey", "o_custkey", "o_comment"), cond, "left")
                       .groupBy("c_custkey").agg(F.count("o_orderkey").alias("ordercount")))
    return (orders_per_cust.groupBy("ordercount").agg(F.count(F.lit(1)).alias("custdist"))
            .orderBy(F.desc("custdist"), F.desc("ordercount")))


# --------------------------------------------------------------------------- Q14a
def promo_effect(t: dict[str, DataFrame], start: str = "1995-09-01") -> DataFrame:
    """Percent of one month's revenue from PROMO parts.

    One month of lineitem meets part on the part key; the result is a single
    global aggregate (partial sums per task, one final row).
    """
    li = (t["lineitem"]
          .filter((F.col("l_shipdate") >= _date(start))
                  & (F.col("l_shipdate") < F.add_months(_date(start), 1)))
          .select("l_partkey", "l_extendedprice", "l_discount"))
    p = t["part"].select("p_partkey", "p_type")
    rev = revenue_expr()
    promo = F.when(F.substring("p_type", 1, 5) == "PROMO", rev).otherwise(0)
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
            .agg((F.lit(100.0) * F.sum(promo).cast("double") / F.nullif(F.sum(rev).cast("double"), F.lit(0.0)))
                 .alias("promo_revenue")))


# --------------------------------------------------------------------------- Q15a
def supplier_revenue(lineitem: DataFrame, start: str = "1996-01-01") -> DataFrame:
    """The ``revenue`` CTE of Q15a: exact DECIMAL revenue per supplier for 3 months."""
    return (lineitem
            .filter((F.col("l_shipdate") >= _date(start))
                    & (F.col("l_shipdate") < F.add_months(_date(start), 3)))
            .groupBy(F.col("l_suppkey").alias("supplier_no"))
            .agg(F.sum(revenue_expr()).alias("total_revenue")))


def top_supplier(t: dict[str, DataFrame], start: str = "1996-01-01") -> DataFrame:
    """supplier(s) with the maximum 3-month revenue.

    The maximum is a scalar subquery (a one-row global aggregate); equality is
    tested on exact DECIMAL sums, so ties are found regardless of summation order.
    """
    revenue = supplier_revenue(t["lineitem"], start)
    top = revenue.select(F.max("total_revenue")).scalar()
    s = t["supplier"].select("s_suppkey", "s_name", "s_address", "s_phone")
    return (s.join(revenue.filter(F.col("total_revenue") == top),
                   F.col("s_suppkey") == F.col("supplier_no"))
            .select("s_suppkey", "s_name", "s_address", "s_phone",
                    F.col("total_revenue").cast("double").alias("total_revenue"))
            .orderBy("s_suppkey"))


# --------------------------------------------------------------------------- SQL text (M3)
# Spark SQL forms with named parameter markers, bound through spark.sql(args=...).
SQL = {
    "join": "SELECT * FROM orders, lineitem WHERE l_orderkey = o_orderkey",
    "aggregation": "SELECT l_shipmode, count(l_shipmode) AS cnt FROM lineitem GROUP BY l_shipmode",
    "filter": "SELECT * FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.1",
    "q1": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
               CAST(sum(l_extendedprice) AS DOUBLE) AS sum_base_price,
               CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS sum_disc_price,
               CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE) AS sum_charge,
               CAST(sum(l_quantity) AS DOUBLE) / count(l_quantity) AS avg_qty,
               CAST(sum(l_extendedprice) AS DOUBLE) / count(l_extendedprice) AS avg_price,
               CAST(sum(l_discount) AS DOUBLE) / count(l_discount) AS avg_disc,
               count(*) AS count_order
        FROM lineitem
        WHERE l_shipdate <= date_sub(DATE '1998-12-01', :delta)
        GROUP BY l_returnflag, l_linestatus
        ORDER BY l_returnflag, l_linestatus""",
    "q8a": """
        SELECT o_year,
               CAST(sum(decode(nation, :nation, volume, 0)) AS DOUBLE) / CAST(sum(volume) AS DOUBLE)
                   AS mkt_share
        FROM (SELECT year(o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume,
                     n2.n_name AS nation
              FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
              WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
                AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
                AND n1.n_regionkey = r_regionkey AND r_name = :region
                AND s_nationkey = n2.n_nationkey
                AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
                AND p_type = :ptype) all_nations
        GROUP BY o_year ORDER BY o_year""",
    "q12a": """
        SELECT l_shipmode,
               sum(decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0)) AS high_line_count,
               sum(decode(o_orderpriority, '1-URGENT', 0, '2-HIGH', 0, 1)) AS low_line_count
        FROM orders, lineitem
        WHERE o_orderkey = l_orderkey AND l_shipmode IN (:mode1, :mode2)
          AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
          AND l_receiptdate >= CAST(:start AS DATE)
          AND l_receiptdate < CAST(:start AS DATE) + INTERVAL '1' YEAR
        GROUP BY l_shipmode ORDER BY l_shipmode""",
    "q13a": """
        WITH orders_per_cust (custkey, ordercount) AS (
            SELECT c_custkey, count(o_orderkey)
            FROM customer LEFT OUTER JOIN orders
              ON c_custkey = o_custkey AND o_comment NOT LIKE concat('%', :word1, '%', :word2, '%')
            GROUP BY c_custkey)
        SELECT ordercount, count(*) AS custdist FROM orders_per_cust
        GROUP BY ordercount ORDER BY custdist DESC, ordercount DESC""",
    "q14a": """
        SELECT 100.0 * CAST(sum(decode(substring(p_type, 1, 5), 'PROMO',
                                       l_extendedprice * (1 - l_discount), 0)) AS DOUBLE)
               / CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS promo_revenue
        FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= CAST(:start AS DATE)
          AND l_shipdate < CAST(:start AS DATE) + INTERVAL '1' MONTH""",
    "q15a": """
        WITH revenue (supplier_no, total_revenue) AS (
            SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) FROM lineitem
            WHERE l_shipdate >= CAST(:start AS DATE)
              AND l_shipdate < CAST(:start AS DATE) + INTERVAL '3' MONTH
            GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, s_address, s_phone, CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM supplier, revenue
        WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)
        ORDER BY s_suppkey""",
}

DEFAULT_ARGS = {
    "q1": {"delta": 90},
    "q8a": {"nation": "BRAZIL", "region": "AMERICA", "ptype": "ECONOMY ANODIZED STEEL"},
    "q12a": {"mode1": "MAIL", "mode2": "SHIP", "start": "1994-01-01"},
    "q13a": {"word1": "special", "word2": "requests"},
    "q14a": {"start": "1995-09-01"},
    "q15a": {"start": "1996-01-01"},
}


def run_sql(spark: SparkSession, name: str, **args) -> DataFrame:
    """Bind parameters into a query's SQL text and plan it (M3).

    The full views must be registered under the plain table names
    (``shoal.sources.fixtures.register``).
    """
    bound = {**DEFAULT_ARGS.get(name, {}), **args}
    return spark.sql(SQL[name], args=bound or None)
