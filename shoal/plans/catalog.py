"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracle SQL.

Every query reads the driver tables of ``sf_dir`` (or views Spark derives from
them) in full. Outputs are normalised by ``for_oracle``: DECIMAL -> DOUBLE
(exact sums, then one conversion), DATE -> ISO text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

from shoal.plans import tpch
from shoal.plans.oracle import dates_as_text, with_fixtures
from shoal.sources import fixtures
from shoal.sources.tables import load

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}   # outputs normalised for the cross-engine comparison
RAW: dict[str, QueryFn] = {}       # the same plans with native output types (DECIMAL, DATE)
ORACLE: dict[str, str] = {}


def for_oracle(df: DataFrame) -> DataFrame:
    """DECIMAL columns to DOUBLE, DATE and TIMESTAMP columns to ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        RAW[name] = fn
        QUERIES[name] = lambda spark, sf_dir: for_oracle(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixtures.tables(spark, sf_dir)


# --------------------------------------------------------------------------- study queries
TS_JOIN = ("o_orderdate", "l_shipdate")
JOIN_SQL = dates_as_text("SELECT * FROM orders, lineitem WHERE l_orderkey = o_orderkey", *TS_JOIN)


@register("join_orders_lineitem", JOIN_SQL)
def q_join(spark, sf_dir):
    """The measured join, every column of both tables."""
    return tpch.join_orders_lineitem(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))


@register("count_by_flag",
          "SELECT l_returnflag, count(l_returnflag) AS cnt FROM lineitem GROUP BY l_returnflag")
def q_count_flag(spark, sf_dir):
    """D1 on a driver column."""
    return tpch.count_by(load(spark, sf_dir, "lineitem"), "l_returnflag")


@register("count_by_shipmode", with_fixtures(
    "SELECT l_shipmode, count(l_shipmode) AS cnt FROM lineitem_full GROUP BY l_shipmode",
    "lineitem_full"))
def q_count_shipmode(spark, sf_dir):
    """D1 exactly as the reference writes it, on the full lineitem view."""
    return tpch.count_by(fixtures.lineitem(spark, sf_dir), "l_shipmode")


@register("count_before_date",
          "SELECT count(*) AS cnt FROM lineitem WHERE l_shipdate < DATE '1997-01-01'")
def q_count_before(spark, sf_dir):
    """Global filtered count (on the ship date)."""
    return tpch.count_before(load(spark, sf_dir, "lineitem"), "1997-01-01")


@register("filter_discount",
          dates_as_text("SELECT * FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.1", "l_shipdate"))
def q_filter(spark, sf_dir):
    """B2: closed range filter, all columns."""
    return tpch.filter_discount(load(spark, sf_dir, "lineitem"))


# --------------------------------------------------------------------------- TPC-H templates
Q1_ORACLE = with_fixtures("""
    SELECT l_returnflag, l_linestatus,
           CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
           CAST(sum(l_extendedprice) AS DOUBLE) AS sum_base_price,
           CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS sum_disc_price,
           CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE) AS sum_charge,
           CAST(sum(l_quantity) AS DOUBLE) / count(l_quantity) AS avg_qty,
           CAST(sum(l_extendedprice) AS DOUBLE) / count(l_extendedprice) AS avg_price,
           CAST(sum(l_discount) AS DOUBLE) / count(l_discount) AS avg_disc,
           count(*) AS count_order
    FROM lineitem_full
    WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY
    GROUP BY l_returnflag, l_linestatus
    ORDER BY l_returnflag, l_linestatus""", "lineitem_full")


@register("pricing_summary", Q1_ORACLE)
def q_pricing(spark, sf_dir):
    """Q1 (D2, B4, F1) with the default 90-day delta."""
    return tpch.pricing_summary(T(spark, sf_dir), 90)


Q8_ARGS = dict(nation="NATION_2", region="AMERICA", part_type="ECONOMY")
Q8_ORACLE = with_fixtures("""
    SELECT o_year,
           CAST(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) AS DOUBLE)
             / nullif(CAST(sum(volume) AS DOUBLE), 0) AS mkt_share
    FROM (SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS o_year,
                 l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
          FROM part_full, supplier_full, lineitem_full, orders_full, customer_full,
               nation_full n1, nation_full n2, region_full
          WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
            AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA'
            AND s_nationkey = n2.n_nationkey
            AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
            AND p_type = 'ECONOMY') all_nations
    GROUP BY o_year ORDER BY o_year""",
    "part_full", "supplier_full", "lineitem_full", "orders_full", "customer_full",
    "nation_full", "region_full")


@register("market_share", Q8_ORACLE)
def q_market_share(spark, sf_dir):
    """Q8a (C4, D3, H2, H3, B5, B6, B10, B11, B15)."""
    return tpch.market_share(T(spark, sf_dir), **Q8_ARGS)


Q12_ORACLE = with_fixtures("""
    SELECT l_shipmode,
           CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT)
               AS high_line_count,
           CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT)
               AS low_line_count
    FROM orders_full, lineitem_full
    WHERE o_orderkey = l_orderkey AND l_shipmode IN ('MAIL', 'SHIP')
      AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
      AND l_receiptdate >= DATE '1996-01-01'
      AND l_receiptdate < DATE '1996-01-01' + INTERVAL 1 YEAR
    GROUP BY l_shipmode ORDER BY l_shipmode""", "orders_full", "lineitem_full")


@register("shipmode_priority", Q12_ORACLE)
def q_shipmode(spark, sf_dir):
    """Q12a (D4, B3, B7, B8) with MAIL, SHIP, 1996-01-01."""
    return tpch.shipmode_priority(T(spark, sf_dir), "MAIL", "SHIP", "1996-01-01")


Q13_ORACLE = with_fixtures("""
    , orders_per_cust AS (
        SELECT c_custkey AS custkey, count(o_orderkey) AS ordercount
        FROM customer_full LEFT OUTER JOIN orders_full
          ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%'
        GROUP BY c_custkey)
    SELECT ordercount, count(*) AS custdist FROM orders_per_cust
    GROUP BY ordercount ORDER BY custdist DESC, ordercount DESC""", "customer_full", "orders_full")


@register("customer_distribution", Q13_ORACLE)
def q_customer_dist(spark, sf_dir):
    """Q13a (C5, D5, F2, A7) with 'special', 'requests'."""
    return tpch.customer_distribution(T(spark, sf_dir), "special", "requests")


@register("customer_distribution_join_first", Q13_ORACLE)
def q_customer_dist_join(spark, sf_dir):
    """Q13a as written (C5): the outer join with the LIKE in its ON clause, then both counts."""
    return tpch.customer_distribution_join_first(T(spark, sf_dir), "special", "requests")


Q14_ORACLE = with_fixtures("""
    SELECT 100.0 * CAST(sum(CASE WHEN substring(p_type, 1, 5) = 'PROMO'
                                 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS DOUBLE)
           / nullif(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 0) AS promo_revenue
    FROM lineitem_full, part_full
    WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01'
      AND l_shipdate < DATE '1997-09-01' + INTERVAL 1 MONTH""", "lineitem_full", "part_full")


@register("promo_effect", Q14_ORACLE)
def q_promo(spark, sf_dir):
    """Q14a (C7, D6, B3, H4, H28) for September 1997."""
    return tpch.promo_effect(T(spark, sf_dir), "1997-09-01")


Q15_ORACLE = with_fixtures("""
    , revenue AS (
        SELECT l_suppkey AS supplier_no, sum(l_extendedprice * (1 - l_discount)) AS total_revenue
        FROM lineitem_full
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL 3 MONTH
        GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, s_address, s_phone, CAST(total_revenue AS DOUBLE) AS total_revenue
    FROM supplier_full, revenue
    WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)
    ORDER BY s_suppkey""", "lineitem_full", "supplier_full")


@register("top_supplier", Q15_ORACLE)
def q_top_supplier(spark, sf_dir):
    """Q15a (C6, D7, B12) for the quarter from 1996-01-01."""
    return tpch.top_supplier(T(spark, sf_dir), "1996-01-01")


# --------------------------------------------------------------------------- bound SQL text (M3, H2)
def _bound_sql(name: str, args: dict):
    def run(spark, sf_dir):
        fixtures.register(spark, sf_dir)
        return tpch.run_sql(spark, name, **args)
    run.__doc__ = f"M3: the SQL text of {name} with bound parameters over registered views."
    return run


register("market_share_sql", Q8_ORACLE)(_bound_sql("q8a", dict(nation="NATION_2", region="AMERICA", ptype="ECONOMY")))
register("promo_effect_sql", Q14_ORACLE)(_bound_sql("q14a", dict(start="1997-09-01")))


# --------------------------------------------------------------------------- join strategies
def _join_with(strategy: str):
    def run(spark, sf_dir):
        return tpch.join_orders_lineitem(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"),
                                         strategy)
    run.__doc__ = f"C2/C3: the measured join planned as {strategy}."
    return run


for _s in ("sort_merge", "shuffle_hash", "broadcast"):
    register(f"join_{_s}", JOIN_SQL)(_join_with(_s))


def _bucketed(spark, sf_dir, orders: int, lines: int):
    from shoal.operators.joins import bucketed_copy, bucketed_join
    names = [bucketed_copy(spark, f"{sf_dir.rstrip('/')}/{t}.parquet", k, n)
             for t, k, n in (("orders", "o_orderkey", orders), ("lineitem", "l_orderkey", lines))]
    return bucketed_join(spark, *names, "o_orderkey", "l_orderkey").select("*")


@register("join_bucketed", JOIN_SQL)
def q_join_bucketed(spark, sf_dir):
    """C3(b): both sides bucketed by the order key, written when the stored tables' files have no copy yet; the join plans no Exchange."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _bucketed(spark, sf_dir, n, n)


@register("join_buckets_unequal", JOIN_SQL)
def q_join_buckets_unequal(spark, sf_dir):
    """8 buckets of orders against 32 of lineitem, coalesced in the join."""
    return _bucketed(spark, sf_dir, 8, 32)


URGENT = "o_orderpriority = '1-URGENT' AND o_totalprice > 400000"
_URGENT_SQL = f"""
    SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders, lineitem
    WHERE o_orderkey = l_orderkey AND {URGENT}"""


def _urgent(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter(URGENT).select("o_orderkey", "o_totalprice")
    return o, load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@register("join_key_filter", _URGENT_SQL)
def q_join_key_filter(spark, sf_dir):
    """Lines of few orders; a bitmap of their keys thins lineitem before the sort-merge join shuffles it."""
    from shoal.operators.keyfilter import filtered_join
    return filtered_join(*_urgent(spark, sf_dir), "o_orderkey", "l_orderkey", "sort_merge").drop("l_orderkey")


@register("join_no_key_filter", _URGENT_SQL)
def q_join_no_key_filter(spark, sf_dir):
    """The same join, all of lineitem shuffled."""
    from shoal.operators.joins import equi_join
    return equi_join(*_urgent(spark, sf_dir), "o_orderkey", "l_orderkey", "sort_merge").drop("l_orderkey")


# --------------------------------------------------------------------------- quality
from shoal.operators import quality, windows  # noqa: E402
from shoal.sources.schemas import (FOREIGN_KEYS, MAX_LENGTH, NULLABLE,  # noqa: E402
                                   PRIMARY_KEYS, SCHEMAS)

ALL_FULL = [f"{t}_full" for t in SCHEMAS]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _not_null_sql() -> str:
    parts = []
    for t, schema in SCHEMAS.items():
        for f in schema.fields:
            parts.append(f"SELECT {_q(t)} AS tbl, {_q(f.name)} AS column_name, "
                         f"{'TRUE' if f.name in NULLABLE else 'FALSE'} AS nullable, "
                         f"CAST(count(*) - count({f.name}) AS BIGINT) AS null_count FROM {t}_full")
    return with_fixtures("\nUNION ALL\n".join(parts), *ALL_FULL)


def _pk_sql() -> str:
    parts = [f"SELECT {_q(t)} AS tbl, CAST(count(*) AS BIGINT) AS dup_keys, "
             f"CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_rows FROM "
             f"(SELECT count(*) AS n FROM {t}_full GROUP BY {', '.join(k)} HAVING count(*) > 1) d"
             for t, k in PRIMARY_KEYS.items()]
    return with_fixtures("\nUNION ALL\n".join(parts), *ALL_FULL)


def _fk_sql() -> str:
    parts = []
    for child, ccols, parent, pcols in FOREIGN_KEYS:
        cond = " AND ".join(f"p.{p} = c.{c}" for c, p in zip(ccols, pcols))
        parts.append(
            f"SELECT {_q(child)} AS child, {_q(','.join(ccols))} AS child_cols, {_q(parent)} AS parent, "
            f"CAST(count(*) AS BIGINT) AS orphan_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_rows "
            f"FROM (SELECT {', '.join(ccols)}, count(*) AS n FROM {child}_full GROUP BY {', '.join(ccols)}) c "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent}_full p WHERE {cond})")
    return with_fixtures("\nUNION ALL\n".join(parts), *ALL_FULL)


def _length_sql() -> str:
    parts = [f"SELECT {_q(t)} AS tbl, {_q(c)} AS column_name, CAST(max(length({c})) AS BIGINT) AS max_len, "
             f"CAST({b} AS BIGINT) AS bound, "
             f"CAST(coalesce(sum(CASE WHEN length({c}) > {b} THEN 1 ELSE 0 END), 0) AS BIGINT) AS over_bound "
             f"FROM {t}_full"
             for t, cols in MAX_LENGTH.items() for c, b in cols.items()]
    return with_fixtures("\nUNION ALL\n".join(parts), *ALL_FULL)


def _sql_lit(v) -> str:
    import datetime as _dt
    return f"DATE '{v.isoformat()}'" if isinstance(v, _dt.date) else repr(v)


def _domain_sql() -> str:
    parts = [f"SELECT {_q(t)} AS tbl, {_q(c)} AS column_name, CAST(min({c}) AS VARCHAR) AS min_value, "
             f"CAST(max({c}) AS VARCHAR) AS max_value, {_q(str(lo))} AS lo, {_q(str(hi))} AS hi, "
             f"CAST(coalesce(sum(CASE WHEN {c} < {_sql_lit(lo)} OR {c} > {_sql_lit(hi)} THEN 1 ELSE 0 END), 0)"
             f" AS BIGINT) AS out_of_range FROM {t}_full"
             for t, doms in quality.DOMAINS.items() for c, (lo, hi) in doms.items()]
    return with_fixtures("\nUNION ALL\n".join(parts), *ALL_FULL)


@register("not_null", _not_null_sql())
def q_not_null(spark, sf_dir):
    """NULL count of every column of the eight full tables."""
    return quality.not_null(T(spark, sf_dir).materialize())


@register("pk_violations", _pk_sql())
def q_pk(spark, sf_dir):
    """Duplicate primary keys per table."""
    return quality.pk_violations(T(spark, sf_dir).materialize())


@register("fk_violations", _fk_sql())
def q_fk(spark, sf_dir):
    """Orphan keys and rows per foreign key (anti join, child pre-aggregated)."""
    return quality.fk_violations(T(spark, sf_dir).materialize())


@register("length_check", _length_sql())
def q_length(spark, sf_dir):
    """Text length against the CHAR/VARCHAR bound."""
    return quality.length_check(T(spark, sf_dir).materialize())


@register("domain_check", _domain_sql())
def q_domain(spark, sf_dir):
    """min/max and out-of-domain count per bounded column."""
    return quality.domain_check(T(spark, sf_dir).materialize())


ROLLUP_SQL = """
    SELECT l_orderkey AS orderkey,
           CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE) AS total,
           count(*) AS lines,
           CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = count(*) THEN 'F'
                WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = count(*) THEN 'O'
                ELSE 'P' END AS status
    FROM lineitem_full GROUP BY l_orderkey"""


@register("order_rollup", with_fixtures(ROLLUP_SQL, "lineitem_full"))
def q_rollup(spark, sf_dir):
    """Order total, line count and status from the lines."""
    return quality.order_rollup(fixtures.lineitem(spark, sf_dir))


@register("order_header_check", with_fixtures("""
    , roll AS (SELECT l_orderkey AS orderkey,
                      sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total, count(*) AS lines,
                      CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = count(*) THEN 'F'
                           WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = count(*) THEN 'O'
                           ELSE 'P' END AS status
               FROM lineitem_full GROUP BY l_orderkey)
    SELECT CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT)
               AS orders_without_lines,
           CAST(sum(CASE WHEN orderkey IS NOT NULL AND o_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT)
               AS lines_without_order,
           CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND orderkey IS NOT NULL AND lines NOT BETWEEN 1 AND 7
                         THEN 1 ELSE 0 END) AS BIGINT) AS bad_line_count,
           CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND orderkey IS NOT NULL AND o_orderstatus <> status
                         THEN 1 ELSE 0 END) AS BIGINT) AS status_mismatch,
           CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND orderkey IS NOT NULL
                              AND abs(o_totalprice - total) > lines * 0.02 THEN 1 ELSE 0 END) AS BIGINT)
               AS price_mismatch,
           CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND orderkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT)
               AS orders_checked
    FROM orders_full FULL OUTER JOIN roll ON o_orderkey = orderkey""", "lineitem_full", "orders_full"))
def q_header_check(spark, sf_dir):
    """Stored order headers against the rollup of their lines (counts only)."""
    return quality.order_header_check(fixtures.orders(spark, sf_dir), fixtures.lineitem(spark, sf_dir))


def _checksum_sql(t: str, source: str, cols) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return (f"SELECT {_q(t)} AS tbl, count(*) AS row_count, "
            f"CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)), 0) AS BIGINT) AS checksum FROM {source}")


_CHECKSUMS = "\nUNION ALL\n".join(_checksum_sql(t, f"{t}_full", SCHEMAS[t].names) for t in SCHEMAS)


@register("table_checksum", with_fixtures(_CHECKSUMS, *ALL_FULL))
def q_checksum(spark, sf_dir):
    """Row count and order-free hash sum per table."""
    return quality.table_checksum(T(spark, sf_dir).materialize())


@register("same_rows_any_degree", with_fixtures(
    f"SELECT tbl, CAST(1 AS BIGINT) AS distinct_values, true AS all_equal FROM ({_CHECKSUMS}) c", *ALL_FULL))
def q_any_degree(spark, sf_dir):
    """The tables' checksums at three degrees of parallelism are one value each."""
    degrees = (2, 5, 11)
    rows = {n: df.count() for n, df in T(spark, sf_dir).materialize().items()}
    runs_ = [quality.table_checksum({n: fixtures.table(spark, sf_dir, n, lambda df, d=d, n=n: quality.at_degree(df, d, min(degrees), rows[n])) for n in rows})
             for d in degrees]
    return quality.all_equal(windows.union_all(runs_).select("tbl", "checksum"), ["tbl"], "checksum")


@register("value_lists", with_fixtures("\nUNION ALL\n".join(
    f"SELECT {_q(t)} AS tbl, {_q(c)} AS column_name, CAST(count(*) FILTER (WHERE {c} NOT IN ({', '.join(map(_q, vs))})) AS BIGINT) AS out_of_list "
    f"FROM {t}_full" for t, cols in quality.VALUE_LISTS.items() for c, vs in cols.items()), *ALL_FULL))
def q_value_lists(spark, sf_dir):
    """Values outside the fixed lists, per column."""
    return quality.out_of_list(T(spark, sf_dir).materialize())


@register("key_ranges", with_fixtures("\nUNION ALL\n".join(
    f"SELECT {_q(t)} AS tbl, {_q(c)} AS column_name, "
    f"CAST(count(*) FILTER (WHERE {c} < 0 OR {c} >= (SELECT count(*) FROM {p}_full)) AS BIGINT) AS out_of_range FROM {t}_full"
    for t, cols in quality.LINKS.items() for c, p in cols.items()), *ALL_FULL))
def q_key_ranges(spark, sf_dir):
    """Links outside the parent's key range, per column."""
    return quality.key_ranges(T(spark, sf_dir).materialize())


# --------------------------------------------------------------------------- refresh
from shoal.operators import refresh  # noqa: E402
from shoal.sources.fixtures import REFRESH_MODULUS  # noqa: E402

_SPARSE = "((({k} >> 3 << 2) + {seq}) << 3) + ({k} & 7)"

ORDERS_COLS = [f.name for f in SCHEMAS["orders"].fields]
LINE_COLS = [f.name for f in SCHEMAS["lineitem"].fields]


ORDER_DATES = ("o_orderdate",)
LINE_DATES = ("l_shipdate", "l_commitdate", "l_receiptdate")


@register("refresh_insert", dates_as_text(with_fixtures(f"""
    SELECT {_SPARSE.format(k='o_orderkey', seq=0)} AS o_orderkey, {', '.join(ORDERS_COLS[1:])} FROM orders_full
    UNION ALL
    SELECT {_SPARSE.format(k='o_orderkey', seq=1)} AS o_orderkey, {', '.join(ORDERS_COLS[1:])}
    FROM orders_full WHERE o_orderkey % {REFRESH_MODULUS} = 1""", "orders_full"), *ORDER_DATES))
def q_refresh_insert(spark, sf_dir):
    """Orders in sparse-key form after the insert set, whose keys carry sequence bits."""
    o = fixtures.orders(spark, sf_dir)
    return refresh.apply_inserts(refresh.sparse_form(o, "o_orderkey"), refresh.insert_orders(o))


@register("refresh_insert_lineitem", dates_as_text(with_fixtures(f"""
    SELECT {_SPARSE.format(k='l_orderkey', seq=0)} AS l_orderkey, {', '.join(LINE_COLS[1:])} FROM lineitem_full
    UNION ALL
    SELECT {_SPARSE.format(k='l_orderkey', seq=1)} AS l_orderkey, {', '.join(LINE_COLS[1:])}
    FROM lineitem_full WHERE l_orderkey % {REFRESH_MODULUS} = 1""", "lineitem_full"), *LINE_DATES))
def q_refresh_insert_li(spark, sf_dir):
    """Lineitem in sparse-key form after the insert set."""
    li = fixtures.lineitem(spark, sf_dir)
    return refresh.apply_inserts(refresh.sparse_form(li, "l_orderkey"), refresh.insert_lineitem(li))


@register("refresh_delete_orders", dates_as_text(with_fixtures(f"""
    SELECT * FROM orders_full o
    WHERE NOT EXISTS (SELECT 1 FROM orders_full d
                      WHERE d.o_orderkey % {REFRESH_MODULUS} = 0 AND d.o_orderkey = o.o_orderkey)""",
    "orders_full"), *ORDER_DATES))
def q_refresh_delete_orders(spark, sf_dir):
    """Orders after the delete set (left anti join on the key)."""
    o = fixtures.orders(spark, sf_dir)
    return refresh.apply_deletes(o, refresh.delete_keys(o), "o_orderkey")


@register("refresh_delete_lineitem", dates_as_text(with_fixtures(f"""
    SELECT * FROM lineitem_full l
    WHERE NOT EXISTS (SELECT 1 FROM orders_full d
                      WHERE d.o_orderkey % {REFRESH_MODULUS} = 0 AND d.o_orderkey = l.l_orderkey)""",
    "orders_full", "lineitem_full"), *LINE_DATES))
def q_refresh_delete_lineitem(spark, sf_dir):
    """Lineitem after the delete set."""
    o, li = fixtures.orders(spark, sf_dir), fixtures.lineitem(spark, sf_dir)
    return refresh.apply_deletes(li, refresh.delete_keys(o), "l_orderkey")


RUN_SETS, RANGE_WIDTH, RANGE_SET = 50, 1024, 3

_RUN_SQL = """
    , del AS (SELECT o_orderkey AS k, unnest([o_orderkey % 64] || CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey % 64 + 20] ELSE [] END) AS s
              FROM orders_full WHERE o_orderkey % 64 >= 1),
    ins AS (SELECT *, unnest([{key} % 64 + 7] || CASE WHEN {key} % 3 = 0 THEN [{key} % 64 + 30] ELSE [] END) AS s FROM {table} WHERE {key} % 64 >= 1),
    all_rows AS (SELECT *, 0 AS s FROM {table} UNION ALL SELECT * FROM ins WHERE s <= {sets})
    SELECT * EXCLUDE (s) FROM all_rows r WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.k = r.{key} AND d.s >= r.s AND d.s <= {sets})"""


@register("refresh_run_orders", dates_as_text(with_fixtures(_RUN_SQL.format(table="orders_full", key="o_orderkey", sets=RUN_SETS), "orders_full"), *ORDER_DATES))
def q_refresh_run_orders(spark, sf_dir):
    """Orders after 50 ordered sets with re-inserted keys, compacted to their net change and applied once."""
    def run(o):
        ins, dels = refresh.run_of_sets(o, "o_orderkey", RUN_SETS)
        return refresh.apply_net(o, *refresh.net_change(ins, dels, "o_orderkey"), "o_orderkey")

    return fixtures.orders(spark, sf_dir, run)


@register("refresh_run_lineitem", dates_as_text(with_fixtures(_RUN_SQL.format(table="lineitem_full", key="l_orderkey", sets=RUN_SETS), "orders_full", "lineitem_full"), *LINE_DATES))
def q_refresh_run_lineitem(spark, sf_dir):
    """The lines of the same run of sets."""
    _, dels = refresh.run_of_sets(fixtures.orders(spark, sf_dir), "o_orderkey", RUN_SETS)

    def run(li):
        ins, _ = refresh.run_of_sets(li, "l_orderkey", RUN_SETS)
        return refresh.apply_net(li, *refresh.net_change(ins, dels, "l_orderkey"), "l_orderkey")

    return fixtures.lineitem(spark, sf_dir, run)


@register("refresh_ranges_orders", dates_as_text(with_fixtures(f"""
    , n AS (SELECT {RANGE_SET - 1} * greatest(count(*) // 1000, 1) AS lo, {RANGE_SET} * greatest(count(*) // 1000, 1) - 1 AS hi FROM orders_full)
    SELECT * EXCLUDE (lo, hi) REPLACE (((o_orderkey >> 3) << 5) | (o_orderkey & 7) | CASE WHEN o_orderkey BETWEEN lo AND hi THEN 8 ELSE 0 END AS o_orderkey)
    FROM orders_full, n""", "orders_full"), *ORDER_DATES))
def q_refresh_ranges_orders(spark, sf_dir):
    """A set of neighbouring keys applied to a stored table, rewriting only the key ranges that it touches."""
    import uuid

    from shoal.session import checkpoint_dir
    o = fixtures.orders(spark, sf_dir)
    n = max(o.count() // 1000, 1)
    some = o.filter(F.col("o_orderkey").between((RANGE_SET - 1) * n, RANGE_SET * n - 1))
    path = f"{checkpoint_dir(spark)}/ranges-{uuid.uuid4().hex}"
    refresh.write_ranges(refresh.sparse_form(o, "o_orderkey"), "o_orderkey", RANGE_WIDTH, path)
    refresh.refresh_ranges(spark, path, "o_orderkey", RANGE_WIDTH, some.withColumn("o_orderkey", K.sparse_key(F.col("o_orderkey"), 1)),
                           refresh.sparse_form(some, "o_orderkey").select("o_orderkey"))
    return spark.read.schema(o.schema).parquet(path).select(*o.columns)


@register("copy_diff", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4999 = 7 THEN 'missing' ELSE 'changed' END AS status FROM orders WHERE o_orderkey % 4999 = 7 OR o_orderkey % 6007 = 11
    UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders), 'extra' FROM orders WHERE o_orderkey % 7001 = 3""")
def q_copy_diff(spark, sf_dir):
    """Keys that differ between orders and an altered copy, by hash trees over key ranges and a read of the differing ranges."""
    import uuid

    from shoal.operators import hashtree
    from shoal.session import checkpoint_dir
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    top = o.agg(F.max(k)).first()[0] + 1
    other = (o.filter(k % 4999 != 7).withColumn("o_totalprice", F.expr("o_totalprice + IF(o_orderkey % 6007 = 11, 1, 0)"))
             .unionByName(o.filter(k % 7001 == 3).withColumn("o_orderkey", k + top)))
    root = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    nodes, _ = hashtree.differing_leaves(hashtree.build_tree(o, "o_orderkey", f"{root}/a"), hashtree.build_tree(other, "o_orderkey", f"{root}/b"))
    return hashtree.copy_diff(o, other, "o_orderkey", nodes)


# --------------------------------------------------------------------------- windows, heads, chunks (E, F)
from shoal.operators import windows  # noqa: E402

HEAD_N = 5
KEYS2 = {t: (k + [None])[:2] for t, k in PRIMARY_KEYS.items()}


def _key_cols(k1: str, k2: str | None):
    """The primary key as text: ``k1`` or ``k1|k2``."""
    return [F.concat_ws("|", *[F.col(k).cast("string") for k in (k1, k2) if k]).alias("pk")]


def _key_sql(k1: str, k2: str | None) -> str:
    return f"CAST({k1} AS VARCHAR)" + (f" || '|' || CAST({k2} AS VARCHAR)" if k2 else "") + " AS pk"


@register("head_per_table", with_fixtures("\nUNION ALL\n".join(
    f"(SELECT {_q(t)} AS tbl, {_key_sql(k1, k2)} "
    f"FROM {t}_full ORDER BY {k1}{', ' + k2 if k2 else ''} LIMIT {HEAD_N})"
    for t, (k1, k2) in KEYS2.items()), *ALL_FULL))
def q_head(spark, sf_dir):
    """first rows of every table by primary key (a top-n per table)."""
    t = T(spark, sf_dir)
    return windows.union_all([
        windows.first_rows(t[name], [k for k in (k1, k2) if k], HEAD_N)
        .select(F.lit(name).alias("tbl"), *_key_cols(k1, k2))
        for name, (k1, k2) in KEYS2.items()])


@register("last_row_per_table", with_fixtures("\nUNION ALL\n".join(
    f"(SELECT {_q(t)} AS tbl, {_key_sql(k1, k2)} "
    f"FROM {t}_full ORDER BY {k1} DESC{', ' + k2 + ' DESC' if k2 else ''} LIMIT 1)"
    for t, (k1, k2) in KEYS2.items()), *ALL_FULL))
def q_last(spark, sf_dir):
    """The last row of every table (a global max over a struct, no sort)."""
    t = T(spark, sf_dir)
    return windows.union_all([
        windows.last_row(t[name], [k for k in (k1, k2) if k])
        .select(F.lit(name).alias("tbl"), *_key_cols(k1, k2))
        for name, (k1, k2) in KEYS2.items()])


TRIM_N = 3
TRIM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("trim_per_group", with_fixtures(f"""
    SELECT l_shipmode, l_orderkey, l_linenumber, l_partkey, l_suppkey, rn FROM (
        SELECT l_shipmode, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CAST(row_number() OVER (PARTITION BY l_shipmode ORDER BY {', '.join(TRIM_ORDER)}) AS INTEGER) AS rn
        FROM lineitem_full) t
    WHERE rn <= {TRIM_N}""", "lineitem_full"))
def q_trim(spark, sf_dir):
    """First lines of each group (ship mode); a partial group limit runs before the shuffle."""
    li = fixtures.lineitem(spark, sf_dir).select("l_shipmode", *TRIM_ORDER)
    return windows.head_per_group(li, ["l_shipmode"], TRIM_ORDER, TRIM_N)


TOP_N = 100


@register("top_orders", with_fixtures(f"""
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate
    FROM orders_full ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP_N}""", "orders_full"))
def q_top_orders(spark, sf_dir):
    """the query row limit (Q18's default 100) as an ordered top-k with a key tie-break."""
    o = fixtures.orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderdate")
    return windows.first_rows(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], TOP_N)


CHUNKS = 4
SEGMENTS = 3


@register("chunk_assign", with_fixtures(f"""
    SELECT o_orderkey,
           CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // {CHUNKS}) + 1,
                      {CHUNKS}) AS INTEGER) AS chunk
    FROM orders_full""", "orders_full"))
def q_chunks(spark, sf_dir):
    """Chunk of C for every order (distributed row number, remainder to the last chunk)."""
    o = fixtures.orders(spark, sf_dir).select("o_orderkey")
    return windows.assign_chunks(o, ["o_orderkey"], CHUNKS)


@register("segment_insert", with_fixtures(f"""
    SELECT o_orderkey, CAST(ntile({SEGMENTS}) OVER (ORDER BY o_orderkey) AS INTEGER) AS segment
    FROM orders_full""", "orders_full"))
def q_segment_insert(spark, sf_dir):
    """E5: all orders split into contiguous insert-file segments (ntile: extra rows to the first)."""
    o = fixtures.orders(spark, sf_dir).select("o_orderkey")
    return windows.assign_segments(o, ["o_orderkey"], SEGMENTS, "insert")


@register("segment_delete", with_fixtures(f"""
    SELECT o_orderkey,
           CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // {SEGMENTS} + 1) + 1
                AS INTEGER) AS segment
    FROM orders_full""", "orders_full"))
def q_segment_delete(spark, sf_dir):
    """E5: all order keys split into delete-file segments ((rn-1) div (n div S + 1))."""
    keys = fixtures.orders(spark, sf_dir).select("o_orderkey")
    return windows.assign_segments(keys, ["o_orderkey"], SEGMENTS, "delete")


@register("column_unpivot", with_fixtures("""
    SELECT o_orderkey, column_name, value FROM (
        UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
                        CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
                        o_orderpriority, o_clerk, CAST(o_shippriority AS VARCHAR) AS o_shippriority, o_comment
                 FROM orders_full)
        ON COLUMNS(* EXCLUDE (o_orderkey)) INTO NAME column_name VALUE value)""", "orders_full"))
def q_unpivot(spark, sf_dir):
    """One row per (order, column) -- the per-column split, as text."""
    from shoal.sources.tables import unpivot_columns
    return unpivot_columns(fixtures.orders(spark, sf_dir), ["o_orderkey"]).withColumnRenamed("column", "column_name")


# --------------------------------------------------------------------------- key arithmetic
from shoal.functions import keys as K  # noqa: E402


@register("retail_price", with_fixtures("""
    SELECT p_partkey,
           CAST(90000 + ((p_partkey + 1) // 10) % 20001 + ((p_partkey + 1) % 1000) * 100 AS BIGINT) AS retail_cents,
           CAST(90000 + ((p_partkey + 1) // 10) % 20001 + ((p_partkey + 1) % 1000) * 100 AS DOUBLE) / 100
               AS retail_price
    FROM part_full""", "part_full"))
def q_retail(spark, sf_dir):
    """Generator retail price of every part (1-based key = p_partkey + 1)."""
    p = fixtures.part(spark, sf_dir).select("p_partkey")
    cents = K.retail_price_cents(F.col("p_partkey") + 1).cast("long")
    return p.select("p_partkey", cents.alias("retail_cents"), (cents.cast("double") / 100).alias("retail_price"))


@register("sparse_key", """
    SELECT o_orderkey,
           ((o_orderkey >> 3) << 5) | (o_orderkey & 7) AS sparse_base,
           ((o_orderkey >> 3) << 5) | (1 << 3) | (o_orderkey & 7) AS sparse_refresh
    FROM orders""")
def q_sparse(spark, sf_dir):
    """Sparse order keys for base rows (sequence 0) and the first refresh (sequence 1)."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return o.select("o_orderkey", K.sparse_key(F.col("o_orderkey"), 0).alias("sparse_base"),
                    K.sparse_key(F.col("o_orderkey"), 1).alias("sparse_refresh"))


@register("partsupp_bridge", with_fixtures("""
    SELECT ps_partkey, ps_suppkey, ps_availqty, CAST(ps_supplycost AS DOUBLE) AS ps_supplycost
    FROM partsupp_full""", "partsupp_full"))
def q_partsupp(spark, sf_dir):
    """Four supplier slots per part through the bridge formula."""
    return fixtures.partsupp(spark, sf_dir).select("ps_partkey", "ps_suppkey", "ps_availqty", "ps_supplycost")


@register("active_customer_key", """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_custkey % 3 <> 0 THEN o_custkey
                WHEN least(o_custkey + 1, m) % 3 <> 0 THEN least(o_custkey + 1, m)
                ELSE least(o_custkey + 1, m) - 1 END AS active_custkey
    FROM orders, (SELECT max(c_custkey) AS m FROM customer) mx""")
def q_active_customer(spark, sf_dir):
    """Order customer key moved off every third customer (clamped at the max key)."""
    top = load(spark, sf_dir, "customer").select(F.max("c_custkey")).scalar()
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", "o_custkey", K.active_customer(F.col("o_custkey"), top).alias("active_custkey"))


# --------------------------------------------------------------------------- distributions
DIST_SOURCES = [("o_oprio", "orders", "o_orderpriority"), ("rflag", "lineitem", "l_returnflag"),
                ("smode", "lineitem", "l_shipmode"), ("msegmnt", "customer", "c_mktsegment"),
                ("p_types", "part", "p_type"), ("brands", "part", "p_brand")]


def _distributions(spark, sf_dir) -> DataFrame:
    t = T(spark, sf_dir)
    return windows.union_all([windows.value_distribution(t[tbl], col, name)
                              for name, tbl, col in DIST_SOURCES])


_DIST_SQL = "\nUNION ALL\n".join(
    f"SELECT {_q(name)} AS dist, CAST(row_number() OVER (ORDER BY {col}) AS INTEGER) AS pos, {col} AS text, "
    f"count(*) AS weight FROM {tbl}_full GROUP BY {col}" for name, tbl, col in DIST_SOURCES)


@register("dist_cumulative", with_fixtures(f"""
    , dists AS ({_DIST_SQL})
    SELECT dist, pos, text, weight,
           CAST(sum(weight) OVER (PARTITION BY dist ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS BIGINT) AS cum
    FROM dists""", "orders_full", "lineitem_full", "customer_full", "part_full"))
def q_dist_cum(spark, sf_dir):
    """Weighted value lists from the data, with running weights."""
    return windows.cumulative_weights(_distributions(spark, sf_dir))


@register("weighted_pick", with_fixtures("""
    , d AS (SELECT text, weight,
                   sum(weight) OVER (ORDER BY text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM (SELECT o_orderpriority AS text, count(*) AS weight FROM orders_full GROUP BY o_orderpriority) v),
      c AS (SELECT c_custkey, CAST(c_custkey % (SELECT sum(weight) FROM d) + 1 AS BIGINT) AS draw
            FROM customer_full)
    SELECT c_custkey, draw, text AS picked FROM c JOIN d ON draw > cum - weight AND draw <= cum""",
    "orders_full", "customer_full"))
def q_weighted_pick(spark, sf_dir):
    """Each customer draws an order priority with the data's own weights."""
    from shoal.functions.draws import weighted_pick
    t = T(spark, sf_dir)
    dist = windows.cumulative_weights(windows.value_distribution(t["orders"], "o_orderpriority", "o_oprio"))
    total = dist.select(F.sum("weight")).scalar()
    cust = t["customer"].select("c_custkey", (F.col("c_custkey") % total + 1).alias("draw"))
    return weighted_pick(cust, "draw", dist, total)


# --------------------------------------------------------------------------- date dimension
from shoal.functions import dates as D  # noqa: E402


@register("date_dimension", with_fixtures("""
    SELECT CAST(d - DATE '1970-01-01' + 1 AS INTEGER) AS t_timekey, strftime(d, '%Y-%m-%d') AS t_alpha,
           CAST(year(d) AS INTEGER) AS t_year, CAST((year(d) - 1970) * 12 + month(d) AS INTEGER) AS t_month,
           CAST((dayofyear(d) + 2) // 7 + 1 AS INTEGER) AS t_week, CAST(day(d) AS INTEGER) AS t_day,
           CAST((year(d) - 1900) * 1000 + dayofyear(d) AS INTEGER) AS julian
    FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d
          FROM orders_full) s""", "orders_full"))
def q_date_dim(spark, sf_dir):
    """One row per day of the order-date span, with generator date parts and day numbers."""
    o = fixtures.orders(spark, sf_dir)
    span = o.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.select(*D.date_parts(F.col("d")), D.julian(F.col("d")).cast("int").alias("julian"))


# --------------------------------------------------------------------------- run logs
from shoal.plans import runs  # noqa: E402
from shoal.sources import runlogs  # noqa: E402

_RX = runlogs.LATENCY_REGEX
_TS = "strftime(ts, '%y/%m/%d %H:%M:%S')"
LATENCY_CTES = f"""
    lat_lines AS (
        SELECT 'run' || CAST(user_id % 4 AS VARCHAR) AS run,
               CASE WHEN event_id % 2 = 0 THEN 'shuffle' ELSE 'noshuffle' END AS mode,
               'scale' || CAST(user_id AS VARCHAR) || '.log' AS name, event_id AS line_no,
               CASE WHEN event_type = 'error'
                    THEN {_TS} || ' ERROR TaskSetManager: Lost task 0.0 in stage 1.0'
                    ELSE {_TS} || ' INFO TpchQuery: End executing query. Time: '
                         || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) || '.' || CAST(event_id % 4 * 25 AS VARCHAR)
                         || CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END END AS value
        FROM events),
    lat_parsed AS (
        SELECT run, mode, name, line_no, TRY_CAST(regexp_extract(value, '{_RX}', 4) AS DOUBLE) AS elapsed_ms
        FROM lat_lines WHERE regexp_matches(value, '{_RX}') AND TRY_CAST(regexp_extract(value, '{_RX}', 4) AS DOUBLE) IS NOT NULL),
    files AS (
        SELECT run, mode, name, arg_max(elapsed_ms, line_no) AS latency_ms
        FROM lat_parsed GROUP BY run, mode, name)"""

TRANSFER_CTES = """
    tr_lines AS (
        SELECT 'run' || CAST(user_id % 4 AS VARCHAR) AS run,
               'workerLoad_' || CAST(event_id % 2 AS VARCHAR) || '.tsv' AS name, event_id AS line_no,
               CAST(epoch_us(ts) // 1000 AS VARCHAR) AS f1,
               CAST(CAST(floor(value * 1000000) AS BIGINT) AS VARCHAR) AS f3,
               CAST(user_id % 8 AS VARCHAR) || '@host' AS f4, event_type, event_id
        FROM events),
    tr_text AS (
        SELECT run, name, line_no,
               CASE WHEN event_type = 'error' THEN f1 || chr(9) || '0'
                    WHEN event_id % 5 = 0 THEN f1 || chr(9) || '0' || chr(9) || f3
                    ELSE f1 || chr(9) || '0' || chr(9) || f3 || chr(9) || f4 END AS value
        FROM tr_lines),
    tr_parsed AS (
        SELECT run, name, line_no, CAST(string_split(value, chr(9))[1] AS BIGINT) AS epoch_ms,
               CAST(string_split(value, chr(9))[1] AS BIGINT) // 1000 AS second,
               CAST(string_split(value, chr(9))[3] AS BIGINT) AS bytes,
               CASE WHEN len(string_split(value, chr(9))) = 3 THEN -1
                    ELSE CAST(string_split(string_split(value, chr(9))[4], '@')[1] AS INTEGER) END AS pid
        FROM tr_text WHERE len(string_split(value, chr(9))) >= 3),
    per_second AS (
        SELECT run, pid, second, CAST(sum(bytes) AS BIGINT) AS bytes FROM tr_parsed GROUP BY run, pid, second)"""

MBPS_SQL = "CAST(floor(CAST(bytes AS DOUBLE) / 1048576 * 8 * 1024 * 1024 / 1000000) AS BIGINT)"


def _latency_files(spark, sf_dir) -> DataFrame:
    lines = runlogs.latency_lines_from_events(load(spark, sf_dir, "events"))
    return runs.file_latency(runlogs.parse_latency(lines))


def _transfer_parsed(spark, sf_dir) -> DataFrame:
    return runlogs.parse_transfer(runlogs.transfer_lines_from_events(load(spark, sf_dir, "events")))


@register("latency_by_run", f"""
    WITH {LATENCY_CTES},
    conc AS (SELECT run, CAST(pow(2, dense_rank() OVER (ORDER BY run) - 1) AS DOUBLE) AS concurrency
             FROM (SELECT DISTINCT run FROM files) r)
    SELECT run, mode, count(*) AS files, round(avg(latency_ms / 1000), 6) AS mean_s,
           round(stddev_pop(latency_ms / 1000), 6) AS std_s, any_value(concurrency) AS concurrency
    FROM files JOIN conc USING (run) GROUP BY run, mode""")
def q_latency_by_run(spark, sf_dir):
    """Latency mean and deviation per run and mode, with concurrency."""
    return runs.latency_by_run(_latency_files(spark, sf_dir))


@register("latency_gap", f"""
    WITH {LATENCY_CTES},
    firsts AS (SELECT run, arg_min(latency_ms, name) FILTER (WHERE mode = 'shuffle') AS shuffle_ms,
                      arg_min(latency_ms, name) FILTER (WHERE mode = 'noshuffle') AS noshuffle_ms
               FROM files GROUP BY run)
    SELECT run, shuffle_ms, noshuffle_ms,
           round_even((shuffle_ms - noshuffle_ms) / nullif(noshuffle_ms, 0.0), 4) AS gap
    FROM firsts""")
def q_latency_gap(spark, sf_dir):
    """Relative gap of the two modes per run (first file of each), half-even to 4 places."""
    return runs.latency_gap(_latency_files(spark, sf_dir))


@register("latency_box", f"""
    WITH {LATENCY_CTES},
    q AS (SELECT mode, count(*) AS n, quantile_cont(latency_ms, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q
          FROM files GROUP BY mode)
    SELECT mode, n, q[1] / 1000 AS p0, q[2] / 1000 AS p25, q[3] / 1000 AS p50, q[4] / 1000 AS p75,
           q[5] / 1000 AS p100
    FROM q""")
def q_latency_box(spark, sf_dir):
    """Five-number summary of file latencies per mode."""
    return runs.latency_box(_latency_files(spark, sf_dir))


BOX = [0.0, 0.25, 0.5, 0.75, 1.0]


@register("latency_sketch", f"""
    WITH {LATENCY_CTES}
    SELECT mode, n, p, true AS within_bound FROM (SELECT mode, count(*) AS n FROM files GROUP BY mode) m, (SELECT unnest({BOX}::DOUBLE[]) AS p) q""")
def q_latency_sketch(spark, sf_dir):
    """Box-plot quantiles from merged sketches per run, each held against its exact rank."""
    files = _latency_files(spark, sf_dir)
    found = runs.rank_errors(files, runs.sketched_quantiles(runs.latency_sketches(files), BOX))
    return found.select("mode", "n", "p", (F.col("error") <= runs.SKETCH_ERROR).alias("within_bound"))


@register("transfer_per_second", f"""
    WITH {TRANSFER_CTES}
    SELECT run, pid, second, bytes FROM per_second""")
def q_transfer_ps(spark, sf_dir):
    """Bytes per (run, process, second)."""
    return runs.transfer_per_second(_transfer_parsed(spark, sf_dir))


@register("transfer_totals", f"""
    WITH {TRANSFER_CTES}
    SELECT run, pid, CAST(sum(bytes) AS DOUBLE) / 1048576 AS total_mib, count(*) AS active_seconds,
           max({MBPS_SQL}) AS peak_mbps
    FROM per_second GROUP BY run, pid""")
def q_transfer_totals(spark, sf_dir):
    """Total MiB, active seconds and peak Mbps per process."""
    return runs.transfer_totals(runs.transfer_per_second(_transfer_parsed(spark, sf_dir)))


@register("footprint", f"""
    WITH {TRANSFER_CTES},
    series AS (SELECT run, pid, row_number() OVER (PARTITION BY run, pid ORDER BY second) - 1 AS idx,
                      {MBPS_SQL} AS mbps FROM per_second),
    lengths AS (SELECT run, pid, count(*) AS len FROM per_second GROUP BY run, pid),
    span AS (SELECT run, max(len) AS index_num FROM lengths GROUP BY run),
    grid AS (SELECT l.run, l.pid, unnest(generate_series(0, s.index_num)) AS idx
             FROM lengths l JOIN span s ON l.run = s.run)
    SELECT g.run, g.pid, g.idx, CAST(coalesce(se.mbps, 0) AS BIGINT) AS mbps
    FROM grid g LEFT JOIN series se ON g.run = se.run AND g.pid = se.pid AND g.idx = se.idx""")
def q_footprint(spark, sf_dir):
    """Per-process Mbps series, zero-padded to the longest + 1."""
    return runs.footprint(runs.transfer_per_second(_transfer_parsed(spark, sf_dir)))


@register("transfer_first_process", f"""
    WITH {TRANSFER_CTES},
    firstp AS (SELECT run, name, arg_min(pid, line_no) AS first_pid FROM tr_parsed GROUP BY run, name)
    SELECT t.run, string_split(string_split(t.name, '_')[2], '.')[1] AS file_tag, t.pid, t.second,
           CAST(sum(t.bytes) AS DOUBLE) / 1048576 AS mib
    FROM tr_parsed t JOIN firstp f ON t.run = f.run AND t.name = f.name AND t.pid = f.first_pid
    GROUP BY t.run, file_tag, t.pid, t.second""")
def q_first_process(spark, sf_dir):
    """The first process's per-second series in each transfer file."""
    return runs.first_process_series(_transfer_parsed(spark, sf_dir))


@register("stage_metrics", """
    SELECT 'app-' || CAST(user_id % 3 % 2 AS VARCHAR) AS application, CAST(user_id % 8 AS BIGINT) AS stage_id,
           CAST(event_id % 2 AS BIGINT) AS attempt, count(*) AS tasks,
           CAST(sum(floor(value * 1000)) AS BIGINT) AS run_time_ms,
           CAST(sum(floor(value * 900000)) AS BIGINT) AS cpu_time_ns,
           CAST(sum(floor(value * 3000)) AS BIGINT) AS remote_bytes_read,
           CAST(sum(floor(value * 4000)) AS BIGINT) AS local_bytes_read,
           CAST(sum(user_id) AS BIGINT) AS disk_spilled_bytes,
           CAST(sum(floor(value * 100)) AS BIGINT) AS gc_time_ms,
           CAST(sum(floor(value * 1000000)) AS BIGINT) AS shuffle_bytes_written,
           CAST(sum(floor(value * 2000000)) AS BIGINT) AS input_bytes,
           CAST(sum(user_id) AS BIGINT) AS input_records,
           CAST(0 AS BIGINT) AS spilled_bytes
    FROM events WHERE event_type <> 'view' GROUP BY user_id % 3 % 2, user_id % 8, event_id % 2""")
def q_stage_metrics(spark, sf_dir):
    """Event-log JSON (derived from events) parsed and summed per application, stage and attempt."""
    lines = runlogs.event_json_from_events(load(spark, sf_dir, "events"))
    return runs.stage_metrics(runlogs.parse_event_json(lines))


_A, _J, _N = runlogs.APP_STAGES, runlogs.JOB_STAGES, runlogs.NODE_STAGES


@register("stage_critical_path", f"""
    WITH RECURSIVE st AS (SELECT event_id // {_A} AS a, event_id % {_A} AS s, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events),
    -- totals and chains of the stages before stage i of each application, by stage number
    r AS (SELECT a, 1 AS i, [ms] AS totals, [[s]] AS chains FROM st WHERE s = 0
          UNION ALL
          SELECT a, i + 1, list_append(totals, ms + totals[p + 1]), list_append(chains, list_append(chains[p + 1], s))
          FROM (SELECT r.*, st.s, st.ms, CASE WHEN totals[(s - 1) // 2 + 1] > totals[(s - 1) // 3 + 1] THEN (s - 1) // 2 ELSE (s - 1) // 3 END AS p
                FROM r JOIN st ON r.a = st.a AND st.s = r.i)),
    l AS (SELECT a, totals, chains, list_position(totals, list_max(totals)) AS e FROM r QUALIFY row_number() OVER (PARTITION BY a ORDER BY i DESC) = 1),
    c AS (SELECT a, totals, unnest(chains[e]) AS s, unnest(range(len(chains[e]))) AS pos FROM l)
    SELECT 'app-' || c.a AS application, CAST(pos AS INTEGER) AS pos, c.s AS stage_id, c.s // {_J} AS job_id, ms, totals[c.s + 1] AS finish_ms,
           'Step ' || c.s // {_N} AS plan_node
    FROM c JOIN st ON c.a = st.a AND c.s = st.s""")
def q_stage_critical_path(spark, sf_dir):
    """A10: the slowest chain of stages of every application, with job and plan node, from whole event logs derived from events."""
    from shoal.plans import critical_path as cp
    return cp.critical_path(cp.parse(runlogs.app_log_from_events(load(spark, sf_dir, "events"))))


# --------------------------------------------------------------------------- generation
from shoal.functions import draws  # noqa: E402
from shoal.functions.text import text_pool  # noqa: E402
from shoal.generate import tables as G  # noqa: E402
from shoal.plans import gen_oracle  # noqa: E402
from shoal.plans.gen_oracle import ORACLE as GEN_ORACLE  # noqa: E402


def _sizes(spark, sf_dir) -> dict[str, int]:
    """Rows of the given tables (metadata counts): what generated links point at."""
    return {t: load(spark, sf_dir, t).count() for t in ("supplier", "customer", "part", "orders")}


def _gen(name: str, source: str, key: str):
    def run(spark, sf_dir):
        sizes = _sizes(spark, sf_dir)
        sf = sizes["orders"] / G.BASE["orders"]
        keys = load(spark, sf_dir, source).select((F.col(key) + 1).alias("k"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if name in ("orders", "lineitem"):
            o, li = G.orders_and_lineitem(spark, sf, n, key_source=keys, sizes=sizes)
            return o if name == "orders" else li
        if name == "partsupp":
            return G.partsupp(spark, sf, n, key_source=keys, sizes=sizes)
        return {"supplier": G.supplier, "customer": G.customer, "part": G.part}[name](spark, sf, n, key_source=keys)
    run.__doc__ = f"I-jobs: {name} rows regenerated for every key of the given {source} table."
    return run


for _name, _src, _key in (("supplier", "supplier", "s_suppkey"), ("customer", "customer", "c_custkey"),
                          ("part", "part", "p_partkey"), ("partsupp", "part", "p_partkey"),
                          ("orders", "orders", "o_orderkey"), ("lineitem", "orders", "o_orderkey")):
    register(f"gen_{_name}", GEN_ORACLE[f"gen_{_name}"]())(_gen(_name, _src, _key))


@register("gen_refresh", GEN_ORACLE["gen_refresh"]())
def q_gen_refresh(spark, sf_dir):
    """Refresh set 1 over the given orders, inserts and delete keys tagged."""
    sizes = _sizes(spark, sf_dir)
    keys = load(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("k"))
    o, li, dels = G.refresh_set(spark, sizes["orders"] / G.BASE["orders"], 1, key_source=keys, sizes=sizes)
    return (o.select(F.lit("insert_orders").alias("part"), F.col("o_orderkey").alias("key"))
            .unionByName(li.select(F.lit("insert_lineitem").alias("part"), F.col("l_orderkey").alias("key")))
            .unionByName(dels.select(F.lit("delete").alias("part"), F.col("o_orderkey").alias("key"))))


#: a pool too large to broadcast, and a distance at which a 31-bit generator repeats itself
LARGE_POOL, FAR = 9 << 20, (1 << 31) - 1


@register("gen_comments_sharded", gen_oracle.comments(LARGE_POOL))
def q_gen_comments_sharded(spark, sf_dir):
    """Order comments from a pool beyond the broadcast bound, joined by chunk."""
    keys = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + 1).alias("k"))
    row = keys.select("o_orderkey", *(c.alias(n) for c, n in zip(draws.jump(F.col("k")), G.ROW, strict=True)))
    return G._with_text(row, "o_comment", text_pool(spark, LARGE_POOL)).select("o_orderkey", "o_comment")


@register("gen_word_in_noise", gen_oracle.embedded("Complaints"))
def q_gen_word_in_noise(spark, sf_dir):
    """A word written over the text of every order at a drawn place."""
    from shoal.functions.text import embed
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), "o_orderpriority").alias("c"),
                                             *(x.alias(n) for x, n in zip(draws.jump(F.col("o_orderkey") + 1), G.ROW, strict=True)))
    return o.select("o_orderkey", embed(F.col("c"), F.lit("Complaints"), G.S["s_bbb"], G._state()).alias("noise"))


@register("chunked_output", f"""
    SELECT c_custkey + 1 AS custkey, CAST(least(c_custkey // greatest((SELECT count(*) FROM customer) // {CHUNKS}, 1) + 1, {CHUNKS}) AS INTEGER) AS chunk
    FROM customer""")
def q_chunked_output(spark, sf_dir):
    """Customer keys written in chunks of a dense key, a folder per chunk, and read back."""
    import uuid

    from shoal.session import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    G.write_chunked(load(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("custkey")), "custkey", CHUNKS, path)
    return spark.read.schema("custkey long, chunk int").parquet(path)


@register("gen_far_draws", gen_oracle.far_draws(FAR))
def q_gen_far_draws(spark, sf_dir):
    """I16: the draws of every order key and of the key 2^31 - 1 further on."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    one, two = draws.jump(F.col("key")), draws.jump(F.col("key") + FAR)
    o = o.select("key", *(c.alias(f"_a{k}") for k, c in enumerate(one)), *(c.alias(f"_b{k}") for k, c in enumerate(two)))
    at = draws.position(G.S["o_cust"])
    return o.select("key", *(draws.draw((F.col(f"_{c}0"), F.col(f"_{c}1")), at).alias(n) for c, n in (("a", "near_draw"), ("b", "far_draw"))))


@register("promo_effect_by_month", Q14_ORACLE)
def q_promo_effect_by_month(spark, sf_dir):
    """Q14a over lineitem stored by month, pruned at run time by days of the date dimension."""
    import uuid

    from shoal.operators.months import of_days, write_by_month
    from shoal.session import checkpoint_dir
    path, start = f"{checkpoint_dir(spark)}/months-{uuid.uuid4().hex}", F.lit("1997-09-01").cast("date")
    write_by_month(fixtures.lineitem(spark, sf_dir), "l_shipdate", path)
    days = G.date_dimension(spark).select(F.to_date("t_alpha").alias("d")).filter((F.col("d") >= start) & (F.col("d") < F.add_months(start, 1)))
    return tpch.promo_effect({"lineitem": of_days(spark.read.parquet(path), days), "part": fixtures.part(spark, sf_dir)}, "1997-09-01")


# --------------------------------------------------------------------------- query parameters (M2, M6)
from shoal.plans import params as P  # noqa: E402

PARAM_FIXTURES = ("region_full", "nation_full", "customer_full", "part_full", "lineitem_full", "supplier_full")


@register("param_draws", with_fixtures(P.draw_params_sql(), *PARAM_FIXTURES))
def q_param_draws(spark, sf_dir):
    """M2: substitution parameters of the 22 queries for 41 streams, drawn from the data's domains."""
    return P.draw_params(T(spark, sf_dir))


@register("param_log", f"""
    SELECT stream, query,
           CAST(query AS VARCHAR) || chr(9) || string_agg(value, chr(9) ORDER BY n) AS line
    FROM ({with_fixtures(P.draw_params_sql(), *PARAM_FIXTURES)}) d
    GROUP BY stream, query""")
def q_param_log(spark, sf_dir):
    """M6: one log line per stream and query: number, then values tab-separated."""
    return P.param_log(P.draw_params(T(spark, sf_dir)))


# --------------------------------------------------------------------------- pipe-text connector (A1-A5)
@register("tbl_roundtrip", dates_as_text(with_fixtures("SELECT * FROM orders_full", "orders_full"), "o_orderdate"))
def q_tbl_roundtrip(spark, sf_dir):
    """A1-A5: the orders table written as pipe-delimited text (trailing separator) into the
    shared checkpoint folder and read back with its DDL schema."""
    import os
    import uuid

    from shoal.session import checkpoint_dir
    from shoal.sources.tables import read_tbl, write_tbl
    path = os.path.join(checkpoint_dir(spark), "tbl", f"orders-{uuid.uuid4().hex[:8]}.tbl")
    write_tbl(fixtures.orders(spark, sf_dir), path)
    return read_tbl(spark, path, "orders")


TEXT_DATES = ("o_orderdate", "l_shipdate", "l_commitdate", "l_receiptdate")


def _text_folder(spark, name: str) -> str:
    import os
    import uuid

    from shoal.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "tbl", f"{name}-{uuid.uuid4().hex[:8]}.tbl")


def _through_text(spark, sf_dir, name: str) -> DataFrame:
    from shoal.sources.tables import read_tbl, write_tbl
    path = _text_folder(spark, name)
    write_tbl(fixtures.table(spark, sf_dir, name), path)
    return read_tbl(spark, path, name)


@register("join_from_text", dates_as_text(with_fixtures(
    "SELECT * FROM orders_full, lineitem_full WHERE l_orderkey = o_orderkey", "orders_full", "lineitem_full"), *TEXT_DATES))
def q_join_from_text(spark, sf_dir):
    """The measured join with both tables read from pipe-delimited text, all 25 columns."""
    return tpch.join_orders_lineitem(_through_text(spark, sf_dir, "orders"), _through_text(spark, sf_dir, "lineitem"))


@register("text_checksums", with_fixtures(_CHECKSUMS, *ALL_FULL))
def q_text_checksums(spark, sf_dir):
    """A1-A5: all eight tables through pipe-delimited text have the checksums of the tables themselves."""
    return quality.table_checksum({t: _through_text(spark, sf_dir, t) for t in SCHEMAS})


@register("dist_file_roundtrip", with_fixtures(f"SELECT * FROM ({_DIST_SQL}) d", "orders_full", "lineitem_full", "customer_full", "part_full"))
def q_dist_file(spark, sf_dir):
    """Weighted value lists of the data written as distribution files and read back."""
    from shoal.sources.tables import read_distributions, write_distributions
    path = _text_folder(spark, "dists")
    write_distributions(_distributions(spark, sf_dir), path)
    return read_distributions(spark, path + "/*")


REFRESH_SEGMENTS = 3
_SEGS = f"CAST(ntile({REFRESH_SEGMENTS}) OVER (ORDER BY {{}}) AS INTEGER)"


@register("refresh_files", with_fixtures(f"""
    , ins AS (SELECT {_SPARSE.format(k='o_orderkey', seq=1)} AS key, o_orderkey AS k, {_SEGS.format('o_orderkey')} AS segment
              FROM orders_full WHERE o_orderkey % {REFRESH_MODULUS} = 1),
    del AS (SELECT {_SPARSE.format(k='o_orderkey', seq=0)} AS key, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n
            FROM orders_full WHERE o_orderkey % {REFRESH_MODULUS} = 0)
    SELECT 'orders' AS part, key, 7 AS refresh_set, segment FROM ins
    UNION ALL SELECT 'lineitem', ins.key, 7, segment FROM lineitem_full JOIN ins ON l_orderkey = k
    UNION ALL SELECT 'delete', key, 7, CAST((rn - 1) // (n // {REFRESH_SEGMENTS} + 1) + 1 AS INTEGER) FROM del""", "orders_full", "lineitem_full"))
def q_refresh_files(spark, sf_dir):
    """Refresh set 7 over the given orders, written as segmented insert and delete files and read back."""
    from shoal.sources.tables import read_refresh_deletes, read_refresh_inserts, write_refresh_set
    o, li = fixtures.orders(spark, sf_dir), fixtures.lineitem(spark, sf_dir)
    new = windows.assign_segments(refresh.insert_orders(o), ["o_orderkey"], REFRESH_SEGMENTS)
    lines = refresh.insert_lineitem(li).join(new.select(F.col("o_orderkey").alias("l_orderkey"), "segment"), "l_orderkey").select(*LINE_COLS, "segment")
    gone = windows.assign_segments(refresh.delete_keys(refresh.sparse_form(refresh.delete_keys(o), "o_orderkey"), 1, 0), ["o_orderkey"],
                                   REFRESH_SEGMENTS, "delete")
    folder = _text_folder(spark, "refresh")
    write_refresh_set(new, lines, gone, folder, 7, REFRESH_SEGMENTS)
    tagged = [(read_refresh_inserts(spark, folder, "orders"), "orders", "o_orderkey"), (read_refresh_inserts(spark, folder, "lineitem"), "lineitem", "l_orderkey"),
              (read_refresh_deletes(spark, folder), "delete", "o_orderkey")]
    return windows.union_all([df.select(F.lit(n).alias("part"), F.col(k).alias("key"), "refresh_set", "segment") for df, n, k in tagged])


# --------------------------------------------------------------------------- streaming (D8 incremental)
@register("transfer_per_second_stream", f"""
    WITH {TRANSFER_CTES}
    SELECT run, pid, second, bytes FROM per_second""")
def q_transfer_stream(spark, sf_dir):
    """D8 as a Structured Streaming query: transfer lines derived from events are written
    as text files per run, replayed in update mode, and the latest value per (run, pid,
    second) is read back -- equal to the batch result in whatever order files arrive."""
    import os
    import uuid

    from shoal.session import checkpoint_dir
    from shoal.streaming.transfer import replay
    base = os.path.join(checkpoint_dir(spark), "stream-replay", uuid.uuid4().hex[:8])
    lines = runlogs.transfer_lines_from_events(load(spark, sf_dir, "events"))
    lines.select("run", "value").write.partitionBy("run").text(os.path.join(base, "in"))
    return replay(spark, os.path.join(base, "in"), os.path.join(base, "out"),
                  f"transfer_{uuid.uuid4().hex[:8]}", layout="partitioned")
