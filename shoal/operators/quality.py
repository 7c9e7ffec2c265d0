"""Data-quality checks re-aimed from the DDL, the key constraints and the check scripts.

Every check is one aggregate job per table (or one anti join per foreign key)
and returns a small report DataFrame; none collects rows to the driver.

* ``not_null``        J1: NULL count per column (one pass per table, unpivoted)
* ``pk_violations``   J2/D17: duplicate primary keys
* ``fk_violations``   J3/C8: child rows without a parent; the child side is
                      pre-aggregated to one row per key before the shuffle, so
                      a hot key costs one row per task
* ``length_check``    J4: longest text per column against its CHAR/VARCHAR bound
* ``domain_check``    J5: min/max per column against the generator's domain
* ``order_rollup``    D16: order header (total, line count, status) from its lines
* ``order_header_check`` J7: rollup compared with the stored header
* ``table_checksum``  D19: row count and an order-free hash sum per table
* ``all_equal``       D18: one distinct value per group, as over runs ``at_degree``
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.generate import vocab
from shoal.sources.schemas import FOREIGN_KEYS, MAX_LENGTH, NULLABLE, PRIMARY_KEYS

# Generator domains per column (inclusive bounds).
DOMAINS: dict[str, dict[str, tuple]] = {
    "lineitem": {"l_quantity": (1, 50), "l_discount": (0.0, 0.10), "l_tax": (0.0, 0.08),
                 "l_linenumber": (1, 7), "l_shipdate": (dt.date(1992, 1, 2), dt.date(1998, 12, 1)),
                 "l_extendedprice": (900.0, 104950.0),
                 "l_commitdate": (dt.date(1992, 1, 31), dt.date(1998, 10, 31)),
                 "l_receiptdate": (dt.date(1992, 1, 3), dt.date(1998, 12, 31))},
    "orders": {"o_orderdate": (dt.date(1992, 1, 1), dt.date(1998, 8, 2)),
               "o_shippriority": (0, 0)},
    "part": {"p_size": (1, 50), "p_retailprice": (900.0, 2099.0)},
    "partsupp": {"ps_availqty": (1, 9999), "ps_supplycost": (1.0, 1000.0)},
    "supplier": {"s_acctbal": (-999.99, 9999.99)},
    "customer": {"c_acctbal": (-999.99, 9999.99)},
}

VALUE_LISTS: dict[str, dict[str, list[str]]] = {
    "lineitem": {"l_shipmode": vocab.SHIP_MODES, "l_shipinstruct": vocab.INSTRUCTIONS, "l_returnflag": ["R", "A", "N"], "l_linestatus": ["O", "F"]},
    "orders": {"o_orderpriority": vocab.PRIORITIES, "o_orderstatus": ["O", "F", "P"]},
    "customer": {"c_mktsegment": vocab.SEGMENTS},
    "part": {"p_type": vocab.PART_TYPES, "p_container": vocab.CONTAINERS},
    "region": {"r_name": vocab.REGIONS},
}
#: columns that hold a parent's key, by parent
LINKS: dict[str, dict[str, str]] = {
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    "orders": {"o_custkey": "customer"}, "partsupp": {"ps_partkey": "part", "ps_suppkey": "supplier"},
    "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "nation": {"n_regionkey": "region"},
}


ROWS_PER_TASK = 1 << 20     # that ``at_degree`` gives to one task
MOST_KEY_COLS = 2           # columns of the longest foreign key


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, column_name, nullable, null_count): one aggregate pass per table."""
    frames = []
    for name, df in tables.items():
        counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
        frames.append(counts.unpivot([], df.columns, "column_name", "null_count")
                      .select(F.lit(name).alias("tbl"), "column_name",
                              F.col("column_name").isin(*NULLABLE).alias("nullable"),
                              F.coalesce("null_count", F.lit(0)).cast("long").alias("null_count")))
    return _union(frames)


def pk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, dup_keys, dup_rows): keys seen more than once, and the rows they hold."""
    frames = []
    for name, df in tables.items():
        keys = PRIMARY_KEYS[name]
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        frames.append(per_key.agg(F.count(F.lit(1)).alias("dup_keys"),
                                  F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("dup_rows"))
                      .select(F.lit(name).alias("tbl"), "dup_keys", "dup_rows"))
    return _union(frames)


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, child_cols, parent, orphan_keys, orphan_rows) per foreign key.

    Each child is read once, whatever its number of foreign keys: a row gives one tagged
    key for each, equal keys are counted map-side, and one anti join meets all parents' keys.
    """
    checks = [(i, *fk) for i, fk in enumerate(FOREIGN_KEYS) if fk[0] in tables and fk[2] in tables]

    def key(i: int, cols: list[str]) -> Column:
        parts = [F.col(c).cast("long") for c in cols] + [F.lit(0).cast("long")] * (MOST_KEY_COLS - len(cols))
        return F.struct(F.lit(i).alias("fk"), *(p.alias(f"k{j}") for j, p in enumerate(parts)))

    held, parents = [], []
    for name in dict.fromkeys(c[1] for c in checks):
        keys = [key(i, ccols) for i, child, ccols, _, _ in checks if child == name]
        held.append(tables[name].select(F.inline(F.array(*keys))))
    for name in dict.fromkeys(c[3] for c in checks):
        keys = [key(i, pcols) for i, _, _, parent, pcols in checks if parent == name]
        parents.append(tables[name].select(F.inline(F.array(*keys))))
    by = ["fk", *(f"k{j}" for j in range(MOST_KEY_COLS))]
    per_key = _union(held).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(_union(parents), by, "left_anti").groupBy("fk").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
    names = next(iter(tables.values())).sparkSession.createDataFrame(
        [(i, child, ",".join(ccols), parent) for i, child, ccols, parent, _ in checks], "fk int, child string, child_cols string, parent string")
    return (names.join(orphans, "fk", "left")
            .select("child", "child_cols", "parent", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("orphan_keys", "orphan_rows"))))


def length_check(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, column_name, max_len, bound, over_bound) per text column."""
    frames = []
    for name, df in tables.items():
        bounds = {c: b for c, b in MAX_LENGTH.get(name, {}).items() if c in df.columns}
        if not bounds:
            continue
        aggs = []
        for c, b in bounds.items():
            aggs += [F.max(F.length(c)).alias(f"{c}__max"),
                     F.sum((F.length(c) > b).cast("long")).alias(f"{c}__over")]
        row = df.agg(*aggs)
        stack = F.expr("stack({}, {})".format(
            len(bounds), ", ".join(f"'{c}', {b}, `{c}__max`, `{c}__over`" for c, b in bounds.items())))
        frames.append(row.select(stack.alias("column_name", "bound", "max_len", "over_bound"))
                      .select(F.lit(name).alias("tbl"), "column_name",
                              F.col("max_len").cast("long").alias("max_len"),
                              F.col("bound").cast("long").alias("bound"),
                              F.coalesce("over_bound", F.lit(0)).cast("long").alias("over_bound")))
    return _union(frames)


def _lit_str(v) -> str:
    return f"DATE'{v.isoformat()}'" if isinstance(v, dt.date) else repr(v)


def domain_check(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, column_name, min_value, max_value, lo, hi, out_of_range) as text."""
    frames = []
    for name, df in tables.items():
        doms = {c: b for c, b in DOMAINS.get(name, {}).items() if c in df.columns}
        if not doms:
            continue
        aggs = []
        for c, (lo, hi) in doms.items():
            col = F.col(c)
            outside = (col < F.lit(lo)) | (col > F.lit(hi))
            aggs += [F.min(col).cast("string").alias(f"{c}__min"),
                     F.max(col).cast("string").alias(f"{c}__max"),
                     F.sum(outside.cast("long")).alias(f"{c}__out")]
        row = df.agg(*aggs)
        stack = F.expr("stack({}, {})".format(len(doms), ", ".join(
            f"'{c}', '{lo}', '{hi}', `{c}__min`, `{c}__max`, `{c}__out`" for c, (lo, hi) in doms.items())))
        frames.append(row.select(stack.alias("column_name", "lo", "hi", "min_value", "max_value", "out_of_range"))
                      .select(F.lit(name).alias("tbl"), "column_name", "min_value", "max_value",
                              "lo", "hi", F.coalesce("out_of_range", F.lit(0)).cast("long").alias("out_of_range")))
    return _union(frames)


def order_rollup(lineitem: DataFrame) -> DataFrame:
    """Order header from its lines (D16): total charged price, line count, status.

    Status is F when every line is F, O when every line is O, P otherwise. One
    partial+final aggregate on the order key.
    """
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    agg = lineitem.groupBy("l_orderkey").agg(
        F.sum(charge).alias("total"),
        F.count(F.lit(1)).alias("lines"),
        F.sum((F.col("l_linestatus") == "F").cast("long")).alias("f_lines"),
        F.sum((F.col("l_linestatus") == "O").cast("long")).alias("o_lines"))
    status = (F.when(F.col("f_lines") == F.col("lines"), "F")
              .when(F.col("o_lines") == F.col("lines"), "O").otherwise("P"))
    return agg.select(F.col("l_orderkey").alias("orderkey"), "total", "lines", status.alias("status"))


def order_header_check(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row of counts comparing stored headers with their lines."""
    roll = order_rollup(lineitem)
    o = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    j = o.join(roll, F.col("o_orderkey") == F.col("orderkey"), "full_outer")
    has_o, has_l = F.col("o_orderkey").isNotNull(), F.col("orderkey").isNotNull()
    both = has_o & has_l
    return j.agg(
        F.sum((has_o & ~has_l).cast("long")).alias("orders_without_lines"),
        F.sum((has_l & ~has_o).cast("long")).alias("lines_without_order"),
        F.sum((both & ~F.col("lines").between(1, 7)).cast("long")).alias("bad_line_count"),
        F.sum((both & (F.col("o_orderstatus") != F.col("status"))).cast("long")).alias("status_mismatch"),
        # a stored total truncates cents twice per line (H21): allow 0.02 per line
        F.sum((both & (F.abs(F.col("o_totalprice") - F.col("total")) > F.col("lines") * F.lit(0.02)))
              .cast("long")).alias("price_mismatch"),
        F.sum(both.cast("long")).alias("orders_checked"))


def row_hash(cols: list[str]) -> Column:
    """The first 32 bits of the md5 of the row's values as text, joined by bars."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def table_checksum(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, row_count, checksum): order-free sum of row hashes (D19): the same for the same rows
    in any order, split or engine."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row_hash(df.columns)), F.lit(0)).alias("checksum"))
              .select(F.lit(name).alias("tbl"), "row_count", "checksum")
              for name, df in tables.items()]
    return _union(frames)


def at_degree(df: DataFrame, degree: int, lowest: int, rows: int) -> DataFrame:
    """``df`` (of ``rows`` rows) dealt out evenly to ``degree`` tasks, or to the same multiple of each
    degree by which at ``lowest``, the smallest compared, no task gets more than ``ROWS_PER_TASK``."""
    return df.repartition(degree * max(-(-rows // (lowest * ROWS_PER_TASK)), 1))


def out_of_list(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, column_name, out_of_list): values that the column's fixed list does not hold (J5). One pass per table."""
    frames = []
    for name, lists in VALUE_LISTS.items():
        if name in tables:
            row = tables[name].agg(*(F.count_if(~F.col(c).isin(values)).alias(c) for c, values in lists.items()))
            frames.append(row.unpivot([], list(lists), "column_name", "out_of_list").select(F.lit(name).alias("tbl"), "column_name", "out_of_list"))
    return _union(frames)


def key_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, column_name, out_of_range): links outside 0 .. rows of the parent - 1 (J5). One pass per table."""
    sizes = {t: tables[t].select(F.count(F.lit(1))).scalar() for t in {p for cols in LINKS.values() for p in cols.values()}}
    frames = []
    for name, cols in LINKS.items():
        row = tables[name].agg(*(F.count_if((F.col(c) < 0) | (F.col(c) >= sizes[p])).alias(c) for c, p in cols.items()))
        frames.append(row.unpivot([], list(cols), "column_name", "out_of_range").select(F.lit(name).alias("tbl"), "column_name", "out_of_range"))
    return _union(frames)


def all_equal(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """(group..., distinct_values, all_equal) -- the "same value in every run" check."""
    return (df.groupBy(*group_cols).agg(F.countDistinct(value_col).alias("distinct_values"))
            .withColumn("all_equal", F.col("distinct_values") == 1))
