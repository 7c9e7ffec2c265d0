"""The eight TPC-H table layouts, in file (DDL) order, with Spark types.

Keys are LongType (64-bit keys at large scale factors), money is
DecimalType(15,2), dates are DateType. ``CHAR``/``VARCHAR`` bounds are kept in
``MAX_LENGTH`` and enforced by a check, not by padding.
"""

from __future__ import annotations

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType,
                               StringType, StructField, StructType)

MONEY = DecimalType(15, 2)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, D, M = LongType(), IntegerType(), StringType(), DateType(), MONEY

REGION = _s(("r_regionkey", L, False), ("r_name", S, False), ("r_comment", S, True))
NATION = _s(("n_nationkey", L, False), ("n_name", S, False), ("n_regionkey", L, False),
            ("n_comment", S, True))
SUPPLIER = _s(("s_suppkey", L, False), ("s_name", S, False), ("s_address", S, False),
              ("s_nationkey", L, False), ("s_phone", S, False), ("s_acctbal", M, False),
              ("s_comment", S, False))
PART = _s(("p_partkey", L, False), ("p_name", S, False), ("p_mfgr", S, False),
          ("p_brand", S, False), ("p_type", S, False), ("p_size", I, False),
          ("p_container", S, False), ("p_retailprice", M, False), ("p_comment", S, False))
PARTSUPP = _s(("ps_partkey", L, False), ("ps_suppkey", L, False), ("ps_availqty", I, False),
              ("ps_supplycost", M, False), ("ps_comment", S, False))
CUSTOMER = _s(("c_custkey", L, False), ("c_name", S, False), ("c_address", S, False),
              ("c_nationkey", L, False), ("c_phone", S, False), ("c_acctbal", M, False),
              ("c_mktsegment", S, False), ("c_comment", S, False))
ORDERS = _s(("o_orderkey", L, False), ("o_custkey", L, False), ("o_orderstatus", S, False),
            ("o_totalprice", M, False), ("o_orderdate", D, False), ("o_orderpriority", S, False),
            ("o_clerk", S, False), ("o_shippriority", I, False), ("o_comment", S, False))
LINEITEM = _s(("l_orderkey", L, False), ("l_partkey", L, False), ("l_suppkey", L, False),
              ("l_linenumber", I, False), ("l_quantity", M, False), ("l_extendedprice", M, False),
              ("l_discount", M, False), ("l_tax", M, False), ("l_returnflag", S, False),
              ("l_linestatus", S, False), ("l_shipdate", D, False), ("l_commitdate", D, False),
              ("l_receiptdate", D, False), ("l_shipinstruct", S, False), ("l_shipmode", S, False),
              ("l_comment", S, False))

SCHEMAS: dict[str, StructType] = {
    "region": REGION, "nation": NATION, "supplier": SUPPLIER, "part": PART,
    "partsupp": PARTSUPP, "customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM,
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "partsupp": ["ps_partkey", "ps_suppkey"],
    "customer": ["c_custkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}

# (child table, child columns, parent table, parent columns)
FOREIGN_KEYS: list[tuple[str, list[str], str, list[str]]] = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("partsupp", ["ps_suppkey"], "supplier", ["s_suppkey"]),
    ("partsupp", ["ps_partkey"], "part", ["p_partkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey", "l_suppkey"], "partsupp", ["ps_partkey", "ps_suppkey"]),
]

# CHAR/VARCHAR bounds of the DDL.
MAX_LENGTH: dict[str, dict[str, int]] = {
    "region": {"r_name": 25, "r_comment": 152},
    "nation": {"n_name": 25, "n_comment": 152},
    "supplier": {"s_name": 25, "s_address": 40, "s_phone": 15, "s_comment": 101},
    "part": {"p_name": 55, "p_mfgr": 25, "p_brand": 10, "p_type": 25, "p_container": 10,
             "p_comment": 23},
    "partsupp": {"ps_comment": 199},
    "customer": {"c_name": 25, "c_address": 40, "c_phone": 15, "c_mktsegment": 10,
                 "c_comment": 117},
    "orders": {"o_orderstatus": 1, "o_orderpriority": 15, "o_clerk": 15, "o_comment": 79},
    "lineitem": {"l_returnflag": 1, "l_linestatus": 1, "l_shipinstruct": 25, "l_shipmode": 10,
                 "l_comment": 44},
}

# Columns allowed to be NULL (all others are NOT NULL in the DDL).
NULLABLE = {"n_comment", "r_comment"}
