"""DuckDB SQL for the correctness oracle.

``FIXTURES`` repeats the rules of ``shoal.sources.fixtures`` in DuckDB SQL, as
CTEs named ``<table>_full`` over the driver views. ``with_fixtures`` prefixes a
query with the CTEs it names. Outputs are normalised the same way on both
engines: money as DOUBLE after exact DECIMAL arithmetic, dates and timestamps
as ISO text, counts as BIGINT.
"""

from __future__ import annotations

from shoal.generate.vocab import CONTAINER_S1, CONTAINER_S2

FIXTURES: dict[str, str] = {
    "region_full": """
        SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name,
               'region ' || r_name AS r_comment
        FROM region""",
    "nation_full": """
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
               CAST(n_regionkey AS BIGINT) AS n_regionkey, 'nation ' || n_name AS n_comment
        FROM nation""",
    "supplier_full": """
        SELECT s_suppkey, s_name, 'Address ' || CAST(s_suppkey AS VARCHAR) AS s_address,
               CAST(s_nationkey AS BIGINT) AS s_nationkey,
               printf('%02d-%03d-%03d-%04d', s_nationkey + 10, s_suppkey % 900 + 100,
                      (s_suppkey * 7) % 900 + 100, (s_suppkey * 13) % 9000 + 1000) AS s_phone,
               CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal,
               'supplier ' || CAST(s_suppkey AS VARCHAR) AS s_comment
        FROM supplier""",
    "customer_full": """
        SELECT c_custkey, c_name, 'Address ' || CAST(c_custkey AS VARCHAR) AS c_address,
               CAST(c_nationkey AS BIGINT) AS c_nationkey,
               printf('%02d-%03d-%03d-%04d', c_nationkey + 10, c_custkey % 900 + 100,
                      (c_custkey * 7) % 900 + 100, (c_custkey * 13) % 9000 + 1000) AS c_phone,
               CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, c_mktsegment,
               'customer ' || CAST(c_custkey AS VARCHAR) AS c_comment
        FROM customer""",
    "part_full": f"""
        SELECT p_partkey, p_name, 'Manufacturer#' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS p_mfgr,
               p_brand, p_type, p_size,
               {CONTAINER_S1}[p_partkey % 5 + 1] || ' ' || {CONTAINER_S2}[(p_partkey // 5) % 8 + 1]
                   AS p_container,
               CAST(p_retailprice AS DECIMAL(15,2)) AS p_retailprice,
               'part ' || CAST(p_partkey AS VARCHAR) AS p_comment
        FROM part""",
    "partsupp_full": """
        SELECT p_partkey AS ps_partkey,
               CAST(((p_partkey + 1) + s * (ns // 4 + p_partkey // ns)) % ns AS BIGINT) AS ps_suppkey,
               CAST(((p_partkey + 1) * 7 + s * 13) % 9999 + 1 AS INTEGER) AS ps_availqty,
               CAST((((p_partkey + 1) * 31 + s * 17) % 99901 + 100) / 100 AS DECIMAL(15,2))
                   AS ps_supplycost,
               'partsupp ' || CAST(p_partkey AS VARCHAR) || ' ' || CAST(s AS VARCHAR) AS ps_comment
        FROM part, generate_series(0, 3) g(s), (SELECT count(*) AS ns FROM supplier) n""",
    "orders_full": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority,
               'Clerk#' || lpad(CAST(o_orderkey % 1000 + 1 AS VARCHAR), 9, '0') AS o_clerk,
               0 AS o_shippriority,
               CASE WHEN o_orderkey % 7 = 0 THEN 'the special packages requests'
                    ELSE 'furious deposits' END AS o_comment
        FROM orders""",
    "lineitem_full": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CAST(l_quantity AS DECIMAL(15,2)) AS l_quantity,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice,
               CAST(l_discount AS DECIMAL(15,2)) AS l_discount,
               CAST(l_tax AS DECIMAL(15,2)) AS l_tax,
               l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
               CAST(l_shipdate AS DATE) + CAST(h % 61 - 30 AS INTEGER) AS l_commitdate,
               CAST(l_shipdate AS DATE) + CAST((h * 13) % 30 + 1 AS INTEGER) AS l_receiptdate,
               ['DELIVER IN PERSON', 'COLLECT COD', 'TAKE BACK RETURN', 'NONE'][h % 4 + 1]
                   AS l_shipinstruct,
               ['REG AIR', 'AIR', 'RAIL', 'TRUCK', 'MAIL', 'FOB', 'SHIP'][h % 7 + 1] AS l_shipmode,
               'line ' || CAST(h AS VARCHAR) AS l_comment
        FROM (SELECT *, l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7 AS h FROM lineitem) t""",
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the fixture CTEs it uses (in dependency-free order)."""
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def dates_as_text(sql: str, *date_cols: str) -> str:
    """Wrap ``sql`` so the named DATE columns come out as ISO text (as ``for_oracle`` does)."""
    repl = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in date_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) q"
