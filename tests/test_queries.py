"""Every registered query against its DuckDB SQL (sf0.001), and the SQL-text forms of the
TPC-H plans against the DataFrame forms (M3)."""

import hashlib

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from shoal.plans import catalog, tpch
from shoal.sources import fixtures


def _digest(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return repr(v)
        return str(v).replace("T", " ")
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return cols, hashlib.sha1("\n".join(rows).encode()).hexdigest()


ORACLE = catalog.ORACLE        # the optional operators have tests of their own


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert len(got) == len(want)
    assert _digest(got) == _digest(want)


def test_every_query_has_sql_and_the_entry_has_them():
    assert set(catalog.QUERIES) == set(ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


SQL_VS_DF = {
    "q1": lambda t: tpch.pricing_summary(t, 90),
    "q8a": lambda t: tpch.market_share(t, "NATION_2", "AMERICA", "ECONOMY"),
    "q12a": lambda t: tpch.shipmode_priority(t, "MAIL", "SHIP", "1996-01-01"),
    "q13a": lambda t: tpch.customer_distribution(t),
    "q14a": lambda t: tpch.promo_effect(t, "1997-09-01"),
    "q15a": lambda t: tpch.top_supplier(t, "1996-01-01"),
}
SQL_ARGS = {"q8a": {"nation": "NATION_2", "region": "AMERICA", "ptype": "ECONOMY"},
            "q12a": {"start": "1996-01-01"}, "q14a": {"start": "1997-09-01"}}


@pytest.mark.parametrize("name", sorted(SQL_VS_DF))
def test_sql_text_equals_dataframe_plan(spark, name):
    t = fixtures.register(spark, SF_SMALL)
    by_sql = catalog.for_oracle(tpch.run_sql(spark, name, **SQL_ARGS.get(name, {}))).toPandas()
    by_df = catalog.for_oracle(SQL_VS_DF[name](t)).toPandas()
    assert _digest(by_sql) == _digest(by_df)
