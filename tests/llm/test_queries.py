"""The registered queries that have SQL, against DuckDB; the registry itself."""

import datetime  # noqa: F401
import inspect

import duckdb
import pytest

from shoal.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.ORACLE[name])
    cols = [c[0] for c in want.description]
    want = sorted((tuple(r) for r in want.fetchall()), key=str)
    got = Q.QUERIES[name](spark, SF)
    assert set(got.columns) == set(cols)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == want


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES)
    assert numbers == list(range(1, 14))
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in Q.QUERIES.values())
