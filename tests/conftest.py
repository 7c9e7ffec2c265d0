import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shoal.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="shoal-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="shoal-test-wh-"),
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shoal-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from shoal.sources.tables import DRIVER_TABLES
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
