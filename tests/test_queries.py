"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from leafwright.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    return (v is None, round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, bool) else v) if v is not None else (True, 0)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    assert rows
