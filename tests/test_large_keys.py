"""Queries whose codes grow with the part numbers, on parts of large numbers."""

import duckdb
import pytest

from leafwright.plans import queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", ["benefit_detected_tables", "benefit_service_lines", "claim_service_lines"])
def test_codes_of_six_digits(spark, tmp_path, name):
    duck = duckdb.connect()
    # either side of 90,000, whose code is the first of six digits, and of a million
    duck.execute(f"copy (select p.* replace (p_partkey + s as p_partkey) from '/root/testdata/sf0.001/part.parquet' p, (values (89904), (989904)) v(s)) to '{tmp_path}/part.parquet' (format parquet)")
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*(d[0] for d in want.description)).collect()
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
