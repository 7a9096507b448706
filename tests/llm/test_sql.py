"""The operators' queries with SQL give the rows that DuckDB gives, on whole tables."""

import duckdb
import pytest

from splitfold.llm import queries
from splitfold.session import TABLES


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def duck(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/{request.param}/{t}.parquet'")
    return con, f"/root/testdata/{request.param}"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    con, sf = duck
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
