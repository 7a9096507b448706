"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from splitfold.plans.queries import QUERIES, SQL
from splitfold.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_queries_without_sql(spark):
    rows = QUERIES["so_combined_messages"](spark, SF).collect()
    assert sum(r["updates"] for r in rows) == 1000 and all(r["bytes"] <= 1000 for r in rows)
