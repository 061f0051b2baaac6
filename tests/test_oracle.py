"""Every query of the log engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from strandlog.plans.oracle import SQL
from strandlog.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def test_all_are_paired():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, DIR), db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(repr, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(repr, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
