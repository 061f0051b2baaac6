"""The queries that have SQL against it in DuckDB: on the smallest tables, and on documents with nulls, ties and repeated rows."""

import os
import random

import duckdb
import pytest

from strandlog.llm.entry import QUERIES, SQL
from tests.llm import test_repetition, test_superkmers

DIR = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    con = duckdb.connect()
    for table in os.listdir(folder):
        if table.endswith(".parquet"):
            path = f"{folder}/{table}"
            con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = QUERIES[name](spark, folder), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(repr, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(repr, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(spark, name, DIR)


@pytest.mark.parametrize("name", ["op6_suffix_repetition", "op7_super_kmers"])
def test_odd_documents(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(test_repetition.texts())] + test_superkmers.corpus(random.Random(9)) + [(None, "b " * 60), (None, None), (3, "p q " * 45)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, str(tmp_path))
