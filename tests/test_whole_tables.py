"""Queries over whole tables take every row."""

import duckdb
import pytest

from strandlog.plans.queries import QUERIES
from tests.test_oracle import DIR


@pytest.mark.parametrize("name, rows", [("f_in_step", "l_orderkey"), ("f_uint_arith", "l_orderkey"), ("f_uint_width", "distinct l_orderkey")])
def test_every_lineitem_is_taken(spark, name, rows):
    assert QUERIES[name](spark, DIR).count() == duckdb.sql(f"select count({rows}) from '{DIR}/lineitem.parquet'").fetchall()[0][0]


def test_every_entry_is_looked_up(spark):
    events = [r for r in duckdb.sql(f"select event_type, event_id from '{DIR}/events.parquet'").fetchall()]
    want = []
    for queue in {q for q, _ in events}:
        want += [(queue, i, i // 64 + 1) for i in range(sum(q == queue for q, _ in events))]
    assert sorted(map(tuple, QUERIES["file_lookup"](spark, DIR).select("queue", "entry_id", "file_id").collect())) == sorted(want)


def test_the_whole_batch_is_numbered(spark):
    got = QUERIES["batch_id_assign"](spark, DIR).collect()
    customers, queues = (duckdb.sql(f"select count({x}) from '{DIR}/{t}.parquet'").fetchall()[0][0] for x, t in (("*", "customer"), ("distinct event_type", "events")))
    assert len(got) == customers * queues > 20 * queues


def test_paths_of_one_directory_are_there(spark):
    got = {r.fid: r.path for r in QUERIES["file_path"](spark, DIR).collect()}
    assert got[397] == "18d.store" and min(got) == 397
