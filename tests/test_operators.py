import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators import append, read, recovery, retention, segments, tiers
from strandlog.operators.numbering import dense, first_gap, nearest_rank
from strandlog.operators.read import SHIFT_FROM_TAIL, ReadSpec
from strandlog.plans.queries import QUERIES


def log_of(spark, n, queue="q", first=0):
    return spark.range(first, n).select(F.lit(queue).alias("queue"), F.col("id").alias("entry_id"), F.concat(F.lit("entry_"), "id").alias("data"))


def ids(rows):
    return sorted(r.entry_id for r in rows.collect())


@pytest.mark.parametrize(
    "n, spec, want",
    [
        (10, ReadSpec("q", 2, 4), [2, 3, 4, 5]),
        (10, ReadSpec("q", 0, 5, 2), [0, 2, 4, 6, 8]),
        (5, ReadSpec("q", 0, 15), [0, 1, 2, 3, 4]),
        (5, ReadSpec("q", 100, 5, 1, SHIFT_FROM_TAIL), [0, 1, 2, 3, 4]),
        (10, ReadSpec("q", 1, 3, 3), [1, 4, 7]),
        (100, ReadSpec("q", 0, 4, 20), [0, 20, 40, 60]),
        (11, ReadSpec("q", 1, 2, 1, SHIFT_FROM_TAIL), [9, 10]),
        (100, ReadSpec("q", 0, 1000), list(range(100))),
        (10, ReadSpec("q", 0, 3, 0), [0, 1, 2]),
        (0, ReadSpec("q", 1024, 5, 1, SHIFT_FROM_TAIL), []),
        (0, ReadSpec("q", 0, 5), []),
        (5, ReadSpec("other", 0, 5), []),
    ],
)
def test_reads(spark, n, spec, want):
    assert ids(read.read(log_of(spark, n), spec)) == want


def test_read_pushes_its_bounds(spark, tmp_path):
    log_of(spark, 100).write.parquet(f"{tmp_path}/log")
    plan = read.read(spark.read.parquet(f"{tmp_path}/log"), ReadSpec("q", 5, 3, 2))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(entry_id,5)" in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        read.read(log_of(spark, 1), ReadSpec("q"))


@pytest.mark.parametrize("name", ["read_absolute", "read_absolute_step", "read_past_end", "read_tail"])
def test_registered_reads_push_their_bounds(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(entry_id," in plan and "LessThanOrEqual(entry_id," in plan
    assert "Exchange" not in plan.replace("BroadcastExchange", "") or name == "read_tail"
    assert "SortMergeJoin" not in plan


def test_tail_from_the_catalog(spark):
    log = log_of(spark, 50)
    assert ids(read.read(log, ReadSpec("q", 3, 9, 1, SHIFT_FROM_TAIL), segments.catalog(log, 8))) == [46, 47, 48, 49]
    assert ids(read.read_tails(log.union(log_of(spark, 3, "p")), 1, 5)) == [1, 2, 48, 49]


def test_cross_tier(spark):
    wal, memory = log_of(spark, 10).withColumn("data", F.lit("wal")), log_of(spark, 15, first=8).withColumn("data", F.lit("memory"))
    rows = read.read(tiers.stitched({"DISK_WAL": wal, "MEMORY": memory}), ReadSpec("q", 7, 8, 1)).collect()
    assert sorted((r.entry_id, r.source) for r in rows) == [(7, "DISK_WAL"), *((i, "MEMORY") for i in range(8, 15))]


STATES = {"FR1": ([(1, 9, 10), (2, None, 0)], (2, 10)), "FR2": ([(1, 4, 5), (2, None, 0), (3, None, 0), (4, None, 0)], (4, 5)), "FR4": ([(1, None, 0), (2, None, 0)], (1, 0)), "FR6": ([(1, 9, 10), (3, None, 0)], (3, 10)), "full": ([(1, 9, 10), (2, 19, 10)], (3, 20))}


@pytest.mark.parametrize("name", STATES)
def test_recovery(spark, name):
    rows, want = STATES[name]
    got = recovery.write_target(spark.createDataFrame([("q", *r) for r in rows], "queue string, file_id long, last_id long, num_entries long")).first()
    assert (got.next_file_id, got.next_entry_id) == want


def test_valid_prefix_by_both_ways(spark):
    rows = [("q", f, i, i not in (3, 5)) for i in range(9) for f in [1 + i // 4]]
    records = spark.createDataFrame(rows, "queue string, file_id long, entry_id long, ok boolean")
    assert ids(recovery.valid_prefix(records)) == ids(recovery.sound_by_window(records)) == [0, 1, 2, 4, 8]


@pytest.mark.parametrize("last, arrivals, want", [(0, [3, 2, 1], [1, 2, 3]), (0, [1, 3, 5, 2], [1, 2, 3]), (-1, [2, 1, 0], [0, 1, 2]), (0, [1, 1], [1]), (0, [*range(10, 1, -1), 1], list(range(1, 11))), (2**62, [2**62 + 1], [2**62 + 1]), (0, [2], [])])
def test_release(spark, last, arrivals, want):
    rows = spark.createDataFrame([("q", i, "x") for i in arrivals], "queue string, entry_id long, data string")
    assert ids(append.release(rows, last)) == want


def test_numbering_over_buckets(spark):
    rng = random.Random(1)
    rows = [(q, o) for q in "ab" for o in rng.sample(range(-500, 900), 200)]
    df = spark.createDataFrame(rows, "q string, o long")
    got = {(r.q, r.o): r.entry_id for r in dense(df, ["q"], "o", bucket=37).collect()}
    assert all(got[q, o] == i for q in "ab" for i, o in enumerate(sorted(o for p, o in rows if p == q)))
    values = [("a", i) for i in range(5, 250) if i != 163] + [("b", 7), ("c", 5)]
    gaps = first_gap(spark.createDataFrame(values, "q string, v long"), ["q"], "v", 5, bucket=16)
    assert {r.q: r.gap for r in gaps.collect()} == {"a": 163, "b": 5, "c": 6}


def test_every_row_gets_a_number(spark):
    rows = [("a", 5), ("a", None), (None, 7), (None, 3), ("a", 1), (None, None)]
    df = spark.createDataFrame([(q, o, i) for i, (q, o) in enumerate(rows)], "queue string, o long, i int")
    for bucket in (None, 2):
        got = {r.i: r.entry_id for r in dense(df, ["queue"], "o", bucket=bucket).collect()}
        assert got == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 2}
    assert dense(df.limit(0), ["queue"], "o").count() == 0
    far = spark.createDataFrame([("q", 2**60 * i) for i in range(-3, 4)], "queue string, o long")
    assert sorted((r.o, r.entry_id) for r in dense(far, ["queue"], "o").collect()) == [(2**60 * (i - 3), i) for i in range(7)]


def test_reads_meet_only_ranges_near_them(spark):
    rng = random.Random(6)
    log = log_of(spark, 9000).union(log_of(spark, 50, "p"))
    asked = [(i, rng.choice("pqx"), lo, lo + rng.choice([0, 5, 5000]), rng.choice([1, 3])) for i in range(40) for lo in [rng.randrange(9000)]] + [(99, "q", 5, 4, 1)]
    df = spark.createDataFrame(asked, "read_id int, queue string, _start long, _end long, _step long")
    want = sorted((i, q, e) for i, q, lo, hi, st in asked for e in range(lo, min(hi, {"q": 8999, "p": 49, "x": -1}[q]) + 1, st))
    for most in (0, 10**6):
        assert sorted((r.read_id, r.queue, r.entry_id) for r in read.in_ranges(log, df, width=64, most_blocks=most).collect()) == want
    assert read.in_ranges(log, df.limit(0)).count() == 0


def greedy(sizes, limit, header=33, overhead=28):
    out, size = [], None
    for n in sizes:
        if size is None or size + n > limit:
            out.append((out[-1] if out else 0) + 1)
            size = header
        else:
            out.append(out[-1])
        size += overhead + n
    return out


def test_rotation_against_the_rule(spark):
    rng = random.Random(7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        for limit in (0, 100, 1000):
            sizes = {q: [rng.choice([0, 1, 30, 300, 2000]) for _ in range(rng.randint(1, 120))] for q in "abc"}
            rows = spark.createDataFrame([(q, i, n or None) for q in sizes for i, n in enumerate(sizes[q])], "queue string, entry_id long, n long")
            got = segments.rotate(rows, limit).orderBy("queue", "entry_id").collect()
            assert [r.file_id for r in got] == [f for q in "abc" for f in greedy(sizes[q], limit)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    wide = spark.createDataFrame([("q", 2**32 + d, 5) for d in (-2, -1, 0, 1)], "queue string, entry_id long, n long")
    assert [r.file_id for r in segments.rotate(wide, 10**6).orderBy("entry_id").collect()] == [1, 1, 2, 2]


def test_recovery_ignores_remote_copies(spark):
    rows = [("q", 1, 9, 10, "DISK_STORE"), ("q", 7, 99, 10, "CLOUD")]
    got = recovery.write_target(spark.createDataFrame(rows, "queue string, file_id long, last_id long, num_entries long, tier string")).first()
    assert (got.next_file_id, got.next_entry_id) == (2, 10)


def test_writes_and_their_results(spark):
    rows = [(1, "q", [1, 2]), (2, "q", []), (3, None, [1]), (4, "q", None), (5, "q", [1]), (6, "new", [1, 1])]
    got = append.write_results(spark.createDataFrame(rows, "write_id int, queue string, packets array<int>"), spark.createDataFrame([("q", 7)], "queue string, last_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, "WR_DONE", 8, 9), (2, "WR_DONE", None, None), (3, "WR_SERVER_ERROR", None, None), (4, "WR_SERVER_ERROR", None, None), (5, "WR_DONE", 10, 10), (6, "WR_DONE", 0, 1)]


def test_nearest_rank(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5])) for g in "ab" for _ in range(333)] + [("c", 1.0)]
    got = nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0, 50, 99, 100], accuracy=50).collect()
    for r in got:
        values = sorted(v for g, v in rows if g == r.g)
        assert (r.p0, r.p50, r.p99, r.p100) == tuple(values[min(len(values) * p // 100, len(values) - 1)] for p in (0, 50, 99, 100))
    assert len(got) == 3
    lower = nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", [50, 99], "floor of (n - 1) p", accuracy=40).collect()
    for r in lower:
        values = sorted(v for g, v in rows if g == r.g)
        assert (r.p50, r.p99) == tuple(values[(len(values) - 1) * p // 100] for p in (50, 99))


def test_segments(spark):
    sizes = [10, 200, 10, 10, 10, 300, 1]
    rows = spark.createDataFrame([("q", i, n) for i, n in enumerate(sizes)], "queue string, entry_id long, n long")
    assert [r.file_id for r in segments.rotate(rows, 128).orderBy("entry_id").collect()] == [1, 2, 3, 3, 3, 4, 5]
    seg = segments.catalog(log_of(spark, 100), 10)
    found = segments.lookup(log_of(spark, 120), seg, width=16)
    assert {r.entry_id: r.file_id for r in found.collect()} == {i: i // 10 + 1 for i in range(100)}


def test_retention(spark):
    seg = spark.createDataFrame([("q", f, 10) for f in range(1, 6)], "queue string, file_id long, bytes long")
    assert [r.file_id for r in retention.victims(seg, 25).collect()] == [1, 2, 3]
    assert [r.file_id for r in retention.victims(seg, 25, 1).collect()] == [1]
    assert retention.latest_offloaded(seg).first().latest == 5
    with pytest.raises(ValueError):
        retention.check_limits(10, 4)


def test_append_goes_on_after_the_last_id(spark):
    batch = spark.createDataFrame([("q", 5, "a"), ("q", 9, "b"), ("new", 1, "c")], "queue string, pos long, data string")
    got = append.assign_ids(batch, spark.createDataFrame([("q", 7)], "queue string, last_id long")).collect()
    assert sorted((r.queue, r.entry_id, r.data) for r in got) == [("new", 0, "c"), ("q", 8, "a"), ("q", 9, "b")]


def test_compaction_keeps_content(spark, tmp_path):
    log = log_of(spark, 50).union(log_of(spark, 20, "p"))
    assert sorted(map(tuple, segments.compact(log.repartition(5), f"{tmp_path}/c", 3).collect())) == sorted(map(tuple, log.collect()))
