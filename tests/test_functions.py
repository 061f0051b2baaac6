import pytest
from pyspark.sql import functions as F

from strandlog.functions import ids as I
from strandlog.functions import queues as Q


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


PATHS = {0: "000", 255: "0ff", 4095: "fff", 4096: "001/000", 65536: "010/000", 16777216: "001/000/000"}


def test_paths(spark):
    rows = spark.createDataFrame([(i,) for i in PATHS], "i long").select("i", I.file_path(F.col("i"), ".store").alias("p")).withColumn("back", I.path_to_id(F.col("p"))).collect()
    assert {r.i: r.p for r in rows} == {i: p + ".store" for i, p in PATHS.items()}
    assert all(r.back == r.i for r in rows)
    names = spark.createDataFrame([("fff/fff.store",), ("001/000/000.store",), ("xyz.store",), ("00/000.store",), ("",)], "p string")
    assert [r[0] for r in names.select(I.path_to_id(F.col("p"))).collect()] == [16777215, 16777216, None, None, None]


@pytest.mark.parametrize("value, size", [(0, 1), (255, 1), (256, 2), (65535, 2), (65536, 4), (2**32 - 1, 4), (2**32, 8), (2**63 - 1, 8)])
def test_widths_and_bytes(spark, value, size):
    v = F.lit(value).cast("bigint")
    row = one(spark, I.width(v), I.can_fit(v, 4), I.to_little_endian(v, 8), I.from_little_endian(I.to_little_endian(v, 8), 8), I.wide_key(v))
    assert (row[0], row[1], bytes(row[2]), row[3]) == (size, size <= 4, value.to_bytes(8, "little"), value)
    assert bytes(row[4])[1:].lstrip(b"\0") == value.to_bytes(8).lstrip(b"\0")


def test_arithmetic(spark):
    big = F.lit(2**63 - 1).cast("bigint")
    row = one(spark, I.decrement(F.lit(0)), I.subtract(F.lit(1), F.lit(2)), I.middle(big, big), I.add_wide(big, big), I.remainder(F.lit(5), F.lit(0)), I.narrowed(F.lit("99999999999999999999")), I.increment(F.lit(255)))
    assert tuple(row) == (None, None, 2**63 - 1, 2 * (2**63 - 1), None, None, 256)
    keys = spark.createDataFrame([(x,) for x in (0, 255, 256, 65536, 2**40)], "v long").select("v", I.wide_key(F.col("v")).alias("k")).collect()
    assert [r.v for r in sorted(keys, key=lambda r: bytes(r.k))] == [0, 255, 256, 65536, 2**40]


@pytest.mark.parametrize("value", [0, 1, 255, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 10**38 - 1])
def test_wide_ids(spark, value):
    v = F.lit(str(value)).cast("decimal(38,0)")
    raw = I.to_little_endian(v, 16)
    row = one(spark, raw, I.from_little_endian_wide(raw, 16), I.from_little_endian(raw, 16), I.width(v), I.wide_key(v), I.compare(v, F.lit(2**62)))
    n = max(1, (value.bit_length() + 7) // 8)
    assert (bytes(row[0]), int(row[1]), row[2]) == (value.to_bytes(16, "little"), value, value if value < 2**63 else None)
    assert row[3] == next(w for w in (1, 2, 4, 8, 16) if w >= n) and bytes(row[4]) == bytes([n]) + value.to_bytes(n) and row[5] == (1 if value > 2**62 else -1)


def test_numbers_too_large_are_null(spark):
    ff = F.unhex(F.lit("FF" * 16))
    row = one(spark, I.from_little_endian(F.unhex(F.lit("FF" * 8)), 8), I.from_little_endian_wide(F.unhex(F.lit("FF" * 8)), 8), I.from_little_endian_wide(ff, 16))
    assert (row[0], int(row[1]), row[2]) == (None, 2**64 - 1, None)


def test_numbers_are_narrowed_without_failing_casts(spark):
    odd = ["0", "-1", "+7", " 12 ", "12.7", "x", "", None, "1e3", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "0" * 30 + "5", "0" * 50 + "5", "9" * 38, "9" * 60]
    rows = spark.createDataFrame([(x,) for x in odd], "v string")
    got = rows.select(I.narrowed(F.col("v")).alias("n"), F.col("v").try_cast("bigint").alias("want")).collect()
    assert [r.n for r in got] == [r.want for r in got] and got[9].n == 2**63 - 1 and got[10].n is None
    # a cast that fails costs an error a row: it stands behind a comparison with the bounds
    plan = rows.select(I.narrowed(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index("try_cast")


def test_keys_of_narrow_and_wide_ids_agree(spark):
    values = [0, 9, 15, 16, 255, 256, 4095, 4096, 2**31, 2**62, 2**63 - 1]
    both = spark.createDataFrame([(v,) for v in values], "v long").select("v", I.wide_key(F.col("v")).alias("n"), I.wide_key(F.col("v").cast("decimal(38,0)")).alias("w")).collect()
    for r in both:
        size = max(1, (r.v.bit_length() + 7) // 8)
        assert bytes(r.n) == bytes(r.w) == bytes([size]) + r.v.to_bytes(size)


def test_in_step(spark):
    row = one(spark, *[I.in_step(F.lit(e), F.lit(10), F.lit(s)) for e, s in ((9, 1), (10, 1), (13, 3), (14, 3), (11, 0))])
    assert tuple(row) == (False, True, True, False, True)


def test_queues(spark):
    row = one(spark, Q.resolve(F.lit("my_queue"), "abc123def456"), Q.resolve(F.lit("/shared/queue"), "abc123def456"), Q.segment_path("/d/", F.lit("/i/q"), "wal", F.lit(4096)), Q.cloud_key("p/", F.lit("/i/q"), F.lit(1)))
    assert tuple(row) == ("/abc123def456/my_queue", "/shared/queue", "/d/i/q/wal/001/000.wal", "p/i/q/001.store")


def test_globs_first_match_wins(spark):
    queues = spark.createDataFrame([("/i/cam1",), ("/i/cam12",), ("/i/log.x",), ("/j",)], "queue string")
    rules = [(3, "/i/*", "ZSTD", "NONE", False), (1, "/i/cam?", "NONE", "NONE", True), (2, "/i/{cam,mic}[0-9]*", "XZ", "AES", True)]
    want = {"/i/cam1": "NONE", "/i/cam12": "XZ", "/i/log.x": "ZSTD", "/j": "ZSTD"}
    got = Q.settings(queues, rules)
    assert {r.queue: r.compression for r in got.collect()} == want
    table = spark.createDataFrame([(p, Q.glob_to_regex(g), c, e, f) for p, g, c, e, f in rules], "priority int, regex string, compression string, encryption string, fsync boolean")
    assert sorted(map(tuple, Q.settings_from_table(queues, table).collect())) == sorted(map(tuple, got.collect()))
