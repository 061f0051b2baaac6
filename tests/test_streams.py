import pytest

from strandlog.operators.read import SHIFT_FROM_TAIL, ReadSpec
from strandlog.streaming import follow as S

SCHEMA = "queue string, entry_id long, data string"


def put(spark, path, ids, queue="q"):
    spark.createDataFrame([(queue, i, f"e{i}") for i in ids], SCHEMA).write.mode("append").parquet(path)


def delivered(spark, rows, tmp_path):
    S.to_table(rows, f"{tmp_path}/out", f"{tmp_path}/cursor").awaitTermination()
    return sorted(r.entry_id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())


@pytest.mark.parametrize(
    "make, before, after",
    [
        (lambda s: S.follow(s, ReadSpec("q", 0, step=3)), [0, 3, 6, 9], [0, 3, 6, 9, 12]),
        (lambda s: S.follow(s, ReadSpec("q", 11)), [], [11, 12]),
        (lambda s: S.follow(s, ReadSpec("q", 2, position=SHIFT_FROM_TAIL), 9), [7, 8, 9], [7, 8, 9, 10, 11, 12]),
        (lambda s: S.follow_live(s, "q", 9, 2), [], [10, 12]),
        (lambda s: S.follow_live(s, "none", None), [], []),
    ],
)
def test_follow(spark, tmp_path, make, before, after):
    put(spark, f"{tmp_path}/log", range(10))
    put(spark, f"{tmp_path}/log", range(3), "p")
    rows = make(S.stream_log(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema))
    assert delivered(spark, rows, tmp_path) == before
    put(spark, f"{tmp_path}/log", range(10, 13))
    assert delivered(spark, rows, tmp_path) == after
    assert delivered(spark, rows, tmp_path) == after


def test_callback_can_end_its_subscription(spark, tmp_path):
    put(spark, f"{tmp_path}/log", range(4))
    stream, seen = S.stream_log(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema), []

    def callback(batch, number):
        seen.append(sorted(r.entry_id for r in batch.collect()))
        return len(seen) < 2

    for new in ([], [4], [5]):
        if new:
            put(spark, f"{tmp_path}/log", new)
        S.subscribe(stream, callback, f"{tmp_path}/c").awaitTermination()
    assert seen == [[0, 1, 2, 3], [4]]


def test_unsubscribe_by_id_may_be_repeated(spark, tmp_path):
    put(spark, f"{tmp_path}/log", range(4))
    stream = S.stream_log(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema)
    query = S.subscribe(stream, lambda batch, number: True, f"{tmp_path}/c", processingTime="1 second")
    assert S.unsubscribe(spark, str(query.id)) and not S.unsubscribe(spark, str(query.id)) and not query.isActive


def test_appended_batches_replace_their_first_try(spark, tmp_path):
    put(spark, f"{tmp_path}/log", range(4))
    stream = S.stream_log(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema)
    for n in "ab":  # a lost checkpoint makes the same batch come again
        S.append_batches(stream, f"{tmp_path}/copy", f"{tmp_path}/c{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 4


def test_ordered_buffer(spark, tmp_path):
    spark.conf.set(*S.ROCKSDB)
    put(spark, f"{tmp_path}/log", [2, 0, 5, 0])
    put(spark, f"{tmp_path}/log", [1], "p")
    stream = S.ordered(S.stream_log(spark, f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema))
    assert delivered(spark, stream, tmp_path) == [0]
    put(spark, f"{tmp_path}/log", [1, 3, 0])
    assert delivered(spark, stream, tmp_path) == [0, 1, 2, 3]
    put(spark, f"{tmp_path}/log", [4])
    put(spark, f"{tmp_path}/log", [0], "p")
    assert delivered(spark, stream, tmp_path) == [0, 0, 1, 1, 2, 3, 4, 5]
