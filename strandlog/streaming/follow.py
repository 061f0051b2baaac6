"""Follows and subscriptions on Structured Streaming.

A follow replays history from its start and goes on with what is appended: the stream's checkpoint is its cursor, so nothing is
missed or sent twice between files and new data. Tail starts are looked up once and stay. A slow consumer holds the stream back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from strandlog.operators.read import SHIFT_FROM_TAIL, ReadSpec


def stream_log(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def follow(stream: DataFrame, spec: ReadSpec, last: int | None = None) -> DataFrame:
    """The rows of a read without end. last: the queue's last id when the follow begins, needed for tail starts."""
    start = spec.start(last)
    rows = stream.where((F.col("queue") == spec.queue) & (F.col("entry_id") >= start))
    return rows if spec.step <= 1 else rows.where((F.col("entry_id") - start) % spec.step == 0)


def follow_live(stream: DataFrame, queue: str, last: int | None, step: int = 1) -> DataFrame:
    """Only what is appended after `last`; the grid begins at the next id."""
    return follow(stream, ReadSpec(queue, 0 if last is None else last + 1, step=step))


_ended: set[str] = set()


def subscribe(stream: DataFrame, callback: Callable[[DataFrame, int], bool], checkpoint: str, **trigger) -> StreamingQuery:
    """Run callback on each micro-batch. Once it returns False it is called no more: the query goes on past what comes, and ends by
    unsubscribe or with its trigger."""

    def each(batch: DataFrame, number: int) -> None:
        if checkpoint not in _ended and callback(batch, number) is False:
            _ended.add(checkpoint)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def unsubscribe(spark: SparkSession, subscription: str) -> bool:
    """Stop the subscription of this id (StreamingQuery.id); false, and no error, if there is none any more."""
    found = next((q for q in spark.streams.active if str(q.id) == subscription), None)
    if found is None:
        return False
    found.stop()
    return True


def to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_batches(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append micro-batches to a log so that a batch that is tried again replaces its own first try: one folder per batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class OrderedBuffer(StatefulProcessor):
    """Holds arrivals of a queue until the run after its last written id is whole, then releases them; old and double ids go.

    State: the next id, and pending payloads by id - a map, so a batch touches only what it brings and releases."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next long")
        self.pending = handle.getMapState("pending", "entry_id long", "data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        at = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            for entry_id, data in zip(frame["entry_id"].tolist(), frame["data"].tolist()):
                if entry_id >= at and not self.pending.containsKey((entry_id,)):
                    self.pending.updateValue((entry_id,), (data,))
        out: list[tuple] = []
        while self.pending.containsKey((at,)):
            out.append((key[0], at, self.pending.getValue((at,))[0]))
            self.pending.removeKey((at,))
            at += 1
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["queue", "entry_id", "data"])
                out = []
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["queue", "entry_id", "data"])

    def close(self) -> None:
        pass


def ordered(arrivals: DataFrame) -> DataFrame:
    """The stream of arrivals (queue, entry_id, data) in order, by queue. Needs the RocksDB state store."""
    return arrivals.select("queue", "entry_id", "data").groupBy("queue").transformWithStateInPandas(
        statefulProcessor=OrderedBuffer(), outputStructType="queue string, entry_id long, data string", outputMode="Append", timeMode="None"
    )


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tail_start(spec: ReadSpec, last: int | None) -> ReadSpec:
    """The absolute form of a tail follow: its start is looked up once."""
    return ReadSpec(spec.queue, spec.start(last), spec.limit, spec.step) if spec.position == SHIFT_FROM_TAIL else spec
