"""The segment catalog: which file holds which ids, by queue and tier.

segments: queue, file_id, first_id, last_id, num_entries, bytes (and tier). Windows here run over catalog rows, one a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a record adds to its payload at default widths, and a file's header.
RECORD_OVERHEAD, FILE_HEADER = 28, 33


def catalog(log: DataFrame, per_file: int) -> DataFrame:
    """Segments of a fixed number of entries; file ids from 1."""
    rows = log.select("queue", "entry_id", F.length("data").alias("_n"), (F.expr(f"entry_id div {per_file}") + 1).alias("file_id"))
    return rows.groupBy("queue", "file_id").agg(
        F.min("entry_id").alias("first_id"), F.max("entry_id").alias("last_id"), F.count("*").alias("num_entries"), F.sum(F.col("_n") + RECORD_OVERHEAD).cast("bigint").alias("bytes")
    )


def rotate(entries: DataFrame, max_bytes: int, header: int = FILE_HEADER, overhead: int = RECORD_OVERHEAD, id_width: int = 4) -> DataFrame:
    """queue, entry_id, file_id of entries (queue, entry_id, n): a file ends before the payload that would take it past max_bytes,
    and before an id that needs more bytes than the file's header gives ids. A null n is an empty payload.

    Each file's begin depends on the one before, so a queue is one ordered pass over its sizes. Only ids and sizes are dealt,
    Spark sorts them, and the pass steps from file to file by a search in running sums: memory is the same for any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, file_id, size, wide = (), 0, 0, 0
        for batch in batches:
            names, ids = batch.column(0), np.asarray(batch.column(1))
            coded = names.dictionary_encode()
            code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            n = np.asarray(batch.column(2)).astype(np.int64)
            files = np.empty(len(n), np.int64)
            for lo, hi in zip((cuts := np.flatnonzero(np.diff(code, prepend=-1))).tolist(), [*cuts[1:].tolist(), len(n)]):
                if (names[lo].as_py(),) != queue:
                    queue, file_id, size = (names[lo].as_py(),), 0, -1
                ends = np.cumsum(n[lo:hi] + overhead)
                widths = np.where(ids[lo:hi] < 1 << 8 * id_width, 0, 1)
                at = 0
                while at < hi - lo:
                    before = int(ends[at - 1]) if at else 0
                    room = max_bytes - (header if size < 0 else size) + before + overhead
                    stop = int(np.searchsorted(ends, room, "right"))
                    if size < 0 or stop <= at or widths[at] > wide:  # a new file takes its first entry whatever its size
                        file_id, size, wide = file_id + 1, header, int(widths[at])
                        stop = max(int(np.searchsorted(ends, max_bytes - header + before + overhead, "right")), at + 1)
                    stop = min(stop, int(np.searchsorted(widths, wide, "right")))
                    files[lo + at : lo + stop] = file_id
                    size += int(ends[stop - 1]) - before
                    at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files)], names=["queue", "entry_id", "file_id"])

    sized = entries.select("queue", "entry_id", F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"))
    return sized.repartition("queue").sortWithinPartitions("queue", "entry_id").mapInArrow(run, "queue string, entry_id long, file_id long")


def bounds(segments: DataFrame, *by: str) -> DataFrame:
    """First and last file of each queue (and of what else is named, such as tier)."""
    return segments.groupBy("queue", *by).agg(F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


def queue_start(segments: DataFrame) -> DataFrame:
    return segments.groupBy("queue").agg(F.min("first_id").alias("start_id"))


def lookup(ids: DataFrame, segments: DataFrame, width: int = 1 << 16) -> DataFrame:
    """ids (queue, entry_id) with the file that holds each; ids in no file are left out.

    A range join as an equi-join: segments are listed at every block of `width` ids that they touch, ids at their own block."""
    blocks = F.explode(F.sequence(F.expr(f"first_id div {width}"), F.expr(f"last_id div {width}"))).alias("_block")
    listed = segments.select("queue", "file_id", "first_id", "last_id", blocks)
    asked = ids.withColumn("_block", F.expr(f"entry_id div {width}"))
    found = asked.join(listed, ["queue", "_block"]).where(F.col("entry_id").between(F.col("first_id"), F.col("last_id")))
    return found.select(*ids.columns, "file_id")


def nearest_nonempty(segments: DataFrame) -> DataFrame:
    """queue, file_id, nearest: the largest file id up to it that has entries; null if none has."""
    seen = F.max(F.when(F.col("num_entries") > 0, F.col("file_id"))).over(Window.partitionBy("queue").orderBy("file_id"))
    return segments.select("queue", "file_id", seen.alias("nearest"))


def first_of(candidates: DataFrame, priority: Column, *keys: str) -> DataFrame:
    """For each key the row of lowest priority number, all columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(priority))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def file_end(candidates: DataFrame) -> DataFrame:
    """queue, file_id, end_id, header_src of candidates (queue, file_id, src, last_id): the largest end; the header from WAL first."""
    ends = candidates.groupBy("queue", "file_id").agg(F.max("last_id").alias("end_id"), F.min_by("src", F.when(F.col("src") == "WAL", 1).otherwise(2)).alias("header_src"))
    return ends


def compaction_candidates(segments: DataFrame) -> DataFrame:
    """Files that are no longer written: all before the queue's last."""
    current = segments.groupBy("queue").agg(F.max("file_id").alias("_current"))
    return segments.join(current, "queue").where("file_id < _current").select("queue", "file_id")


def compact(log: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Rewrite a log for reading: sorted by queue and id over all files, zstd; returns the new table."""
    n = [files] if files else []
    log.repartitionByRange(*n, "queue", "entry_id").sortWithinPartitions("queue", "entry_id").write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)
