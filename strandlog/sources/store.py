"""Jobs on the files of a store: compaction of WAL files, retention, truncation, clean-up, and the seed.

A store is a folder with <queue>/wal and <queue>/store; root: a path or URI that driver and workers reach."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import retention, segments
from strandlog.sources import codec, files, shared


def compact_wal(spark: SparkSession, root: str, seed: bytes, compression: int = codec.ZSTD, encryption: int = codec.AES) -> DataFrame:
    """Turn every WAL file but each queue's last into a sealed store file, then delete it; returns the ranges of the files written,
    queue, file_id, first_id, last_id, num_entries.

    A WAL file goes only when its store file is whole, so the job can be lost and run again at any point. Only the sound prefix
    of a damaged file is kept, and one without entries leaves no store file."""
    listed = files.list_files(spark, root, "wal")
    closed = shared.written(segments.compaction_candidates(listed), "closed")
    ready = files.sound_files(files.read_heads(files.dealt(closed), root, "wal", None))
    made = shared.written(files.write_files(files.to_store(ready, seed, compression, encryption), root, "store"), "made")
    ranges = shared.written(files.store_ranges(files.read_heads(made, root, "store")).where("status = 'OK'").drop("status"), "ranges")
    if ranges.count() != made.count():
        raise OSError("a store file can't be read back")
    files.delete_files(files.dealt(closed), root, "wal").write.format("noop").mode("overwrite").save()
    return ranges


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """queue, file_id, bytes: a file's store and WAL forms together."""
    both = files.list_files(spark, root, "wal").union(files.list_files(spark, root, "store"))
    return both.groupBy("queue", "file_id").agg(F.sum("bytes").alias("bytes"))


def retain(spark: SparkSession, root: str, max_bytes: int, offloaded: int | None = None) -> DataFrame:
    """Delete the oldest files until each queue is within max_bytes, with a remote tier only what is there; returns what went."""
    doomed = shared.written(retention.victims(sizes(spark, root), max_bytes, offloaded), "victims")
    for tier in ("store", "wal"):
        files.delete_files(files.dealt(doomed), root, tier).write.format("noop").mode("overwrite").save()
    return doomed


def truncate(spark: SparkSession, root: str, queue: str) -> None:
    """Empty a queue's WAL folder."""
    system, path = shared.file_system(spark, f"{root.rstrip('/')}{queue}/wal")
    system.delete(path, True)
    system.mkdirs(path)


def clean(spark: SparkSession, root: str, older_ms: int = 3_600_000) -> int:
    """Delete what lost tasks left half written, if it is older than older_ms; returns how many files went."""
    system, path = shared.file_system(spark, root)
    now, found, n = spark._jvm.System.currentTimeMillis(), system.listFiles(path, True), 0
    while found.hasNext():
        file = found.next()
        if file.getPath().getName().endswith(".tmp") and file.getModificationTime() <= now - older_ms:
            n += bool(system.delete(file.getPath(), False))
    return n


def load_seed(spark: SparkSession, path: str) -> bytes:
    """The 32 bytes of a seed file, which the first to ask makes, readable by its owner only. A file of another size is an error."""
    system, there = shared.file_system(spark, path)
    if not system.exists(there):
        part = shared.file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
        stream = system.create(part)
        stream.write(secrets.token_bytes(32))
        stream.close()
        system.setPermission(part, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if not system.rename(part, there):
            system.delete(part, False)  # another process was first
    stream = system.open(there)
    seed = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    if len(seed) != 32:
        raise ValueError(f"{path} holds {len(seed)} bytes, not 32")
    return seed


def modes(requests: DataFrame) -> DataFrame:
    """queue, mode of queues that were opened by requests (queue, mode: read or write): once opened for writing they stay so."""
    return requests.groupBy("queue").agg(F.when(F.max(F.expr("mode = 'write'")), F.lit("write")).otherwise(F.lit("read")).alias("mode"))


def admitted(writes: DataFrame, states: DataFrame) -> DataFrame:
    """writes with `admitted`: whether the queue is open for writing; others are turned away before they reach memory or disk."""
    open_ = states.where("mode = 'write'").select("queue", F.lit(True).alias("_open"))
    return writes.join(open_, "queue", "left").select(*writes.columns, F.coalesce("_open", F.lit(False)).alias("admitted"))
