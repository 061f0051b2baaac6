"""Retention by size and offload to a remote tier, on the segment catalog (one row a file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_sizes(segments: DataFrame, limit: int) -> DataFrame:
    total = segments.groupBy("queue").agg(F.sum("bytes").cast("bigint").alias("bytes"), F.count("*").alias("files"))
    return total.withColumn("over_limit", F.col("bytes") > limit)


def victims(segments: DataFrame, max_bytes: int, offloaded: int | None = None) -> DataFrame:
    """The oldest files to delete until a queue is within max_bytes; with a remote tier only up to the last offloaded id."""
    by_age = Window.partitionBy("queue").orderBy("file_id")
    freed = F.coalesce(F.sum("bytes").over(by_age.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = segments.withColumns({"_freed": freed, "_total": F.sum("bytes").over(Window.partitionBy("queue"))})
    doomed = sized.where(F.col("_freed") < F.col("_total") - max_bytes)
    return (doomed if offloaded is None else doomed.where(F.col("file_id") <= offloaded)).select("queue", "file_id", "bytes")


def pending_uploads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files that the remote tier lacks or has with another size."""
    return local.join(remote.select("queue", "file_id", "bytes"), ["queue", "file_id", "bytes"], "left_anti").select("queue", "file_id")


def latest_offloaded(remote: DataFrame) -> DataFrame:
    return remote.groupBy("queue").agg(F.max("file_id").alias("latest"))


def limit_holds(max_bytes: Column, wal_bytes: int) -> Column:
    """Whether a queue's limit holds three files."""
    return max_bytes >= 3 * wal_bytes


def check_limits(max_bytes: int, wal_bytes: int) -> None:
    """A queue's limit must hold three files."""
    if max_bytes < 3 * wal_bytes:
        raise ValueError(f"the size limit {max_bytes} is below three files of {wal_bytes} bytes")
