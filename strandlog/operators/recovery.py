"""Recovery: where a log ends, and what of a file is sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_target(segments: DataFrame) -> DataFrame:
    """queue, next_file_id, next_entry_id. A latest file without valid entries is used again; a queue without any begins at file 1, id 0.

    With a column tier, only files on local disk count: a remote copy is no place to write."""
    if "tier" in segments.columns:
        segments = segments.where("tier <> 'CLOUD'")
    full = F.col("num_entries") > 0
    ends = segments.groupBy("queue").agg(F.max("file_id").alias("latest"), F.max(F.when(full, F.col("file_id"))).alias("f"), F.max(F.when(full, F.col("last_id"))).alias("l"))
    next_file = F.when(F.col("f").isNull(), F.lit(1)).when(F.col("f") == F.col("latest"), F.col("latest") + 1).otherwise(F.col("latest"))
    return ends.select("queue", next_file.cast("bigint").alias("next_file_id"), F.coalesce(F.col("l") + 1, F.lit(0)).cast("bigint").alias("next_entry_id"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records (queue, file_id, entry_id, ..., ok) of each file before its first that isn't ok."""
    broken = records.where(~F.col("ok")).groupBy("queue", "file_id").agg(F.min("entry_id").alias("_broken"))
    sound = records.join(broken, ["queue", "file_id"], "left").where("_broken is null or entry_id < _broken")
    return sound.select(*[c for c in records.columns if c != "ok"])


def sound_by_window(records: DataFrame) -> DataFrame:
    """valid_prefix by one running minimum per file, for records that are already dealt by file."""
    so_far = F.min(F.col("ok").cast("int")).over(Window.partitionBy("queue", "file_id").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("_sound", so_far).where("_sound = 1").select(*[c for c in records.columns if c != "ok"])
