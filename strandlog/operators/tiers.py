"""Storage tiers: which copy of an entry or a file is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators.segments import first_of

#: Tiers in the order in which they are tried for an entry.
PRIORITY = ("MEMORY", "DISK_STORE", "DISK_WAL", "CLOUD")


def stitched(tiers: dict[str, DataFrame]) -> DataFrame:
    """One log from overlapping tiers (queue, entry_id, data), each row with its source; an entry comes from the first tier that has it.

    Filters on queue and entry_id pass to every tier's scan, as the window is partitioned by them."""
    rows = None
    for place, name in enumerate(PRIORITY):
        if name in tiers:
            tier = tiers[name].select("queue", "entry_id", "data", F.lit(name).alias("source"), F.lit(place).alias("_pri"))
            rows = tier if rows is None else rows.unionByName(tier)
    return first_of(rows, F.col("_pri"), "queue", "entry_id").drop("_pri")


def file_source(files: DataFrame) -> DataFrame:
    """For each (queue, file_id) of files (queue, file_id, src) the tier that is read: store, else WAL, else cloud."""
    order = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("src"))
    return first_of(files, order, "queue", "file_id").select("queue", "file_id", "src")
