"""Appends: ids of a batch, the order in which arrivals are released, and acknowledgement of flushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.numbering import dense, first_gap
from strandlog.operators.segments import RECORD_OVERHEAD
from strandlog.sources.shared import written


def assign_ids(batch: DataFrame, last: DataFrame, pos: str = "pos") -> DataFrame:
    """batch (queue, pos, ...) with entry_id: contiguous from the queue's last id + 1, in the order of pos; from 0 in a new queue."""
    numbered = dense(batch, ["queue"], pos, "_place").join(last.select("queue", F.col("last_id").alias("_last")), "queue", "left")
    return numbered.withColumn("entry_id", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_place")).select(*batch.columns, "entry_id")


def release(arrivals: DataFrame, last_written: int = -1, *, most_queues: int = 100_000) -> DataFrame:
    """The arrivals that can be written: the whole run of ids after last_written, each once. What is beyond a gap waits."""
    gap = written(first_gap(arrivals.select("queue", "entry_id"), ["queue"], "entry_id", last_written + 1), "gaps")
    told = gap.agg(F.count("*").alias("n"), F.max("gap").alias("end")).first()
    gap = F.broadcast(gap) if told.n <= most_queues else gap
    new = arrivals.where(F.col("entry_id").between(last_written + 1, (told.end or 0) - 1))
    return new.join(gap, "queue").where("entry_id < gap").select(*arrivals.columns).dropDuplicates(["queue", "entry_id"])


def acknowledge(log: DataFrame, flush: Column) -> DataFrame:
    """queue, flush, acked_id, n: of the entries that one flush writes only the last is acknowledged."""
    return log.groupBy("queue", flush.alias("flush")).agg(F.max("entry_id").alias("acked_id"), F.count("*").alias("n"))


def notify(log: DataFrame, after: int, batch: int) -> DataFrame:
    """queue, batch, n, last_sent: what a subscriber's callback gets, batch by batch."""
    rows = log.where(F.col("entry_id") > after)
    return rows.groupBy("queue", F.expr(f"entry_id div {batch}").alias("batch")).agg(F.count("*").alias("n"), F.max("entry_id").alias("last_sent"))


def evict_acked(log: DataFrame, acked: int, budget: int, segments: DataFrame | None = None) -> DataFrame:
    """What stays in memory: if a queue uses more than its budget, all that is acknowledged goes. With a segment catalog the sizes
    come from there, and the log is read once."""
    if segments is None:
        used = log.groupBy("queue").agg(F.sum(F.length("data")).alias("_used"))
    else:
        used = segments.groupBy("queue").agg((F.sum("bytes") - RECORD_OVERHEAD * F.sum("num_entries")).alias("_used"))
    return log.join(used, "queue").where(~((F.col("_used") > budget) & (F.col("entry_id") <= acked))).select(*log.columns)


def memory_budgets(queues: DataFrame, created: str, total: int) -> DataFrame:
    """queue, budget: the total divided by the number of queues that existed when it was created (the first two get all).

    queues: one row a queue, a catalog; `created` orders them."""
    existing = F.row_number().over(Window.orderBy(created)).cast("bigint") - 1
    return queues.withColumn("_existing", existing).select("queue", F.floor(F.lit(total) / F.greatest("_existing", F.lit(1))).cast("bigint").alias("budget"))


def write_results(writes: DataFrame, last: DataFrame) -> DataFrame:
    """write_id, result and the ids given, first_id to last_id, of writes (write_id, queue, packets) that come in the order of
    write_id. Without packets nothing is written and the result is WR_DONE; without a queue or packets at all it is WR_SERVER_ERROR."""
    sized = writes.select("write_id", "queue", F.when(F.col("queue").isNotNull(), F.size("packets")).alias("_n"))
    sized = sized.withColumn("_n", F.when(F.col("_n") >= 0, F.col("_n")))
    by = Window.partitionBy("queue").orderBy("write_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0))).join(last.select("queue", F.col("last_id").alias("_last")), "queue", "left")
    first = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_before")
    some = F.col("_n") > 0
    return placed.select(
        "write_id", F.when(F.col("_n").isNull(), F.lit("WR_SERVER_ERROR")).otherwise(F.lit("WR_DONE")).alias("result"),
        F.when(some, first).cast("bigint").alias("first_id"), F.when(some, first + F.col("_n") - 1).cast("bigint").alias("last_id"),
    )
