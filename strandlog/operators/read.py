"""Positional reads: absolute and tail-relative, bounded, with a stride.

A log is a DataFrame (queue, entry_id, data, ...). A read covers `limit` places of a grid, start, start + step, ...; places
without an entry stay empty, so a read may return fewer rows and one past the end returns none. Bounds become literals, so the
id range reaches the Parquet scan; only the stride is left for the rows that it returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.ids import in_step
from strandlog.operators.numbering import dense

ABSOLUTE, SHIFT_FROM_TAIL = "ABSOLUTE", "SHIFT_FROM_TAIL"


@dataclass(frozen=True)
class ReadSpec:
    """offset: the first id, or how far before the last one; limit 0: without end, for streams; step 0: 1."""

    queue: str
    offset: int = 0
    limit: int = 0
    step: int = 1
    position: str = ABSOLUTE

    def start(self, last: int | None) -> int:
        return self.offset if self.position != SHIFT_FROM_TAIL else max((-1 if last is None else last) - self.offset, 0)

    def bounds(self, last: int | None) -> tuple[int, int | None]:
        start = self.start(last)
        return start, start + (self.limit - 1) * max(self.step, 1) if self.limit else None


def last_ids(log: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """queue, last_id: from the segment catalog if there is one, which needs no scan of the log."""
    return (segments.groupBy("queue").agg(F.max("last_id").alias("last_id"))) if segments is not None else log.groupBy("queue").agg(F.max("entry_id").alias("last_id"))


def last_id(log: DataFrame, queue: str, segments: DataFrame | None = None) -> int | None:
    source, column = (segments, "last_id") if segments is not None else (log, "entry_id")
    return source.where(F.col("queue") == queue).agg(F.max(column)).first()[0]


def read(log: DataFrame, spec: ReadSpec, segments: DataFrame | None = None) -> DataFrame:
    """The rows of one bounded read. The last id is looked up only for a tail read, and put in as a literal."""
    if not spec.limit:
        raise ValueError("a read without limit is a follow: see strandlog.streaming.follow")
    start, end = spec.bounds(last_id(log, spec.queue, segments) if spec.position == SHIFT_FROM_TAIL else None)
    rows = log.where((F.col("queue") == spec.queue) & F.col("entry_id").between(start, end))
    return rows if spec.step <= 1 else rows.where((F.col("entry_id") - start) % spec.step == 0)


def in_ranges(log: DataFrame, asked: DataFrame, *, width: int = 1 << 12, most_blocks: int = 200_000) -> DataFrame:
    """The log's rows in any of the ranges asked (queue, _start, _end, _step and further columns, which come first).

    One look at the ranges gives literal bounds for the scan. The join is an equi-join on blocks of ids, so a queue's rows meet
    only the ranges near them, and a queue of any size spreads over tasks; the blocks are broadcast if they are counted and few."""
    asked = asked.where("_end >= _start")
    told = asked.agg(F.count("*").alias("n"), F.min("_start").alias("lo"), F.max("_end").alias("hi"), F.max(F.expr("_end - _start")).alias("most"), F.sum(F.expr("_end - _start")).alias("all")).first()
    while told.n and told.most // width > 1024:
        width *= 2
    rows = log.where(F.col("entry_id").between(told.lo, told.hi)) if told.n else log.where("false")
    blocks = asked.withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {width}"), F.expr(f"_end div {width}"))))
    if told.n and told.all // width + 2 * told.n <= most_blocks:
        blocks = F.broadcast(blocks)
    found = rows.withColumn("_block", F.expr(f"entry_id div {width}")).join(blocks, ["queue", "_block"]).where(F.col("entry_id").between(F.col("_start"), F.col("_end")))
    more = [c for c in asked.columns if c not in ("queue", "_start", "_end", "_step")]
    return found.where(in_step(F.col("entry_id"), F.col("_start"), F.col("_step"))).select(*more, *log.columns)


def read_tails(log: DataFrame, shift: int, limit: int, step: int = 1, segments: DataFrame | None = None) -> DataFrame:
    """The same tail read of every queue."""
    start = F.greatest(F.col("last_id") - shift, F.lit(0))
    end = F.least(start + (limit - 1) * max(step, 1), F.col("last_id"))
    return in_ranges(log, last_ids(log, segments).select("queue", start.alias("_start"), end.alias("_end"), F.lit(step).alias("_step")))


def read_many(log: DataFrame, reads: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Rows (read_id, ...) of a table of reads (read_id, queue, pos_type, offset, limit, step); unknown queues give none.

    A missing offset is 0, a type other than SHIFT_FROM_TAIL is absolute, step 0 is 1; a limit of 0 or none is all there is."""
    off, step = F.coalesce("offset", F.lit(0)), F.greatest(F.coalesce("step", F.lit(1)), F.lit(1))
    start = F.when(F.col("pos_type") == SHIFT_FROM_TAIL, F.greatest(F.col("last_id") - off, F.lit(0))).otherwise(off)
    asked = reads.join(last_ids(log, segments), "queue").withColumns({"_start": start, "_step": step})
    end = F.when(F.col("limit") > 0, F.least(F.col("_start") + (F.col("limit") - 1) * F.col("_step"), F.col("last_id"))).otherwise(F.col("last_id"))
    return in_ranges(log, asked.select("read_id", "queue", "_start", end.alias("_end"), "_step"))


def last_id_status(log: DataFrame, names: DataFrame, segments: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """queue, last_id and OK, QUEUE_EMPTY or QUEUE_NOT_FOUND for each name. known: the queues that exist, with entries or without."""
    found = names.join(last_ids(log, segments), "queue", "left")
    absent = F.lit("QUEUE_NOT_FOUND")
    if known is not None:
        found = found.join(known.select("queue", F.lit(True).alias("_known")).distinct(), "queue", "left")
        absent = F.when(F.col("_known"), F.lit("QUEUE_EMPTY")).otherwise(absent)
    return found.select("queue", "last_id", F.when(F.col("last_id").isNull(), absent).otherwise(F.lit("OK")).alias("status"))


#: What a read or a write can end with.
READ_RESULTS = ("RR_START", "RR_ENTRY", "RR_END", "RR_QUEUE_NOT_FOUND", "RR_NOT_FOUND", "RR_SERVER_ERROR")
WRITE_RESULTS = ("WR_DONE", "WR_SERVER_ERROR")


def read_results(reads: DataFrame, segments: DataFrame) -> DataFrame:
    """read_id and the result that ends each read (read_id, queue, pos_type, offset, limit, step): RR_END, also for a read that finds
    nothing; RR_QUEUE_NOT_FOUND; RR_SERVER_ERROR for what can't be asked (a negative number, no queue)."""
    known = segments.select("queue").distinct().withColumn("_known", F.lit(True))
    wrong = F.expr("queue is null or coalesce(offset, 0) < 0 or coalesce(limit, 0) < 0 or coalesce(step, 0) < 0")
    result = F.when(wrong, F.lit("RR_SERVER_ERROR")).when(F.col("_known"), F.lit("RR_END")).otherwise(F.lit("RR_QUEUE_NOT_FOUND"))
    return reads.join(known, "queue", "left").select("read_id", result.alias("result"))


def frames(log: DataFrame, spec: ReadSpec) -> DataFrame:
    """The response to one read as rows (seq, result, entry_id, data): a start, its entries, an end."""
    entries = dense(read(log, spec), ["queue"], "entry_id", "_seq").select((F.col("_seq") + 1).alias("seq"), F.lit("RR_ENTRY").alias("result"), "entry_id", "data")
    nothing = [F.lit(None).cast("bigint").alias("entry_id"), F.lit(None).cast(log.schema["data"].dataType).alias("data")]
    start = log.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit("RR_START").alias("result"), *nothing)
    end = read(log, spec).agg((F.count("*") + 1).alias("seq")).select("seq", F.lit("RR_END").alias("result"), *nothing)
    return start.unionByName(entries).unionByName(end)


def fan_out(log: DataFrame, subs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Rows (sub_id, ...) that each subscription (sub_id, queue, from_id, step) gets."""
    asked = subs.join(last_ids(log, segments), "queue")
    return in_ranges(log, asked.select("sub_id", "queue", F.col("from_id").alias("_start"), F.col("last_id").alias("_end"), F.col("step").alias("_step")))
