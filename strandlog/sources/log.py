"""Log tables: Parquet with (queue, entry_id, data, ...), and adapters from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.numbering import dense
from strandlog.operators.segments import catalog
from strandlog.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_table(rows: DataFrame, queue: Column, order: str, data: Column, *more: str) -> DataFrame:
    """A log of a table's rows: queue, entry_id (from 0, dense, in the order of an integer column), data and further columns."""
    named = rows.select(queue.alias("queue"), F.col(order).alias("_order"), data.alias("data"), *more)
    return dense(named, ["queue"], "_order").select("queue", "entry_id", "data", *more)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log, numbered once for a state of their files and kept as a log table: reads prune its queues and ids."""
    source = f"{sf_dir}/events.parquet"
    numbered = lambda: from_table(table(spark, sf_dir, "events"), F.col("event_type"), "event_id", F.col("props"), "ts")
    path = shared.once(spark, f"log-{shared.state(spark, source)}", lambda part: write_log(numbered(), part))
    return read_log(spark, path, "queue string, entry_id bigint, data string, ts timestamp_ntz" if dict(table(spark, sf_dir, "events").dtypes)["ts"] == "timestamp_ntz" else "queue string, entry_id bigint, data string, ts timestamp")


def events_catalog(spark: SparkSession, sf_dir: str, per_file: int) -> DataFrame:
    """The segment catalog of from_events, likewise kept."""
    log = from_events(spark, sf_dir)
    path = shared.once(spark, f"segments-{per_file}-{shared.state(spark, f'{sf_dir}/events.parquet')}", lambda part: catalog(log, per_file).write.parquet(part))
    return spark.read.schema("queue string, file_id bigint, first_id bigint, last_id bigint, num_entries bigint, bytes bigint").parquet(path)


def write_log(log: DataFrame, path: str, files: int | None = None) -> None:
    """Append to a Parquet log: a folder a queue, rows sorted so that files' id ranges are narrow and scans skip by them."""
    n = [files] if files else []
    log.repartitionByRange(*n, "queue", "entry_id").sortWithinPartitions("queue", "entry_id").write.mode("append").partitionBy("queue").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """schema: the log's, so that nothing is read to infer it and a queue's name stays text."""
    log = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return log.select("queue", *[c for c in log.columns if c != "queue"])
