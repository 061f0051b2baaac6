"""The registered queries: each operator on the given tables. A queue is an event type, its entries that type's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import ids as I
from strandlog.functions import queues as Q
from strandlog.operators import append, read, recovery, retention, segments, tiers
from strandlog.operators.numbering import nearest_rank
from strandlog.operators.read import SHIFT_FROM_TAIL, ReadSpec
from strandlog.sources import files, shared, store
from strandlog.sources.log import events_catalog, from_events, from_table, table, write_log
from strandlog.streaming import follow as streams

SEED = bytes(range(32))
PER_FILE = 64


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir)


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("queue", "entry_id", "data")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_catalog(spark, sf_dir, PER_FILE)


def _read(spec: ReadSpec):
    return lambda spark, sf_dir: _entries(read.read(_log(spark, sf_dir), spec))


def _tails(shift: int, limit: int, step: int = 1):
    return lambda spark, sf_dir: _entries(read.read_tails(_log(spark, sf_dir), shift, limit, step, _segments(spark, sf_dir)))


def read_before_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _log(spark, sf_dir).where("entry_id >= 640")
    return _entries(read.read(kept, ReadSpec("click", 600, 20, 7)))


def read_cross_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    last = read.last_ids(log, _segments(spark, sf_dir)).select("queue", F.expr("last_id - 49").alias("_start"), F.col("last_id").alias("_end"), F.lit(1).alias("_step"))
    recent = read.in_ranges(log, last)
    held = {"CLOUD": log.where("entry_id < 800"), "DISK_STORE": log.where("entry_id between 640 and 1599"), "DISK_WAL": log.where("entry_id >= 1536"), "MEMORY": recent}
    return read.read(tiers.stitched(held), ReadSpec("view", 600, 1400))


def multi_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = spark.createDataFrame(
        [(1, "click", "ABSOLUTE", 10, 5, 0), (2, "view", "SHIFT_FROM_TAIL", 9, 4, 3), (3, "nosuch", "ABSOLUTE", 0, 5, 1)], "read_id int, queue string, pos_type string, offset long, limit long, step long"
    )
    return read.read_many(_log(spark, sf_dir), reads, _segments(spark, sf_dir)).select("read_id", "queue", "entry_id", "data")


def multi_read_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No offset, no step, no limit, an unknown type, no type."""
    reads = spark.createDataFrame([(1, "click", "ABSOLUTE", None, 3, None), (2, "view", "OTHER", 4, 2, 5), (3, "view", None, 6, 3, 0), (4, "signup", "SHIFT_FROM_TAIL", None, 9, 1), (5, "click", "ABSOLUTE", 7, None, 100)], "read_id int, queue string, pos_type string, offset long, limit long, step long")
    return read.read_many(_log(spark, sf_dir), reads, _segments(spark, sf_dir)).select("read_id", "queue", "entry_id", "data")


def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for every order: of queues that exist and others, some with numbers that can't be asked."""
    reads = table(spark, sf_dir, "orders").selectExpr("o_orderkey as read_id", "case o_orderkey % 4 when 0 then 'click' when 1 then 'view' when 2 then 'nosuch' end as queue", "'ABSOLUTE' as pos_type", "o_custkey - 20 as offset", "10 as limit", "o_orderkey % 3 as step")
    return read.read_results(reads, _segments(spark, sf_dir))


def last_id_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.last_id_status(_log(spark, sf_dir), spark.createDataFrame([("click",), ("view",), ("nosuch",)], "queue string"), _segments(spark, sf_dir))


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of queues that exist, one of them without entries."""
    seg = _segments(spark, sf_dir)
    known = seg.select("queue").union(spark.createDataFrame([("fresh",)], "queue string"))
    return read.last_id_status(_log(spark, sf_dir), spark.createDataFrame([("click",), ("fresh",), ("nosuch",)], "queue string"), seg, known)


def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.frames(_log(spark, sf_dir), ReadSpec("click", 5, 10))


def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = spark.createDataFrame([(0, "click", 1990, 1), (1, "click", 1980, 3), (2, "view", 1900, 7)], "sub_id int, queue string, from_id long, step long")
    return read.fan_out(_log(spark, sf_dir), subs, _segments(spark, sf_dir)).select("sub_id", "queue", "entry_id", "data")


def batch_id_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as one batch to each queue."""
    last = read.last_ids(_log(spark, sf_dir), _segments(spark, sf_dir))
    names = [r["queue"] for r in last.select("queue").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("the same batch to over 1000 queues")
    sent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("data"), F.explode(F.array(*map(F.lit, names))).alias("queue"))
    return append.assign_ids(sent, last).select("queue", "entry_id", "data")


def wire_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write for every order, its packets the order's items; some without packets, some without a queue."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("packets"))
    queue = F.expr("case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then 'click' else 'fresh' end")
    packets = F.when(F.col("o_orderkey") % 11 == 0, F.array().cast("array<int>")).otherwise(F.col("packets").cast("array<int>"))
    writes = table(spark, sf_dir, "orders").join(items, "o_orderkey").select(F.col("o_orderkey").alias("write_id"), queue.alias("queue"), packets.alias("packets"))
    return append.write_results(writes, read.last_ids(_log(spark, sf_dir), _segments(spark, sf_dir)))


def queue_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event opens its queue, one event type in two for writing too; a write to each queue is then admitted or not."""
    opened = table(spark, sf_dir, "events").selectExpr("event_type as queue", "if(event_type < 'p' and event_id % 3 = 0, 'write', 'read') as mode")
    states = store.modes(opened)
    return store.admitted(states, states)


def ordered_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.release(_entries(_log(spark, sf_dir)).where("entry_id % 501 <> 500"))


def flush_ack_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.acknowledge(_log(spark, sf_dir), F.date_trunc("hour", "ts"))


def subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription to the log: its callback writes what it is told of each micro-batch."""
    work, log = shared.work_dir(spark), _entries(_log(spark, sf_dir))
    write_log(log, f"{work}/log", 4)

    def told(batch: DataFrame, number: int) -> bool:
        append.notify(batch, 1500, 100).write.mode("overwrite").parquet(f"{work}/told/{number}")
        return True

    streams.subscribe(streams.stream_log(spark, f"{work}/log", log.schema, 2), told, f"{work}/cursor").awaitTermination()
    got = spark.read.schema("queue string, batch bigint, n bigint, last_sent bigint").parquet(f"{work}/told/*")
    return got.groupBy("queue", "batch").agg(F.sum("n").alias("n"), F.max("last_sent").alias("last_sent"))


def mem_evict_acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.evict_acked(_log(spark, sf_dir), 1900, 17700, _segments(spark, sf_dir)).select("queue", "entry_id")


def mem_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("queue")).agg(F.min("event_id").alias("created"))
    return append.memory_budgets(created, "created", 268435456)


def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [50, 95, 99])


def latency_nearest_rank_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [50, 95, 99], "floor of (n - 1) p")


def queue_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.withColumn("queue_path", Q.resolve(F.col("event_type"), "inst0"))


def queue_config_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("/inst0/"), "event_type").alias("queue")).distinct()
    rules = [(1, "/inst0/c*", "NONE", "NONE", True), (2, "/inst0/*", "ZSTD", "AES", True)]
    return Q.settings(names, rules).select("queue", F.col("compression").alias("codec"))


def f_segment_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    return seg.select("queue", "file_id", Q.segment_path("/data", Q.resolve(F.col("queue"), "inst0"), "wal", F.col("file_id")).alias("path"))


def f_cloud_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.withColumn("k", Q.cloud_key("fleet/", Q.resolve(F.col("event_type"), "inst0"), F.lit(4096 + 160)))


def file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _segments(spark, sf_dir).select((F.col("file_id") * 397).alias("fid")).distinct()
    return ids.select("fid", I.file_path(F.col("fid"), ".store").alias("path"))


def f_path_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919).alias("id"))
    return ids.select("id", I.path_to_id(I.file_path(F.col("id"), ".wal")).alias("back"))


def f_uint_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919).alias("id"))
    raw = I.to_little_endian(F.col("id"), 8)
    return ids.select("id", F.lower(F.hex(raw)).alias("le"), I.from_little_endian(raw, 8).alias("back"))


def f_uint_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond 2^64 in 16 bytes: width, least significant byte first, and back."""
    wide = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("decimal(38,0)") * F.lit("123456789012345678901").cast("decimal(21,0)")).cast("decimal(38,0)").alias("v"))
    raw = I.to_little_endian(F.col("v"), 16)
    return wide.select(F.col("v").cast("string").alias("v"), I.width(F.col("v")).alias("size_bytes"), F.lower(F.hex(raw)).alias("le"), I.from_little_endian_wide(raw, 16).cast("string").alias("back"), I.from_little_endian(raw, 16).alias("narrow"))


def f_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step"))
    ours = I.in_step(F.col("id"), F.lit(100), F.col("step"))
    return rows.select("id", "step", ((F.col("step") == 1) | ours).alias("in_step_ref"), ours.alias("in_step_ours"))


def f_uint_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("a", "b", I.add(a, b).alias("s"), I.subtract(a, b).alias("d"), I.remainder(a, F.greatest(b, F.lit(1))).alias("r"), I.middle(a, b).alias("mid"))


def f_uint_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("n"))
    a, b, wide = F.col("a"), F.col("b"), F.col("b").cast("decimal(38,0)")
    big = F.when(F.col("n") == 1, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("0000000000000000000")))
    return rows.select("a", "b", "n", I.increment(a).alias("up"), I.decrement(a).alias("down"), I.compare(a, wide).alias("sign"), I.narrowed(big).alias("narrow"), I.is_width(F.col("n")).alias("is_width"), I.can_fit(a, 1).alias("one_byte"), (I.wide_key(a) < I.wide_key(wide)).alias("key_less"))


def f_uint_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("l_orderkey") * F.col("l_orderkey") * 97).alias("v")
    return table(spark, sf_dir, "lineitem").select(value).distinct().withColumn("size_bytes", I.width(F.col("v")))


def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every entry of the log."""
    return segments.lookup(_log(spark, sf_dir).select("queue", "entry_id"), _segments(spark, sf_dir))


def tier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir).select("queue", "file_id")
    held = seg.where("file_id % 3 <> 0").withColumn("src", F.lit("DISK_STORE")).union(seg.where("file_id % 2 = 0").withColumn("src", F.lit("DISK_WAL"))).union(seg.withColumn("src", F.lit("CLOUD")))
    return tiers.file_source(held)


def tier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("file_id") <= 10, "CLOUD").when(F.col("file_id") <= 25, "DISK_STORE").otherwise("DISK_WAL")
    return segments.bounds(_segments(spark, sf_dir).withColumn("tier", tier), "tier")


def file_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir).select("queue", "file_id", "last_id")
    both = seg.where("file_id >= 20").withColumn("src", F.lit("WAL")).unionByName(seg.where("file_id <= 24").withColumn("last_id", F.col("last_id") - 1).withColumn("src", F.lit("STORE")))
    return segments.file_end(both)


def nearest_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    emptied = F.when(F.col("file_id") % 5 >= 3, 0).otherwise(F.col("num_entries"))
    return segments.nearest_nonempty(_segments(spark, sf_dir).withColumn("num_entries", emptied))


def queue_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.queue_start(_segments(spark, sf_dir).where("file_id >= 5"))


def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_table(table(spark, sf_dir, "documents"), F.col("source"), "doc_id", F.lit(None).cast("string"), "n_chars")
    return segments.rotate(log.select("queue", "entry_id", F.col("n_chars").alias("n")), 20000)


def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _entries(_log(spark, sf_dir)).withColumns({"file_id": F.expr(f"entry_id div {PER_FILE}") + 1, "ok": F.expr("entry_id % 150 <> 149")})
    return recovery.valid_prefix(records).select("queue", "file_id", "entry_id", "data")


def retention_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.victims(_segments(spark, sf_dir), 40000, 12)


def offload_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    remote = seg.where("file_id <= 10").withColumn("bytes", F.when(F.col("file_id") == 7, F.col("bytes") - 1).otherwise(F.col("bytes")))
    return retention.pending_uploads(seg, remote)


def latest_offloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.latest_offloaded(_segments(spark, sf_dir).where("file_id <= 10 or file_id % 7 = 0"))


def limit_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = retention.queue_sizes(_segments(spark, sf_dir), 0)
    return size.select("queue", retention.limit_holds(F.col("bytes"), 20000).alias("holds"))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.compact(_entries(_log(spark, sf_dir)), f"{shared.work_dir(spark)}/compact")


def decode_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log encoded to sealed store files and decoded again, signatures verified."""
    stored = files.to_store(files.encode_wal_files(_log(spark, sf_dir), 4096), SEED)
    back = files.decode_wal_files(files.from_store(stored, SEED, verify=True, skip_corrupt=False))
    return back.select("queue", "entry_id", F.col("data").cast("string").alias("data"))


def corrupt_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose id divides by 5 are cut off inside their last record; what is sound before it is read, and nothing fails."""
    wal = files.encode_wal_files(_log(spark, sf_dir), PER_FILE)
    size = F.length("content")
    cut = wal.withColumn("content", F.when(F.col("file_id") % 5 == 0, F.substring("content", F.lit(1), (size - 1).cast("int"))).otherwise(F.col("content")))
    return files.decode_wal_files(cut).select("queue", "file_id", "entry_id", F.col("data").cast("string").alias("data"))


def _wal_store(spark: SparkSession, sf_dir: str, per_file: int) -> str:
    """A store's folder with the log in WAL files."""
    root = shared.work_dir(spark)
    named = _log(spark, sf_dir).withColumn("queue", F.concat(F.lit("/"), "queue"))
    files.write_files(files.encode_wal_files(named, per_file), root, "wal").write.format("noop").mode("overwrite").save()
    return root


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("queue", F.expr("substring(queue, 2)"))


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(files.list_files(spark, _wal_store(spark, sf_dir, 1024), "wal")).select("queue", "file_id")


def wal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of ids with a stride, out of WAL files."""
    wal = files.read_files(spark, _wal_store(spark, sf_dir, PER_FILE), "wal")
    return _plain(files.decode_wal_files(wal, 100, 1500, 7)).select("queue", "file_id", "entry_id", F.col("data").cast("string").alias("data"))


def wal_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and range of every WAL file; those whose id divides by 5 have lost their last byte, those by 7 their content."""
    wal = files.read_files(spark, _wal_store(spark, sf_dir, PER_FILE), "wal")
    cut = F.expr("case when file_id % 7 = 0 then cast('' as binary) when file_id % 5 = 0 then substring(content, 1, length(content) - 1) else content end")
    return _plain(files.wal_ranges(wal.withColumn("content", cut)))


def wal_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers from the first bytes of files, asked for all files of the catalog and one more of each queue."""
    root, seg = _wal_store(spark, sf_dir, PER_FILE), _segments(spark, sf_dir)
    asked = seg.select("queue", "file_id").union(seg.groupBy("queue").agg(F.max("file_id") + 1)).withColumn("queue", F.concat(F.lit("/"), "queue"))
    there = files.read_heads(asked, root, "wal", 128).where("content is not null")
    return _plain(files.wal_headers(there, asked))


def store_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from the first bytes of sealed store files, and the WAL header inside each."""
    root = shared.work_dir(spark)
    named = _log(spark, sf_dir).withColumn("queue", F.concat(F.lit("/"), "queue"))
    made = shared.written(files.write_files(files.to_store(files.encode_wal_files(named, PER_FILE), SEED), root, "store"), "made")
    ranges = files.store_ranges(files.read_heads(made, root, "store"))
    inside = files.wal_headers(files.from_store(files.read_files(spark, root, "store"), SEED)).select("queue", "file_id", "before", "id_width")
    return _plain(ranges.join(inside, ["queue", "file_id"]))


def store_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed files, one in five with a changed last byte: which are left out."""
    stored = files.to_store(files.encode_wal_files(_log(spark, sf_dir), PER_FILE), SEED)
    last = F.expr("unhex(lpad(hex((conv(hex(substring(content, length(content), 1)), 16, 10) + 1) % 256), 2, '0'))")
    bad = stored.withColumn("content", F.when(F.col("file_id") % 5 == 0, F.concat(F.expr("substring(content, 1, length(content) - 1)"), last)).otherwise(F.col("content")))
    return files.store_problems(shared.written(bad, "damaged"), SEED)


def wal_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAL files compacted into store files, twice; then all is read back, from what tier."""
    root = _wal_store(spark, sf_dir, PER_FILE)
    store.compact_wal(spark, root, SEED)
    store.compact_wal(spark, root, SEED)
    sealed = files.decode_wal_files(files.from_store(files.read_files(spark, root, "store"), SEED)).withColumn("source", F.lit("DISK_STORE"))
    live = files.decode_wal_files(files.read_files(spark, root, "wal")).withColumn("source", F.lit("DISK_WAL"))
    return _plain(sealed.union(live)).select("queue", "file_id", "entry_id", F.col("data").cast("string").alias("data"), "source")


def retention_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left on disk after retention; one queue is truncated before."""
    root = _wal_store(spark, sf_dir, PER_FILE)
    store.truncate(spark, root, "/signup")
    store.retain(spark, root, 40000)
    return _plain(store.sizes(spark, root))


def _followed(spec: ReadSpec | None, queue: str = "click", cut: int = 1900, step: int = 1):
    """Half of the log is there when the follow begins, the rest is appended; the stream runs until it has all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        work, log = shared.work_dir(spark), _entries(_log(spark, sf_dir)).where(F.col("queue") == queue)
        write_log(log.where(F.col("entry_id") < cut), f"{work}/log", 2)
        last = read.last_id(spark.read.schema(log.schema).parquet(f"{work}/log"), queue)
        stream = streams.stream_log(spark, f"{work}/log", log.schema)
        rows = streams.follow(stream, spec, last) if spec else streams.follow_live(stream, queue, last, step)
        for _ in range(2):
            streams.to_table(rows, f"{work}/out", f"{work}/cursor").awaitTermination()
            if _ == 0:
                write_log(log.where(F.col("entry_id") >= cut), f"{work}/log", 2)
        return spark.read.schema(log.schema).parquet(f"{work}/out")

    return run


QUERIES = {
    "read_absolute": _read(ReadSpec("click", 100, 50)),
    "read_absolute_step": _read(ReadSpec("view", 7, 40, 20)),
    "read_overshoot": _read(ReadSpec("signup", 1900, 100000)),
    "read_past_end": _read(ReadSpec("click", 1000000, 10)),
    "read_tail": _tails(7, 8),
    "read_tail_clamped": _tails(1000000, 5),
    "read_tail_step": _tails(60, 4, 13),
    "segments": _segments,
    "file_bounds": lambda spark, sf_dir: segments.bounds(_segments(spark, sf_dir)),
    "recover_end": lambda spark, sf_dir: recovery.write_target(_segments(spark, sf_dir)),
    "compaction_candidates": lambda spark, sf_dir: segments.compaction_candidates(_segments(spark, sf_dir)),
    "queue_size": lambda spark, sf_dir: retention.queue_sizes(_segments(spark, sf_dir), 60000),
    "follow_absolute": _followed(ReadSpec("click", 1500, step=3)),
    "follow_tail": _followed(ReadSpec("click", 60, step=7, position=SHIFT_FROM_TAIL)),
    "follow_live": _followed(None, step=2),
} | {
    f.__name__: f
    for f in (
        read_before_first, read_cross_tier, multi_read, multi_read_defaults, read_results, last_id_status, queue_status, read_frames, fanout, batch_id_assign, wire_write, queue_modes, ordered_release,
        flush_ack_coalesce, subscribe, mem_evict_acked, mem_budget, latency_nearest_rank, latency_nearest_rank_n1, queue_resolve, queue_config_first_match, f_segment_path, f_cloud_key, file_path,
        f_path_to_id, f_uint_le, f_uint_wide, f_in_step, f_uint_arith, f_uint_more, f_uint_width, file_lookup, tier_fallback, tier_bounds, file_end, nearest_nonempty, queue_start, segment_assign,
        valid_prefix, retention_victims, offload_pending, latest_offloaded, limit_holds, compact, decode_store, corrupt_skip, list_files, wal_scan, wal_probe, wal_header, store_probe, store_problems,
        wal_to_store, retention_apply,
    )
}
