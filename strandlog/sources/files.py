"""Segment files as DataFrames: encoding logs to files, decoding files to logs, listing directories.

Files are rows (queue, file_id, content); AES-GCM runs in Spark's own aes_encrypt and aes_decrypt, the rest in Arrow batches. A
segment is bounded by its file size, so one file is one row of work."""

from __future__ import annotations

import lzma
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.ids import file_path, path_to_id
from strandlog.sources import codec, crypto

FILE = "queue string, file_id long, content binary"


#: Rows that are turned into Python objects at once, and bytes after which a batch is passed on: a worker's memory doesn't grow with
#: the number of files, nor with their sizes beyond one slice of files.
SLICE, PASS_ON = 32, 4_000_000
_KINDS = {"queue": pa.string(), "path": pa.string(), "status": pa.string(), "deleted": pa.bool_(), "content": pa.binary(), "key": pa.binary(), "nonce": pa.binary()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from batch.slice(at, SLICE).to_pylist()


def _batches(rows: Iterable[dict | None], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows but None as batches of bounded size."""
    schema = pa.schema([(n, _KINDS.get(n, pa.int64())) for n in names])
    out, size = [], 0
    for x in rows:
        if x is not None:
            out.append(x)
            size += len(x.get("content") or b"") + 100
        if size > PASS_ON:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _mapped(files: DataFrame, columns: list[str], step, names: list[str], schema: str) -> DataFrame:
    """files' columns through step, from an iterator of rows to another. A step right after a step runs in the same worker, so a
    task has one worker for them all."""
    source, before = getattr(files, "_step", None) or (files.select(*columns), _rows)
    run = lambda batches: step(before(batches))
    out = source.mapInArrow(lambda it: _batches(run(it), names), schema)
    out._step = source, run
    return out


def _each(make):
    """A step that makes a row of a row; None is left out."""
    return lambda rows: (x for x in map(make, rows) if x is not None)


def _name(file_id: int, tier: str) -> str:
    """As ids.file_path."""
    digits = f"{file_id:x}"
    digits = digits.zfill(-(-len(digits) // 3) * 3)
    return "/".join(digits[i : i + 3] for i in range(0, len(digits), 3)) + f".{tier}"


def encode_wal_files(log: DataFrame, per_file: int) -> DataFrame:
    """queue, file_id, content, before, entries: the log in WAL files of per_file entries. Spark sorts the entries, and a file's are
    encoded when its last one has come by."""
    rows = log.select("queue", (F.expr(f"entry_id div {per_file}") + 1).alias("file_id"), "entry_id", F.col("data").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        entries = (x for batch in batches for at in range(0, batch.num_rows, 1024) for x in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns]))
        for (queue, file_id), group in groupby(entries, key=itemgetter(0, 1)):
            own = [x[2:] for x in group]
            yield {"queue": queue, "file_id": file_id, "content": codec.encode_wal(own), "before": own[0][0], "entries": len(own)}

    names = ["queue", "file_id", "content", "before", "entries"]
    source = rows.repartition("queue", "file_id").sortWithinPartitions("queue", "file_id", "entry_id", "data")
    out = source.mapInArrow(lambda it: _batches(run(it), names), FILE + ", before long, entries long")
    out._step = source, run
    return out


def to_store(wal: DataFrame, seed: bytes, compression: int = codec.ZSTD, encryption: int = codec.AES, signed: bool = True) -> DataFrame:
    """Store files of WAL files (queue, file_id, content, before, entries): compressed, then encrypted, then signed."""

    def squeeze(x: dict) -> dict:
        key, nonce = crypto.file_key(seed, x["queue"], x["file_id"])
        return x | {"content": codec.compress(x["content"], compression), "key": key, "nonce": nonce}

    def finish(x: dict) -> dict:
        return {"queue": x["queue"], "file_id": x["file_id"], "content": codec.seal(codec.store_header(compression, encryption, x["before"], x["entries"]), x["content"], seed if signed else None)}

    names = ["queue", "file_id", "content", "before", "entries"]
    packed = _mapped(wal, names, _each(squeeze), [*names, "key", "nonce"], FILE + ", before long, entries long, key binary, nonce binary")
    if encryption == codec.AES:
        packed = packed.withColumn("content", F.expr("aes_encrypt(content, key, 'GCM', 'DEFAULT', nonce)"))
    return _mapped(packed, names, _each(finish), ["queue", "file_id", "content"], FILE)


#: What a damaged file can raise; anything else, such as a missing module, is an error of ours.
DAMAGE = (ValueError, struct.error, EOFError, lzma.LZMAError, zstandard.ZstdError)


def from_store(files: DataFrame, seed: bytes, verify: bool = True, skip_corrupt: bool = True) -> DataFrame:
    """The WAL files in store files. A file that is damaged, or fails verification, is left out (see store_problems); or is an error.
    verify=False is for files of the local disk only: what comes from a remote tier must be verified."""
    public = crypto.public_key(seed) if verify else None

    def unseal(x: dict) -> dict | None:
        try:
            file = codec.open_store(x["content"], public)
        except DAMAGE:
            if skip_corrupt:
                return None
            raise
        key, _ = crypto.file_key(seed, x["queue"], x["file_id"])
        return {"queue": x["queue"], "file_id": x["file_id"], "content": file.content, "entries": file.compression, "before": file.encryption, "key": key}

    def expand(x: dict) -> dict | None:
        try:
            return {"queue": x["queue"], "file_id": x["file_id"], "content": codec.decompress(x["content"], x["entries"])}
        except DAMAGE:
            if skip_corrupt:
                return None
            raise

    opened = _mapped(files, ["queue", "file_id", "content"], _each(unseal), ["queue", "file_id", "content", "entries", "before", "key"], FILE + ", entries long, before long, key binary")
    decrypt = "try_aes_decrypt" if skip_corrupt else "aes_decrypt"
    plain = opened.withColumn("content", F.expr(f"if(before = {codec.AES}, {decrypt}(content, key, 'GCM'), content)")).where("content is not null")
    return _mapped(plain, ["queue", "file_id", "content", "entries"], _each(expand), ["queue", "file_id", "content"], FILE)


def store_problems(files: DataFrame, seed: bytes, verify: bool = True) -> DataFrame:
    """queue, file_id of the store files that from_store leaves out."""
    return files.select("queue", "file_id").join(from_store(files, seed, verify).select("queue", "file_id"), ["queue", "file_id"], "left_anti")


def decode_wal_files(wal: DataFrame, first: int = 0, last: int | None = None, step: int = 1) -> DataFrame:
    """queue, file_id, entry_id, data (binary) of each file's sound prefix."""

    source, before = getattr(wal, "_step", None) or (wal.select("queue", "file_id", "content"), _rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues, files, ids, data, size = [], [], [], [], 0
        for x in before(batches):
            for entry_id, payload in codec.decode_wal(x["content"] or b"", first, last, step):
                queues.append(x["queue"])
                files.append(x["file_id"])
                ids.append(entry_id)
                data.append(payload)
                size += len(payload) + 24
                if size > PASS_ON:
                    yield rows(queues, files, ids, data)
                    queues, files, ids, data, size = [], [], [], [], 0
        yield rows(queues, files, ids, data)

    def rows(queues: list[str], files: list[int], ids: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(queues, pa.string()), pa.array(files, pa.int64()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["queue", "file_id", "entry_id", "data"])

    return source.mapInArrow(run, "queue string, file_id long, entry_id long, data binary")


def _probed(files: DataFrame, make, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return _mapped(files, ["queue", "file_id", "content"], _each(lambda x: {"queue": x["queue"], "file_id": x["file_id"]} | make(x["content"] or b"")), names, schema)


def _header(raw: bytes) -> tuple[str, codec.WalHeader | None]:
    if not raw:
        return "EMPTY", None
    try:
        return "OK", codec.WalHeader.decode(raw)[0]
    except DAMAGE:
        return "BAD", None


def wal_headers(files: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """queue, file_id, status, data_width, id_width, before of WAL files, or of the first bytes of them. Status: OK, EMPTY (no
    bytes), BAD, or, for asked (queue, file_id) that aren't there, NOT_FOUND. Also for what from_store gives."""

    def make(raw: bytes) -> dict:
        status, header = _header(raw)
        return {"status": status} | ({"data_width": header.data_width, "id_width": header.id_width, "before": header.before} if header else {})

    found = _probed(files, make, "queue string, file_id long, status string, data_width long, id_width long, before long")
    return found if asked is None else asked.join(found, ["queue", "file_id"], "left").fillna({"status": "NOT_FOUND"})


def wal_ranges(files: DataFrame) -> DataFrame:
    """queue, file_id, status, before, first_id, last_id, num_entries of the sound prefix of WAL files."""

    def make(raw: bytes) -> dict:
        status, header = _header(raw)
        first = last = None
        n = 0
        for entry_id, _ in codec.decode_wal(raw):
            first, last, n = entry_id if first is None else first, entry_id, n + 1
        return {"status": status, "before": header and header.before, "first_id": first, "last_id": last, "num_entries": n}

    return _probed(files, make, "queue string, file_id long, status string, before long, first_id long, last_id long, num_entries long")


def sound_files(files: DataFrame) -> DataFrame:
    """queue, file_id, content, before, entries of the WAL files that have entries in their sound prefix: its first id and its length."""

    def make(x: dict) -> dict | None:
        first, n = None, 0
        for entry_id, _ in codec.decode_wal(x["content"] or b""):
            first, n = entry_id if first is None else first, n + 1
        return x | {"before": first, "entries": n} if n else None

    return _mapped(files, ["queue", "file_id", "content"], _each(make), ["queue", "file_id", "content", "before", "entries"], FILE + ", before long, entries long")


#: Bytes of a store file that hold its authentication and header.
HEAD = 256


def store_ranges(heads: DataFrame) -> DataFrame:
    """queue, file_id, status, first_id, last_id, num_entries of store files, from their first HEAD bytes."""

    def make(raw: bytes) -> dict:
        try:
            file = codec.open_store(raw)
        except DAMAGE:
            return {"status": "BAD" if raw else "EMPTY", "num_entries": 0}
        first, last = file.ids or (None, None)
        return {"status": "OK", "first_id": first, "last_id": last, "num_entries": file.entries}

    return _probed(heads, make, "queue string, file_id long, status string, first_id long, last_id long, num_entries long")


def read_heads(files: DataFrame, root: str, tier: str, size: int | None = HEAD) -> DataFrame:
    """queue, file_id, content: the first bytes of each file (queue, file_id), no more than these are read, or with size None all;
    null for a missing one.

    root: a path or URI that all workers reach."""

    def heads(rows: Iterator[dict]) -> Iterator[dict]:
        system, base = fs.FileSystem.from_uri(root)
        for x in rows:
            try:
                with system.open_input_file(f"{base.rstrip('/')}{x['queue']}/{tier}/{_name(x['file_id'], tier)}") as file:
                    content = file.read(size)
            except FileNotFoundError:
                content = None
            yield {"queue": x["queue"], "file_id": x["file_id"], "content": content}

    return _mapped(files, ["queue", "file_id"], heads, ["queue", "file_id", "content"], FILE)


def dealt(files: DataFrame) -> DataFrame:
    """files spread over some tasks a core: a list of many names is a small table, which Spark would give to one."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "queue", "file_id")


def delete_files(files: DataFrame, root: str, tier: str) -> DataFrame:
    """Delete files (queue, file_id): queue, file_id, deleted (false if it wasn't there). They are gone when the result is computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                path = f"{base.rstrip('/')}{x['queue']}/{tier}/{x['name']}"
                there = system.get_file_info(path).type == fs.FileType.File
                if there:
                    system.delete_file(path)
                out.append({"queue": x["queue"], "file_id": x["file_id"], "deleted": there})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("queue", pa.string()), ("file_id", pa.int64()), ("deleted", pa.bool_())]))

    return files.select("queue", "file_id", file_path(F.col("file_id"), f".{tier}").alias("name")).mapInArrow(run, "queue string, file_id long, deleted boolean")


def _folders(root: str, tier: str) -> list[tuple[str, bool]]:
    """The folders below root, and whether all that is below them belongs to them: those of a tier's file ids aren't looked into."""
    system, base = fs.FileSystem.from_uri(root)
    found, open_ = [], [base.rstrip("/")]
    while open_:
        folder = open_.pop()
        found.append((folder, False))
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.type == fs.FileType.Directory:
                if folder.endswith(f"/{tier}") and re.fullmatch("[0-9a-f]{3}", x.base_name):
                    found.append((x.path, True))
                else:
                    open_.append(x.path)
    return found


def list_files(spark: SparkSession, root: str, tier: str) -> DataFrame:
    """queue, file_id, bytes of the files under <root>/<queue>/<tier>/; other names, and files without bytes, are left out. The
    folders of file ids, 4096 files each, are listed by the workers."""
    pattern = re.compile(rf"(/.+)/{tier}/([^.]+\.{tier})", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)

        def inside() -> Iterator[dict]:
            for x in _rows(batches):
                for file in system.get_file_info(fs.FileSelector(x["folder"], recursive=x["whole"])):
                    if file.type == fs.FileType.File and file.size and (m := pattern.fullmatch(file.path[len(base.rstrip("/")) :])):
                        yield {"queue": m[1], "path": m[2], "bytes": file.size}

        return _batches(inside(), ["queue", "path", "bytes"])

    folders = spark.createDataFrame(_folders(root, tier), "folder string, whole boolean")
    found = folders.mapInArrow(run, "queue string, path string, bytes long")
    return found.select("queue", path_to_id(F.col("path")).alias("file_id"), "bytes").where("file_id is not null")


def read_files(spark: SparkSession, root: str, tier: str) -> DataFrame:
    """queue, file_id, content of the files under root, which workers list and then read by name."""
    return read_heads(dealt(list_files(spark, root, tier).select("queue", "file_id")), root, tier, None)


def write_files(files: DataFrame, root: str, tier: str) -> DataFrame:
    """Write files (queue, file_id, content) to <root>/<queue>/<tier>/, each under another name first and then moved, so that no
    reader sees half a file and a task that runs twice does no harm. root: a path or URI that all workers reach. When the result,
    (queue, file_id, path, bytes), is computed, the files are there."""

    def write(rows: Iterator[dict]) -> Iterator[dict]:
        system, base = fs.FileSystem.from_uri(root)
        for x in rows:
            path = f"{base.rstrip('/')}{x['queue']}/{tier}/{_name(x['file_id'], tier)}"
            part = f"{path}.{uuid.uuid4().hex}.tmp"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(part) as stream:
                stream.write(x["content"])
            system.move(part, path)
            if system.get_file_info(path).size != len(x["content"]):
                raise OSError(f"{path} isn't whole after it was written")
            yield {"queue": x["queue"], "file_id": x["file_id"], "path": path, "bytes": len(x["content"])}

    return _mapped(files, ["queue", "file_id", "content"], write, ["queue", "file_id", "path", "bytes"], "queue string, file_id long, path string, bytes long")


def offload(files: DataFrame, remote: DataFrame, root: str, tier: str) -> DataFrame:
    """Write the files that the remote listing (queue, file_id, bytes) lacks or has with another size."""
    pending = files.join(remote.select("queue", "file_id", F.col("bytes").alias("_bytes")), ["queue", "file_id"], "left").where(~F.col("_bytes").eqNullSafe(F.length("content")))
    return write_files(pending.select("queue", "file_id", "content"), root, tier)
