"""Helpers shared by the training-data operators.

Words are maximal runs of anything but ASCII white space (``\\x20``, ``\\x09``-``\\x0D``).
A document is named by ``(doc_id, hash of its text)`` wherever rows are joined back, so a repeated
row neither multiplies nor loses its result; a null doc_id sorts before every other.
"""

from __future__ import annotations

import atexit
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandlog-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The URI of a file with these bytes in the shared folder."""
    part = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    system, path = _file_system(spark, f"{shared_dir(spark)}/{name}")
    if not system.exists(path):
        stream = system.create(_file_system(spark, part)[1])
        stream.write(data)
        stream.close()
        system.rename(_file_system(spark, part)[1], path)
        _made.append((spark, str(path)))
    return str(system.makeQualified(path))


def kept_secret(spark: SparkSession, name: str, size: int = 32) -> bytes:
    """Random bytes that the first to ask makes; they stay in the shared folder, so all later runs get the same ones."""
    system, path = _file_system(spark, f"{shared_dir(spark)}/{name}")
    if not system.exists(path):
        part = _file_system(spark, f"{path}.{uuid.uuid4().hex}")[1]
        stream = system.create(part)
        stream.write(secrets.token_bytes(size))
        stream.close()
        system.setPermission(part, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if not system.rename(part, path):
            system.delete(part, False)  # another process was first
    stream = system.open(path)
    got = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    return got


#: What this process has written to shared folders. Results are lazy and read it, so it goes at the end, or by remove().
_made: list[tuple[SparkSession, str]] = []


def remove(*paths: str) -> None:
    """Delete tables that `written` has made; without paths, all."""
    for spark, path in [x for x in _made if not paths or x[1] in paths]:
        _made.remove((spark, path))
        system, there = _file_system(spark, path)
        system.delete(there, True)


@atexit.register
def _at_exit() -> None:
    try:
        remove()
    except Exception:  # the JVM is gone: the folder's owner cleans it
        _made.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (nulls empty) in one array, and the n + 1 places where texts begin."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(split: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a list array, and the row of each."""
    at = np.asarray(split.offsets).astype(np.int64)
    return split.flatten(), np.repeat(np.arange(len(split)), np.diff(at))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the n + 1 places where each text's words begin."""
    items, row = pieces(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    full = np.asarray(pc.not_equal(pc.binary_length(items), 0))
    if not full.all():
        items, row = items.filter(pa.array(full)), row[full]
    return items, starts(row, len(texts))


def starts(row: np.ndarray, n: int) -> np.ndarray:
    """Places where each of n rows begins in a sorted array of row numbers."""
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int64)


def chunks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows that hold about `most` items each; a row is never cut."""
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]
