"""The folder that driver and executors share: tables that cut lineage, and tables that are made once from a source."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a folder of our own in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strandlog-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, path: str) -> None:
    system, there = file_system(spark, path)
    system.delete(there, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path: it changes when they do."""
    system, there = file_system(spark, path)
    files, found = system.listFiles(there, True), []
    while files.hasNext():
        file = files.next()
        found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def once(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """The path of what make(path) writes, made by the first that asks. It gets its name when it is whole, so a lost job leaves none."""
    path = f"{shared_dir(spark)}/{name}"
    system, there = file_system(spark, path)
    if not system.exists(there):
        part = f"{path}-{uuid.uuid4().hex}"
        make(part)
        if not system.rename(file_system(spark, part)[1], there):
            remove(spark, part)  # another session was first
    return path
