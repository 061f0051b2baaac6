"""Python data source `strandlog`: WAL files under a folder as rows (queue, file_id, entry_id, data).

    spark.dataSource.register(SegmentSource)
    spark.read.format("strandlog").load("/data")            # options: first, last (ids), step

Pushed filters on entry_id become bounds: files that can't hold such ids aren't read, and a file's decoding ends at the last one. The folder is read by the
file system of the workers; for other stores use strandlog.sources.files.read_files, which reads through Spark.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from strandlog.sources.codec import WalHeader, decode_wal

_name = re.compile(r"(/.+)/wal/((?:[0-9a-f]{3}/)*[0-9a-f]{3})\.wal$")


#: Bytes of files that one task reads, if it has several.
GROUP = 64_000_000


@dataclass(frozen=True)
class WalFile:
    path: str
    queue: str
    file_id: int


@dataclass
class WalFiles(InputPartition):
    files: tuple[WalFile, ...]


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.first, self.step = int(options.get("first", 0)), int(options.get("step", 1))
        self.anchor, self.last = self.first, int(options["last"]) if "last" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        """Bounds on entry_id are taken up; every filter is handed back, so Spark applies it as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("entry_id",):
                low = {GreaterThan: 1, GreaterThanOrEqual: 0, EqualTo: 0}.get(type(f))
                high = {LessThan: -1, LessThanOrEqual: 0, EqualTo: 0}.get(type(f))
                if low is not None:
                    self.first = max(self.first, f.value + low)
                if high is not None:
                    self.last = f.value + high if self.last is None else min(self.last, f.value + high)
            yield f

    def partitions(self) -> list[WalFiles]:
        """Files in groups of some MB; with bounds, a file is left out if its header and its successor's tell that it has no such id."""
        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                if m := _name.match(os.path.join(folder, name)[len(self.root) :]):
                    found.append(WalFile(os.path.join(folder, name), m[1], int(m[2].replace("/", ""), 16)))
        found.sort(key=lambda f: (f.queue, f.file_id))
        if self.first or self.last is not None:
            with ThreadPoolExecutor(32) as pool:
                begins = list(pool.map(lambda f: first_id(f.path), found))
            later = [nxt if a.queue == b.queue else None for a, b, nxt in zip(found, found[1:], begins[1:])] + [None]
            outside = lambda lo, hi: (hi is not None and hi <= self.first) or (lo is not None and self.last is not None and lo > self.last)
            found = [f for f, lo, hi in zip(found, begins, later) if not outside(lo, hi)]
        groups, size = [], 0
        for file in found:
            size += os.path.getsize(file.path)
            if not groups or size > GROUP:
                groups.append([])
                size = os.path.getsize(file.path)
            groups[-1].append(file)
        return [WalFiles(tuple(x)) for x in groups]

    def read(self, partition: WalFiles) -> Iterator[tuple]:
        for part in partition.files:
            with open(part.path, "rb") as file:
                raw = file.read()
            for entry_id, data in decode_wal(raw, self.first, self.last):
                if (entry_id - self.anchor) % max(self.step, 1) == 0:
                    yield part.queue, part.file_id, entry_id, data


def first_id(path: str) -> int | None:
    """The id at which a file's header says that it begins; None without a sound header."""
    with open(path, "rb") as file:
        try:
            return WalHeader.decode(file.read(128))[0].before
        except (ValueError, struct.error):
            return None


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandlog"

    def schema(self) -> str:
        return "queue string, file_id long, entry_id long, data binary"

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)
