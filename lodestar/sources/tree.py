"""A data source for source trees: ``spark.read.format("sources")`` and ``spark.readStream.format("sources")``.

A folder is listed once; filters on ``path`` and ``length`` choose from the listing, so that nothing is read that they leave out, and
files are dealt into partitions by bytes. As a stream, the offset is the time of the newest file: a batch holds the files written since
the one before. Folders can be in any file system that pyarrow reaches by its address.

Options: path; suffixes (".py,.ipynb"), none for all files; maxBytes a file; partitionBytes; settleMs: a stream leaves files alone until they
are that old, as files of one moment may still be written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

SCHEMA = "path string, length long, modified timestamp, content binary"


@dataclass(frozen=True)
class Found:
    path: str
    length: int
    modified: datetime


@dataclass
class Files(InputPartition):
    held: list[Found]

    def __init__(self, held: list[Found]):
        super().__init__(0)
        self.held = held


def _place(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


class _Tree:
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.root = given["path"]
        self.suffixes = tuple(x for x in given.get("suffixes", ".py,.ipynb").split(",") if x)
        self.most, self.each = int(given.get("maxbytes", 500_000)), int(given.get("partitionbytes", 4 << 20))
        self.settle = int(given.get("settlems", 1000))

    def listed(self) -> list[Found]:
        from pyarrow import fs

        files, root = _place(self.root)
        found = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            path = info.path[len(root.rstrip("/")) + 1 :]
            hidden = any(part.startswith(".") for part in path.split("/")[:-1])
            if info.is_file and not hidden and (not self.suffixes or path.endswith(self.suffixes)) and info.size <= self.most:
                found.append(Found(path, info.size, info.mtime))
        return sorted(found, key=lambda f: f.path)

    def dealt(self, found: list[Found]) -> list[Files]:
        parts, size = [], 0
        for f in found:
            if not parts or size + f.length > self.each:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f.length
        return [Files(p) for p in parts]

    def rows(self, partition: Files | None) -> Iterator[tuple]:
        if partition is None:  # nothing was listed
            return
        files, root = _place(self.root)
        for f in partition.held:
            try:
                with files.open_input_stream(f"{root.rstrip('/')}/{f.path}") as data:
                    yield f.path, f.length, f.modified, data.read()
            except FileNotFoundError:
                continue  # deleted since the listing


def _keeps(f: Filter):
    """A test of a listed file, or None for a filter that the listing can't answer."""
    if f.__class__ not in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains) or f.attribute not in (("path",), ("length",)):
        return None
    name, value = f.attribute[0], f.value
    of = lambda x: getattr(x, name)
    return {
        EqualTo: lambda x: of(x) == value, In: lambda x: of(x) in value, GreaterThan: lambda x: of(x) > value, GreaterThanOrEqual: lambda x: of(x) >= value, LessThan: lambda x: of(x) < value,
        LessThanOrEqual: lambda x: of(x) <= value, StringStartsWith: lambda x: of(x).startswith(value), StringEndsWith: lambda x: of(x).endswith(value), StringContains: lambda x: value in of(x),
    }[f.__class__]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree, self.tests = _Tree(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if (test := _keeps(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        return self.tree.dealt([f for f in self.tree.listed() if all(test(f) for test in self.tests)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.rows(partition)


class TreeStream(DataSourceStreamReader):
    """Offsets are times in microseconds; a batch is what was written after one and up to the other."""

    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def _at(self, f: Found) -> int:
        return round(f.modified.timestamp() * 1_000_000)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"written": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        old = (time.time() - self.tree.settle / 1000) * 1_000_000
        return {"written": max((at for f in self.tree.listed() if (at := self._at(f)) <= old), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.tree.dealt([f for f in self.tree.listed() if start["written"] < self._at(f) <= end["written"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sources"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStream:  # noqa: N802
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


