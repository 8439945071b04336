"""Log folders as a data source of its own: lines of numbered files, as a table or a stream.

``spark.read.format("log_lines").option("path", folder).option("name", r"nn([0-9]+)\\.log")``

One partition reads one file, line by line in bounded batches; a folder of rotated logs is many files of bounded
size. Conditions on ``file_no`` are pushed down to the listing, so other files are not opened. As a stream, the
offset is the number of the last file handed out: rotated logs come with rising numbers, and a file is read once.

The source goes through no JVM handle, so it works in classic sessions and over Connect alike. Driver and executors
open files by `pyarrow.fs`, which knows local and shared mounts, HDFS and object stores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

FORMAT = "log_lines"
LINES = "file string, file_no bigint, line_no bigint, text string"
SCHEMA = pa.schema([("file", pa.string()), ("file_no", pa.int64()), ("line_no", pa.int64()), ("text", pa.string())])
BATCH_BYTES = 4 << 20  # of lines handed on at once

#: Conditions on the file number that the listing can judge.
TESTS = {
    EqualTo: lambda n, x: n == x,
    GreaterThan: lambda n, x: n > x,
    GreaterThanOrEqual: lambda n, x: n >= x,
    LessThan: lambda n, x: n < x,
    LessThanOrEqual: lambda n, x: n <= x,
    In: lambda n, x: n in x,
}


@dataclass(frozen=True)
class LogFile(InputPartition):
    path: str
    name: str
    number: int


def numbered_files(folder: str, name: str) -> list[LogFile]:
    """Files below the folder whose path under it matches, by the number that the pattern's group takes."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(),
        folder,
    )
    found = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
        below = info.path[len(root) :].strip("/")
        match = re.search(f"^(?:{name})", below)
        if info.is_file and match:
            found.append(LogFile(folder.rstrip("/") + "/" + below, below, int(match[1])))
    return sorted(found, key=lambda f: (f.number, f.name))


def lines_of(file: LogFile) -> Iterator[pa.RecordBatch]:
    """Lines of one file, numbered from 1; bytes that are no UTF-8 are replaced."""
    folder = file.path if "://" in file.path or file.path.startswith("file:") else None
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if folder else (pyarrow.fs.LocalFileSystem(), file.path)
    number, rest = 1, b""

    def batch(lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        texts = [line.decode("utf-8", "replace") for line in lines]
        columns = [[file.name] * n, [file.number] * n, range(number, number + n), texts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    with fs.open_input_stream(path) as stream:
        while piece := stream.read(BATCH_BYTES):
            *lines, rest = (rest + piece).split(b"\n")
            if lines:
                yield batch(lines)
                number += len(lines)
    if rest:
        yield batch([rest])


class LogReader(DataSourceReader):
    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("file_no",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[LogFile]:
        files = numbered_files(self.folder, self.name)
        kept = [f for f in files if all(TESTS[kind](f.number, x) for kind, x in self.tests)]
        return kept or [LogFile("", "", -1)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from lines_of(partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def initialOffset(self) -> dict:
        return {"file_no": -1}

    def latestOffset(self) -> dict:
        files = numbered_files(self.folder, self.name)
        return {"file_no": files[-1].number if files else -1}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        files = numbered_files(self.folder, self.name)
        return [f for f in files if start["file_no"] < f.number <= end["file_no"]]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        yield from lines_of(partition)


class LogSource(DataSource):
    """Options: ``path``, and ``name``, a pattern of names with one group, the file's number."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def _from(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("name", r".*?([0-9]+)")

    def reader(self, schema) -> LogReader:
        return LogReader(*self._from())

    def streamReader(self, schema) -> LogStream:
        return LogStream(*self._from())


def register(spark: SparkSession) -> None:
    """Make the format known to the session; pushdown of conditions needs a session setting."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
