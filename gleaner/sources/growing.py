"""Lines of files that grow: a stream source that remembers how far into each file it has read.

Spark's file streams take a file once, so lines appended to it later are never seen. Here the offset of the stream is the number of
bytes read of every file: a batch holds the whole lines that were added since, a line without its end waits for the rest. Added
stretches are cut into ranges of `rangeBytes` that tasks read side by side, each taking the lines that start in its range.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").load("/logs")

A file that has become shorter is read again from its start, a renamed one is a new file, one that is gone is forgotten; names that
start with `_` or `.` are passed over. Bytes that are no UTF-8 become U+FFFD, a CR before the line feed goes. The path may be a
file or a folder (with subfolders), local or in a store that pyarrow reads.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, start bigint"
RANGE_BYTES = 128 << 20
PIECE = 1 << 20
ROWS = 10_000


def filesystem(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path)


def whole_lines(handle, size: int) -> int:
    """Bytes up to and with the last line feed among the first `size`."""
    at = size
    while at:
        start = max(at - PIECE, 0)
        handle.seek(start)
        found = handle.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


@dataclass
class Range(InputPartition):
    """The lines of a file that start at `first` or later and before `end`; `begin` is a line start at or before `first`."""

    file: str
    begin: int
    first: int
    end: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, tuple[int, int]] = {}         # size seen, whole lines in it

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = filesystem(self.path)
        top = store.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            return {}
        files = [top] if top.type == fs.FileType.File else [
            f for f in store.get_file_info(fs.FileSelector(root, recursive=True))
            if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root):].split("/") if p)]
        now = {}
        for f in files:
            if self.known.get(f.path, (None,))[0] == f.size:
                now[f.path] = self.known[f.path]
            else:
                with store.open_input_file(f.path) as handle:
                    now[f.path] = f.size, whole_lines(handle, f.size)
        self.known = now
        return {path: lines for path, (_, lines) in now.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, last in sorted(end.items()):
            begin = start.get(file, 0)
            if last < begin:
                begin = 0
            out += [Range(file, begin, a, min(a + self.range_bytes, last)) for a in range(begin, last, self.range_bytes)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        with store.open_input_file(part.file) as handle:
            lines = lines_of(handle, part.first, part.end, part.first == part.begin)
            while True:
                rows = [x for x, _ in zip(lines, range(ROWS))]
                if not rows:
                    return
                yield pa.RecordBatch.from_arrays([
                    pa.array([v.removesuffix(b"\r").decode("utf-8", "replace") for _, v in rows], pa.string()),
                    pa.array([part.file] * len(rows), pa.string()), pa.array([at for at, _ in rows], pa.int64())], ["value", "file", "start"])
                if len(rows) < ROWS:
                    return

    def commit(self, end: dict) -> None:
        pass


def lines_of(handle, first: int, end: int, at_line_start: bool) -> Iterator[tuple[int, bytes]]:
    """(start, bytes without the line feed) of the lines that start in [first, end); the last one may run beyond."""
    at = first if at_line_start else first - 1              # the byte before tells whether a line starts here
    handle.seek(at)
    held, skip = b"", not at_line_start
    while at < end:
        piece = handle.read(PIECE)
        if not piece:
            return
        held += piece
        parts = held.split(b"\n")
        held = parts.pop()
        for line in parts:
            if at >= end:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1


class GrowingLines(DataSource):
    """The source `growing_lines`: (value, file, start), start being the byte a line begins at."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def follow_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream(value, file, start) of the whole lines of a growing file, or of all files under a folder."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(path)
