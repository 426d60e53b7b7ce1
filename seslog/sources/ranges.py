"""Byte ranges of growing logs: the committed tail of each file, and a stream that remembers how far each file was read.

A range is read by seeking, so the tail of a log costs its window and a refresh costs what was appended. Records end with
a newline; a writer may leave the last one half-written.

* Tail: the last `window` bytes; a first line that may be cut is dropped, so is a last one without its newline.
* Range [start, stop): the records whose newline lies in it. Where the range starts inside a record, the reader goes back
  to the record's begin. Ranges that touch give every record once, so a file may be cut anywhere, and an offset is plainly
  the size a file had: a half-written record belongs to the range that brings its newline.

Files are opened by pyarrow (local, HDFS, S3 and others by their URI) inside the tasks; only names and sizes are listed
by the driver. A streaming offset has one entry a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from seslog.functions.text import SPACE
from seslog.sources.logs import TAIL_BYTES, parse_records, session_id_from_file

SCHEMA = "file_path string, mtime_ms long, file_size long, byte_start long, line string"
CHUNK = 1 << 20
RANGE_BYTES = 64 << 20
FILES_PER_TASK = 256
LINES_PER_BATCH = 4096


# --- reading one file ---------------------------------------------------------------------------------------------------
def _record_start(file, start: int, chunk: int) -> int:
    """The begin of the record that holds byte `start`: behind the last newline before it."""
    while start > 0:
        low = max(start - chunk, 0)
        file.seek(low)
        at = file.read(start - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        start = low
    return 0


def read_range(file, start: int, stop: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of the records whose newline lies in start..stop, at most `chunk` bytes read at a time."""
    begin = _record_start(file, start, chunk)
    file.seek(begin)
    at, parts, line_start = begin, [], begin
    while at < stop:
        block = file.read(min(chunk, stop - at))
        if not block:
            return
        low = 0
        while (end := block.find(b"\n", low)) >= 0:
            if at + end >= start:
                yield line_start, b"".join([*parts, block[low:end]])
            parts, low, line_start = [], end + 1, at + end + 1
        parts.append(block[low:])
        at += len(block)


def read_tail(file, size: int, window: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of the committed records that begin after the first newline of the last `window` bytes."""
    start = max(size - window, 0)
    file.seek(start)
    at, parts, line_start = start, [], 0 if start == 0 else None
    while at < size:
        block = file.read(min(chunk, size - at))
        if not block:
            return
        low = 0
        while (end := block.find(b"\n", low)) >= 0:
            if line_start is not None:
                yield line_start, b"".join([*parts, block[low:end]])
            parts, low, line_start = [], end + 1, at + end + 1
        parts = [*parts, block[low:]] if line_start is not None else []
        at += len(block)


# --- listing --------------------------------------------------------------------------------------------------------------
def _file_system(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a root, the path in it, and what stands before a path of it in a file's name."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root, "file://"
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/"), "file://"
    system, path = fs.FileSystem.from_uri(root)
    return system, path, root[: len(root) - len(path.rstrip("/"))].rstrip("/") if root.rstrip("/").endswith(path.rstrip("/")) else root.split("://")[0] + "://"


def _folders(system: fs.FileSystem, path: str) -> list[str]:
    """The folders a path names; a star stands for one level, and not for a folder that starts with a dot."""
    head, star, tail = path.partition("/*")
    if not star:
        return [path]
    below = system.get_file_info(fs.FileSelector(head or "/", allow_not_found=True))
    return [x for i in sorted(below, key=lambda i: i.path) if i.type == fs.FileType.Directory and not i.base_name.startswith(".") for x in _folders(system, i.path + tail)]


def list_logs(roots: Sequence[str]) -> dict[str, tuple[int, int]]:
    """The size and modification time (ms) of every *.jsonl file under the roots, by its full name."""
    found = {}
    for root in roots:
        system, path, scheme = _file_system(root)
        for folder in _folders(system, path.rstrip("/") or "/"):
            for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.base_name.endswith(".jsonl"):
                    found[scheme + info.path] = (info.size, (info.mtime_ns or 0) // 1_000_000)
    return found


@dataclass
class Ranges(InputPartition):
    """(file, modification time, size, start, stop) of each range one task reads."""

    parts: list[tuple[str, int, int, int, int]]


def pack(parts: list[tuple[str, int, int, int, int]], most_bytes: int = RANGE_BYTES) -> list[Ranges]:
    """Ranges cut at `most_bytes` and put together, so that a task has about so many bytes and some hundred files."""
    tasks: list[Ranges] = []
    held = most_bytes
    for path, mtime, size, start, stop in parts:
        for low in range(start, stop, most_bytes):
            high = min(low + most_bytes, stop)
            if held + high - low > most_bytes or len(tasks[-1].parts) >= FILES_PER_TASK:
                tasks.append(Ranges([]))
                held = 0
            tasks[-1].parts.append((path, mtime, size, low, high))
            held += high - low
    return tasks


def read_ranges(ranges: Ranges, window: int | None) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["file_path", "mtime_ms", "file_size", "byte_start", "line"]
    rows: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    held = 0
    for path, mtime, size, start, stop in ranges.parts:
        system, inner, _ = _file_system(path)
        with system.open_input_file(inner) as file:
            for begin, line in read_range(file, start, stop) if window is None else read_tail(file, size, window):
                rows.append((path, mtime, size, begin, line.removesuffix(b"\r").decode("utf-8", "replace")))
                held += len(line)
                if len(rows) >= LINES_PER_BATCH or held >= 8 * CHUNK:
                    yield batch()
                    rows, held = [], 0
    if rows:
        yield batch()


# --- the source -----------------------------------------------------------------------------------------------------------
class LogRanges(DataSource):
    """Options: `roots` (a JSON list), `tail_bytes` (batch only: the window of the tail), `range_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "log_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.window = int(options["tail_bytes"]) if "tail_bytes" in options else None
        self.most = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        listed = sorted(list_logs(self.roots).items())
        if self.window is None:
            return pack([(p, mtime, size, 0, size) for p, (size, mtime) in listed], self.most)
        # a tail is one range, whatever its window
        return pack([(p, mtime, size, max(size - self.window, 0), size) for p, (size, mtime) in listed], max(self.most, self.window))

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks for the rows of no partition where there are none
            yield from read_ranges(partition, self.window)


class _Stream(DataSourceStreamReader):
    """The offset is the size up to which each file was read. A file that became shorter was written anew: it is read from its begin."""

    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.most = int(options.get("range_bytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: list(facts) for path, facts in sorted(list_logs(self.roots).items())}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        parts = []
        for path, (size, mtime) in end.items():
            known = start.get(path, [0])[0]
            low = known if known <= size else 0
            if low < size:
                parts.append((path, mtime, size, low, size))
        return pack(parts, self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(partition, None)


# --- over DataFrames ------------------------------------------------------------------------------------------------------
def _reader(spark: SparkSession, roots: str | Sequence[str], stream: bool, **options):
    spark.dataSource.register(LogRanges)
    reader = (spark.readStream if stream else spark.read).format(LogRanges.name()).option("roots", json.dumps([roots] if isinstance(roots, str) else list(roots)))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(session_id_from_file(F.col("file_path")).alias("session_id"), "*", F.col("line").rlike(f"^{SPACE}*$").alias("blank"))


def tail_records(spark: SparkSession, roots: str | Sequence[str], window: int = TAIL_BYTES) -> DataFrame:
    """raw_events of the committed tail of each log. `event_index` counts the records of the window, `line_number` its lines.

    A window holds at most `window` bytes, so numbering it needs no blocks.
    """
    rows = _lines(_reader(spark, roots, False, tail_bytes=window).load())
    order = Window.partitionBy("file_path").orderBy("byte_start")
    numbered = rows.withColumns({
        "line_number": F.row_number().over(order).cast("long"),
        "event_index": F.coalesce(F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "archived": F.lit(False),
    })
    return parse_records(numbered)


def committed_records(spark: SparkSession, roots: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """raw_events of all committed records of the logs, known by file and byte; read by ranges, without counting lines."""
    return parse_records(_lines(_reader(spark, roots, False, range_bytes=range_bytes).load()))


def stream_records(spark: SparkSession, roots: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of committed records: each once, by file and byte, also over restarts; a half-written one waits for its newline."""
    return parse_records(_lines(_reader(spark, roots, True, range_bytes=range_bytes).load()))
