"""Sinks: derived tables as Parquet, logs as JSON lines and the execution report as text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.staging import staging_root
from seslog.functions.text import fence_size, report_duration
from seslog.sources.ranges import _file_system

ROWS_PER_FILE = 2_000_000
REPORT_FILE_BYTES = 128 << 20
WRITE_BYTES = 1 << 20


def write_events(events: DataFrame, path: str | None = None) -> str:
    """Event table partitioned by date, each file sorted by session and position."""
    if path is None:
        path = f"{staging_root(events.sparkSession).rstrip('/')}/seslog/{uuid.uuid4().hex}"
    dated = events.withColumn("event_date", F.to_date(F.timestamp_millis("ts_ms")))
    # Range partitioning by date and session keeps partitions even, also where one session has very many rows.
    (
        dated.repartitionByRange("event_date", "session_id", "event_index")
        .sortWithinPartitions("event_date", "session_id", "event_index")
        .write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("event_date").parquet(path)
    )
    return path


def _fenced(label: str, body: Column) -> Column:
    fence = F.repeat(F.lit("`"), fence_size(body))
    return F.concat_ws("\n", F.lit(f"{label}："), fence, body, fence)


def report_lines(sessions: DataFrame, nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Execution report as a line table (session_id, part, line_no, text).

    Part 0 holds the session's facts, part 1 one line per trace node (offset and duration), part 2 one block per
    message or tool call: texts and arguments in full, a tool's output only by its size and truncation mark.
    """
    head = sessions.select("session_id", F.lit(0).alias("part"), F.posexplode(F.array(
        F.concat(F.lit("# "), F.coalesce("title", F.lit("未命名会话"))), F.concat(F.lit("会话："), F.col("session_id").cast("string")),
        F.concat(F.lit("状态："), F.coalesce("status", F.lit("unknown"))), F.concat(F.lit("总时长："), report_duration(F.col("wall_ms"))))).alias("line_no", "text"))
    starts = sessions.select("session_id", F.col("start_ms").alias("__start"))
    offset = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("+"), report_duration(F.col("start_ms") - F.col("__start")))).otherwise("")
    tree = nodes.join(starts, "session_id").select(
        "session_id", F.lit(1).alias("part"), F.col("line_no"),
        F.concat_ws(" ", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), F.col("title")), offset, report_duration(F.col("duration_ms"))).alias("text"))
    size = F.octet_length("output").cast("string")
    cut = F.when(truncation_mark(F.col("output")), "，来源已截断").otherwise("")
    output = F.when(F.col("output").isNotNull(), F.concat(F.lit("输出："), size, F.lit(" 字节"), cut))
    body = F.when(F.col("type") == "tool-call", F.concat_ws("\n", F.concat(F.lit("工具："), F.col("name")),
        F.when(F.col("arguments").isNotNull(), _fenced("参数", F.col("arguments"))), output)).otherwise(_fenced("消息", F.coalesce("text", F.lit(""))))
    blocks = items.filter(F.col("type").isin("user-message", "assistant-message", "tool-call")).select(
        "session_id", F.lit(2).alias("part"), (F.col("turn_index") * 2**32 + F.col("item_index")).alias("line_no"), body.alias("text"))
    return head.unionByName(tree).unionByName(blocks)


def truncation_mark(output: Column) -> Column:
    """Whether the producer says that it cut its output."""
    return F.coalesce(output.rlike(r"(?i)\btruncated\b|已截断"), F.lit(False))


def write_report(lines: DataFrame, path: str) -> None:
    """One folder per session; lines in order over its files."""
    (
        lines.repartitionByRange("session_id", "part", "line_no").sortWithinPartitions("session_id", "part", "line_no")
        .select("session_id", "text").write.partitionBy("session_id").text(path)
    )


# --- files that tasks write themselves ------------------------------------------------------------------------------------
class _Growing:
    """A file that appears under its name only when it is whole: a task that is run again, or twice at once, replaces it."""

    def __init__(self, path: str):
        self.system, self.path, _ = _file_system(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{os.path.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.out, self.held, self.size, self.flushed = self.system.open_output_stream(self.draft), [], 0, 0

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size - self.flushed >= WRITE_BYTES:
            self._flush()

    def _flush(self) -> None:
        self.out.write(b"".join(self.held))
        self.held, self.flushed = [], self.size

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.system.move(self.draft, self.path)


def write_logs(lines: DataFrame, root: str) -> int:
    """Write (file, event_index, line, unfinished) as JSON-lines logs `root`/`file`, in the order of events; the bytes written.

    `unfinished` is text written without a newline behind its row's line (both may be null): a record still being written.
    A log is one file, so one task writes it, line by line.
    """
    ordered = lines.select("file", F.col("event_index").cast("long"), "line", "unfinished").repartition("file").sortWithinPartitions("file", "event_index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, done = None, None, 0
        for batch in batches:
            for path, line, unfinished in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if path != name:
                    if file:
                        file.close()
                        done += file.size
                    name, file = path, _Growing(f"{root.rstrip('/')}/{path}")
                if line is not None:
                    file.write(line.encode() + b"\n")
                if unfinished is not None:
                    file.write(unfinished.encode())
        if file:
            file.close()
            done += file.size
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([done], pa.int64())})

    return ordered.mapInArrow(write, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def write_packed_report(lines: DataFrame, path: str, file_bytes: int = REPORT_FILE_BYTES) -> None:
    """Reports of many sessions in few files, and an index of where each one lies.

    Lines are dealt out by range, so a file holds about `file_bytes` whatever the number of sessions, and a session whose
    report is larger goes on in the next file. The index is written last, as Parquet: what a failed task left behind is
    in no index and is never read.
    """
    total = lines.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # the order of a session's lines is part of the range, so that one large report is spread as well
    dealt = lines.select("session_id", "part", F.col("line_no").cast("long").alias("line_no"), "text")
    dealt = dealt.repartitionByRange(int(total // file_bytes) + 1, "session_id", "part", "line_no").sortWithinPartitions("session_id", "part", "line_no")
    key = lines.schema["session_id"].dataType.simpleString()
    root = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uuid.uuid4().hex}.txt"
        file, session, start, found, kind = None, None, 0, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for owner, part, line_no, text in zip(*(c.to_pylist() for c in batch.columns)):
                file = file or _Growing(f"{root}/data/{name}")
                if not found or owner != session:
                    session, start = owner, file.size
                    found.append([owner, name, part, line_no, start, 0])
                file.write((text or "").encode() + b"\n")
                found[-1][5] = file.size - start
        if file:
            file.close()
            types = [kind, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["session_id", "file", "part", "line_no", "start", "bytes"])

    index = dealt.mapInArrow(write, f"session_id {key}, file string, part int, line_no long, start long, bytes long")
    index.write.parquet(f"{root}/index")


def read_packed_report(spark: SparkSession, path: str, session_ids: list | None = None) -> DataFrame:
    """(session_id, part, line_no, text) of all or some sessions' reports: one row a piece, read at its offset only."""
    root = path.rstrip("/")
    index = spark.read.parquet(f"{root}/index")
    if session_ids is not None:
        index = index.filter(F.col("session_id").isin(session_ids))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, start, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 4, 5)))):
                system, inner, _ = _file_system(f"{root}/data/{name}")
                with system.open_input_file(inner) as file:
                    file.seek(start)
                    text = file.read(size).decode()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), row.column(3), pa.array([text[:-1]])], ["session_id", "part", "line_no", "text"])

    key = index.schema["session_id"].dataType.simpleString()
    return index.mapInArrow(read, f"session_id {key}, part int, line_no long, text string")
