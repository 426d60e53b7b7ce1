"""Streaming forms of the live operators: ingest, status, change feed, delta merge and call/result pairing, recency.

State is keyed as finely as the operator allows: a status per session, but deltas per message and calls per call id,
so that one very busy session is spread over many state groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seslog.operators.catalog import age_bucket
from seslog.operators.turns import STALE_RUNNING_MS, TERMINAL_STATUS
from seslog.sources.logs import parse_records

SEGMENT_SCHEMA = "session_id string, event_index long, line_number long, ts timestamp, line string, terminated boolean"


# --- ingest ---------------------------------------------------------------------------------------------------------------
def read_segments(spark: SparkSession, path: str, schema: str = SEGMENT_SCHEMA) -> DataFrame:
    """Stream of immutable record segments (JSON rows). A growing log is cut into segments by its shipper."""
    return spark.readStream.schema(schema).json(path)


def ingest(segments: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """raw_events of committed records: a half-written last record waits until it comes terminated; repeats are dropped."""
    committed = segments.filter("terminated").withWatermark("ts", watermark)
    unique = committed.dropDuplicatesWithinWatermark(["session_id", "event_index"])
    return parse_records(unique.withColumn("blank", F.col("line").rlike(r"^\s*$")).drop("terminated"))


# --- status ----------------------------------------------------------------------------------------------------------------
def status_after(status: str | None, kind: str, role: str | None) -> str | None:
    """Status of a session after one more event."""
    if kind in TERMINAL_STATUS:
        return TERMINAL_STATUS[kind]
    if kind == "agent_message" or (kind == "message" and role == "assistant"):
        return "waiting"
    if kind in ("token_count", "reasoning", "meta", "context"):
        return status or "running"
    return "running"


def live_status(events: DataFrame, stale_ms: int = STALE_RUNNING_MS) -> DataFrame:
    """Status per session; 'running' becomes 'stopped' when nothing is written for half an hour, terminal states stay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else (None, -1)
        if state.hasTimedOut:
            if status == "running":
                state.update(("stopped", last))
                yield pd.DataFrame({"session_id": [key[0]], "status": ["stopped"], "event_index": [last]})
            return
        for batch in batches:
            for row in batch.sort_values("event_index").itertuples(index=False):
                if row.event_index > last:
                    status, last = status_after(status, row.kind, row.role), int(row.event_index)
        state.update((status, last))
        state.setTimeoutDuration(stale_ms)
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "event_index": [last]})

    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.select("session_id", F.col("event_index").cast("long").alias("event_index"), "kind", "role")
    return narrow.groupBy("session_id").applyInPandasWithState(
        step, f"session_id {key}, status string, event_index long", "status string, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


# --- deltas and calls --------------------------------------------------------------------------------------------------------
def merge_deltas(events: DataFrame, idle_ms: int = STALE_RUNNING_MS) -> DataFrame:
    """Text of each message so far, joined from its chunks in order (update mode; the last row of a message is whole)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        indexes, texts = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.event_index not in indexes:
                    indexes.append(int(row.event_index))
                    texts.append(row.text or "")
        order = sorted(range(len(indexes)), key=indexes.__getitem__)
        state.update(([indexes[i] for i in order], [texts[i] for i in order]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({
            "session_id": [key[0]], "message_id": [key[1]], "event_index": [indexes[order[0]]], "chunks": [len(order)], "text": ["".join(texts[i] for i in order)]})

    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.select("session_id", "message_id", "role", "kind", F.col("event_index").cast("long").alias("event_index"), "text")
    return narrow.groupBy("session_id", "message_id", "role", "kind").applyInPandasWithState(
        step, f"session_id {key}, message_id string, event_index long, chunks long, text string", "indexes array<long>, texts array<string>", "update",
        GroupStateTimeout.ProcessingTimeTimeout)


def pair_calls(events: DataFrame, idle_ms: int = STALE_RUNNING_MS) -> DataFrame:
    """Each result with the latest earlier call of its session, turn and call id; state holds that call."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        call = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_index")
        out = []
        for row in rows.itertuples(index=False):
            if row.is_call:
                call = int(row.event_index)
            else:
                out.append((key[0], key[1], key[2], call, int(row.event_index)))
        if call is not None:
            state.update((call,))
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn_id", "call_id", "call_pos", "result_pos"]).astype({"call_pos": "Int64"})

    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.select("session_id", "turn_id", "call_id", F.col("event_index").cast("long").alias("event_index"), "is_call")
    return narrow.groupBy("session_id", "turn_id", "call_id").applyInPandasWithState(
        step, f"session_id {key}, turn_id string, call_id string, call_pos long, result_pos long", "call long", "append", GroupStateTimeout.ProcessingTimeTimeout)


# --- change feed ---------------------------------------------------------------------------------------------------------------
def change_log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder per batch, so a repeated batch replaces its own rows only."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return write


def latest_sessions(change_log: DataFrame) -> DataFrame:
    """Current session rows of a change log: the newest change per id (ties: the later batch)."""
    cells = [c for c in change_log.columns if c not in ("id", "epoch")]
    order = F.struct("changed_ms", "epoch")
    return change_log.groupBy("id").agg(F.max_by(F.struct(*cells), order).alias("r")).select("id", "r.*")


def changes_since(sessions: DataFrame, changed_after: int) -> DataFrame:
    """Sessions changed after the caller's watermark, with the new watermark."""
    newest = sessions.agg(F.max("changed_ms").alias("watermark_ms")).withColumn("__k", F.lit(1))
    changed = sessions.filter(F.col("changed_ms") > changed_after).withColumn("__k", F.lit(1))
    return changed.join(F.broadcast(newest), "__k").drop("__k")  # one row


# --- recency ---------------------------------------------------------------------------------------------------------------------
def hourly_counts(events: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """Events per hour and kind; works on a batch (watermark None) and on a stream."""
    rows = events if watermark is None else events.withWatermark("ts", watermark)
    counted = rows.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_millis(F.col("w.start")).alias("hour_ms"), "kind", "n")


def scope_of_hours(counts: DataFrame, now_ms: int) -> DataFrame:
    return counts.withColumn("scope", age_bucket(F.col("hour_ms"), now_ms))
