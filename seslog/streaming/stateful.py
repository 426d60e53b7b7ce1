"""Live status, delta chunks and call/result pairing on `transformWithState`: keyed state, event-time timers.

State is kept per session (status: one row), per message (chunks: the indexes seen since it was last idle) and per turn
(calls: those of a turn that is still open), so it grows with what is open and not with what was read. Time is event time:
the watermark moves with the records, so a replayed log gives what the live one gave.

* Status: `running` becomes `stopped` when the watermark has passed the last record by half an hour.
* Chunks are appended to a table as they come and a message is put together when it is read, so a chunk that comes after
  any silence still belongs to its message. The state only keeps repeats out of the table; what it forgets, the reader
  drops.
* Calls wait for the watermark, are paired in the order of their events, as the batch does it, and stay open until their
  turn ends: a result that comes hours later finds its call. The state of a turn goes when the turn's end has passed.

transformWithState needs the RocksDB state store: `use_rocksdb(spark)` sets it for queries that start after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seslog.operators.turns import STALE_RUNNING_MS, TERMINAL_STATUS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEUTRAL = ("token_count", "reasoning", "meta", "context")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# --- status ---------------------------------------------------------------------------------------------------------------
def decided_status(kind: Column, role: Column) -> Column:
    """The status an event decides by itself; NULL where it leaves the status as it was."""
    decided = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, status in TERMINAL_STATUS.items():
        decided = decided.when(kind == name, status)
    return decided.when((kind == "agent_message") | ((kind == "message") & (role == "assistant")), "waiting").when(kind.isin(*NEUTRAL), None).otherwise("running")


class LiveStatus(StatefulProcessor):
    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "status string, last long, touched_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last, touched = self.seen.get() if self.seen.exists() else (None, -1, 0)
        before = touched
        for batch in rows:
            new = batch[batch["event_index"] > last]
            if len(new):
                decided = new.sort_values("event_index")["decided"].dropna()
                status = decided.iloc[-1] if len(decided) else status or "running"
                last, touched = int(new["event_index"].max()), max(touched, int(new["ts_ms"].max()))
        self.seen.update((status, last, touched))
        if touched != before:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if status == "running":
                self.handle.registerTimer(touched + self.stale_ms)
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "event_index": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, touched = self.seen.get()
        if status == "running":
            self.seen.update(("stopped", last, touched))
            yield pd.DataFrame({"session_id": [key[0]], "status": ["stopped"], "event_index": [last]})

    def close(self) -> None:
        pass


def live_status(events: DataFrame, stale_ms: int = STALE_RUNNING_MS, delay: str = "1 minute") -> DataFrame:
    """events (session_id, event_index, kind, role, ts) -> (session_id, status, event_index) at each change; the highest index, then `stopped`, is the latest."""
    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.withWatermark("ts", delay).select(
        "session_id", F.col("event_index").cast("long").alias("event_index"), decided_status(F.col("kind"), F.col("role")).alias("decided"), F.unix_millis("ts").alias("ts_ms"), "ts")
    return narrow.groupBy("session_id").transformWithStateInPandas(
        LiveStatus(stale_ms), f"session_id {key}, status string, event_index long", "Update", "EventTime")


def latest_status(changes: DataFrame) -> DataFrame:
    """The status of each session from the changes a stream has written."""
    order = F.struct("event_index", (F.col("status") == "stopped").alias("stopped"))
    return changes.groupBy("session_id").agg(F.max_by("status", order).alias("status"), F.max("event_index").alias("event_index"))


# --- deltas ---------------------------------------------------------------------------------------------------------------
# Chunk numbers of a message are kept as bits, so many: a call to the state for each block of them, not for each chunk.
SEEN_BITS = 1024


class NewChunks(StatefulProcessor):
    """Passes on the chunks of a message that were not passed on since the message was last idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, held, changed = None, {}, set()
        for batch in rows:
            fresh = []
            for index in batch["event_index"]:
                block, place = divmod(int(index), SEEN_BITS)
                if block not in held:
                    known = self.blocks.getValue((block,))
                    held[block] = 0 if known is None else int.from_bytes(known[0], "little")
                new = not held[block] >> place & 1
                fresh.append(new)
                if new:
                    held[block] |= 1 << place
                    changed.add(block)
            new = batch[fresh]
            if len(new):
                newest = max(newest or 0, int(new["ts_ms"].max()))
                yield new[CHUNK_COLUMNS]
        for block in changed:
            self.blocks.updateValue((block,), (held[block].to_bytes(SEEN_BITS // 8, "little"),))
        if newest is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.blocks.clear()
        return iter(())

    def close(self) -> None:
        pass


CHUNK_COLUMNS = ["session_id", "message_id", "role", "kind", "event_index", "ts_ms", "text"]
MESSAGE = ["session_id", "message_id", "role", "kind"]


def new_chunks(events: DataFrame, idle_ms: int = STALE_RUNNING_MS, delay: str = "1 minute") -> DataFrame:
    """The chunks of delta messages, for a table they are appended to; `merge_chunks` reads it."""
    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.withWatermark("ts", delay).select(
        "session_id", "message_id", "role", "kind", F.col("event_index").cast("long").alias("event_index"), F.unix_millis("ts").alias("ts_ms"), "text", "ts")
    return narrow.groupBy(*MESSAGE).transformWithStateInPandas(
        NewChunks(idle_ms), f"session_id {key}, message_id string, role string, kind string, event_index long, ts_ms long, text string", "Append", "EventTime")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Whole messages of a chunk table, however far apart their chunks came: each chunk once, texts joined in order."""
    once = chunks.groupBy(*MESSAGE, "event_index").agg(F.min("ts_ms").alias("ts_ms"), F.min("text").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("event_index", F.coalesce("text", F.lit("")).alias("text"))))
    merged = once.groupBy(*MESSAGE).agg(parts.alias("parts"), F.max("ts_ms").alias("delta_completed_ms"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return merged.select(*MESSAGE, F.get("parts", 0)["event_index"].alias("event_index"), text.alias("text"), F.size("parts").cast("long").alias("chunks"), "delta_completed_ms")


# --- calls and results ----------------------------------------------------------------------------------------------------
class PairCalls(StatefulProcessor):
    """Rows wait until the watermark has passed them, then results take the latest earlier call of their id."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_index long", "call_id string, role string, ts_ms long")
        self.calls = handle.getMapState("calls", "call_id string", "event_index long")
        self.ended = handle.getValueState("ended", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            for index, call, role, ts in zip(batch["event_index"], batch["call_id"], batch["part"], batch["ts_ms"]):
                self.waiting.updateValue((int(index),), (call, role, int(ts)))
            times.add(int(batch["ts_ms"].max()))
        if times:
            self.handle.registerTimer(max(times) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((index[0], *row) for index, row in self.waiting.iterator() if row[2] < now)
        out = []
        for index, call, part, ts in due:
            if part == "call":
                self.calls.updateValue((call,), (index,))
            elif part == "result":
                known = self.calls.getValue((call,)) if self.calls.exists() and self.calls.containsKey((call,)) else None
                out.append((key[0], key[1], call, None if known is None else known[0], index))
            else:
                self.ended.update((ts,))
                self.handle.registerTimer(ts + self.grace_ms + 1)
            self.waiting.removeKey((index,))
        if self.ended.exists() and now > self.ended.get()[0] + self.grace_ms:
            self.calls.clear()  # the turn is over; what still waits has a timer of its own
            self.ended.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn_id", "call_id", "call_pos", "result_pos"]).astype({"call_pos": "Int64"})

    def close(self) -> None:
        pass


def pair_calls(events: DataFrame, delay: str = "1 minute", grace_ms: int = STALE_RUNNING_MS) -> DataFrame:
    """events (session_id, turn_id, call_id, event_index, part, ts), part: call, result or end (of the turn) -> results with their calls.

    Rows come out when the watermark has passed them, in the order of their events, each result once.
    """
    key = events.schema["session_id"].dataType.simpleString()
    narrow = events.withWatermark("ts", delay).select(
        "session_id", "turn_id", "call_id", F.col("event_index").cast("long").alias("event_index"), "part", F.unix_millis("ts").alias("ts_ms"), "ts")
    return narrow.groupBy("session_id", "turn_id").transformWithStateInPandas(
        PairCalls(grace_ms), f"session_id {key}, turn_id string, call_id string, call_pos long, result_pos long", "Append", "EventTime")
