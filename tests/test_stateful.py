"""Stateful streams: whole messages after a long silence, late results, state that goes with what is closed."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seslog.operators.pairing import pair
from seslog.streaming import stateful as st

MINUTE = 60_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    st.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def play(spark, tmp_path, schema, build, batches, mode="append"):
    """Each batch is one run of the stream over a folder that has grown; the rows of all runs."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = []
    for n, batch in enumerate(batches):
        (source / f"{n:03}.json").write_text("\n".join(json.dumps(r) for r in batch) + "\n")
        stream = build(spark.readStream.schema(schema).json(str(source)))

        def keep(df, epoch):
            rows.extend(df.collect())

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    return rows


def at(ms):
    return f"2026-01-01T{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}Z"


CHUNKS = "session_id string, message_id string, role string, kind string, event_index long, text string, ts timestamp"


def test_a_message_is_whole_after_a_long_silence(spark, tmp_path):
    chunk = lambda i, minute, message="m": {"session_id": "s", "message_id": message, "role": "assistant", "kind": "agent_message", "event_index": i, "text": f"<{i}>", "ts": at(minute * MINUTE)}
    batches = [[chunk(0, 0), chunk(1, 1), chunk(1, 1)], [chunk(1, 1), chunk(5, 2, "n")], [chunk(9, 50, "o")], [chunk(9, 50, "o"), chunk(2, 52)], [chunk(3, 53), chunk(0, 0)]]
    rows = play(spark, tmp_path, CHUNKS, st.new_chunks, batches)
    passed = sorted((r.message_id, r.event_index) for r in rows)
    assert len(passed) == len(set(passed)) or passed.count(("m", 0)) == 2  # only what was forgotten comes again
    table = spark.createDataFrame(rows, "session_id string, message_id string, role string, kind string, event_index long, ts_ms long, text string")
    got = {r.message_id: (r.text, r.chunks, r.event_index) for r in st.merge_chunks(table).collect()}
    assert got == {"m": ("<0><1><2><3>", 4, 0), "n": ("<5>", 1, 5), "o": ("<9>", 1, 9)}


CALLS = "session_id string, turn_id string, call_id string, event_index long, part string, ts timestamp"


def test_late_results_pair_as_in_batch(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for session in "ab":
        for turn in range(4):
            for n in range(25):
                index = turn * 100 + n
                # results may come hours after their call
                rows.append({"session_id": session, "turn_id": f"t{turn}", "call_id": f"c{r.randint(0, 6)}", "event_index": index, "part": r.choice(["call", "result"]), "ts": at((turn * 200 + n * 7) * MINUTE)})
            rows.append({"session_id": session, "turn_id": f"t{turn}", "call_id": None, "event_index": turn * 100 + 50, "part": "end", "ts": at((turn * 200 + 199) * MINUTE)})
    rows.sort(key=lambda x: x["ts"])
    batches = [r.sample(part, len(part)) for part in (rows[i : i + 30] for i in range(0, len(rows), 30))]
    # rows of a batch come in any order; the last batch only moves the watermark on
    batches += [[{"session_id": "z", "turn_id": "t", "call_id": None, "event_index": 0, "part": "end", "ts": at(1400 * MINUTE)}], [{"session_id": "z", "turn_id": "u", "call_id": None, "event_index": 1, "part": "end", "ts": at(1402 * MINUTE)}]]
    got = play(spark, tmp_path, CALLS, st.pair_calls, batches)
    frame = spark.createDataFrame(rows, CALLS.replace("ts timestamp", "ts string")).filter("part <> 'end'").withColumn("is_call", F.col("part") == "call")
    want = pair(frame, ["session_id", "turn_id", "call_id"], "event_index", 8).filter("result_pos IS NOT NULL")
    columns = ["session_id", "turn_id", "call_id", "call_pos", "result_pos"]
    plain = lambda rows: sorted(tuple(str(x[c]) for c in columns) for x in rows)
    assert plain(got) == plain(want.collect())
    # all turns of a and b are over: of their calls nothing is left
    state = spark.read.format("statestore").option("path", str(tmp_path / "out")).option("stateVarName", "calls").load()
    assert state.count() == 0


STATUS = "session_id string, event_index long, kind string, role string, ts timestamp"


def test_status_stops_after_half_an_hour_of_event_time(spark, tmp_path):
    row = lambda s, i, kind, minute, role=None: {"session_id": s, "event_index": i, "kind": kind, "role": role, "ts": at(minute * MINUTE)}
    batches = [
        [row("a", 0, "task_started", 0), row("b", 1, "task_complete", 1), row("b", 0, "task_started", 0), row("c", 0, "message", 0, "assistant"), row("d", 0, "token_count", 0)],
        [row("a", 1, "function_call", 20), row("d", 1, "token_count", 29)], [row("e", 0, "user_message", 52)], [row("e", 1, "reasoning", 54)], [row("d", 1, "token_count", 29), row("a", 2, "agent_message", 59)]]
    rows = play(spark, tmp_path, STATUS, st.live_status, batches, "update")
    latest = {r.session_id: r.status for r in st.latest_status(spark.createDataFrame(rows, "session_id string, status string, event_index long")).collect()}
    assert latest == {"a": "waiting", "b": "completed", "c": "waiting", "d": "running", "e": "running"}
    assert ("a", "stopped") in {(r.session_id, r.status) for r in rows}
    (tmp_path / "again").mkdir()
    stopped = play(spark, tmp_path / "again", STATUS, st.live_status, batches[:3] + [[row("f", 0, "user_message", 70)], [row("f", 1, "user_message", 71)]], "update")
    assert {r.session_id for r in stopped if r.status == "stopped"} == {"a", "d"}


class CountedState:
    """A map state and its timers in memory; counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "getMapState": lambda *_: self, "getValue": lambda k: self.rows.get(k), "containsKey": lambda k: k in self.rows, "updateValue": lambda k, v: self.rows.update({k: v}),
                "clear": self.rows.clear, "listTimers": lambda: list(self.timers), "deleteTimer": self.timers.discard, "registerTimer": self.timers.add}[name](*args)
        return call


def test_chunks_cost_a_state_call_a_block():
    state = CountedState()
    work = st.NewChunks(1000)
    work.init(state)
    frame = lambda indexes: pd.DataFrame({"session_id": "s", "message_id": "m", "role": "r", "kind": "k", "event_index": indexes, "ts_ms": indexes, "text": "t"})
    passed = lambda *batches: [i for out in work.handleInputRows(("s",), iter([frame(b) for b in batches]), None) for i in out["event_index"]]
    r = random.Random(2)
    seen = set()
    for _ in range(5):
        batches = [[r.randint(0, 5_000) for _ in range(400)] for _ in range(2)]
        want = [i for i in dict.fromkeys(i for b in batches for i in b) if i not in seen]
        seen.update(want)
        state.calls = 0
        assert passed(*batches) == want and state.calls <= 2 * 5 + 3
    list(work.handleExpiredTimer(("s",), None, None))
    assert passed([7, 7]) == [7]
