import json
import time

from pyspark.sql import functions as F

from seslog.operators.pairing import pair
from seslog.streaming import live


def run(stream, mode, name, wait=True):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"/tmp/seslog-{name}-{time.time_ns()}").start()
    if wait:
        query.processAllAvailable()
    return query


def until(name, condition, seconds=60):
    """Queries with processing-time timeouts run batches all the time, so they are watched, not awaited."""
    deadline = time.time() + seconds
    while time.time() < deadline and not condition():
        time.sleep(0.3)
    assert condition(), name


def write(path, name, rows):
    path.mkdir(exist_ok=True, parents=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_ingest_waits_for_whole_records_and_drops_repeats(spark, tmp_path):
    row = lambda i, line, done=True: {"session_id": "s", "event_index": i, "line_number": i + 1, "ts": "2026-01-01T00:00:00Z", "line": line, "terminated": done}
    write(tmp_path / "in", "1.json", [row(0, '{"a":1}'), row(1, '{"a":', False)])
    query = run(live.ingest(live.read_segments(spark, str(tmp_path / "in"))).select("event_index", "is_valid", "line"), "append", "ingested")
    write(tmp_path / "in", "2.json", [row(0, '{"a":1}'), row(1, '{"a":2}'), row(2, "{bad")])
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("ingested").collect()) == [(0, True, '{"a":1}'), (1, True, '{"a":2}'), (2, False, "{bad")]


def test_pairing_and_deltas_equal_batch(spark, tmp_path):
    rows = [{"session_id": f"s{i % 2}", "turn_id": "t", "call_id": f"c{i % 3}", "event_index": i, "is_call": i % 4 == 0} for i in range(60)]
    schema = "session_id string, turn_id string, call_id string, event_index long, is_call boolean"
    write(tmp_path / "calls", "1.json", rows[:25])
    query = run(live.pair_calls(spark.readStream.schema(schema).json(str(tmp_path / "calls"))), "append", "paired", wait=False)
    until("first segment", lambda: spark.table("paired").count() == sum(not r["is_call"] for r in rows[:25]))
    write(tmp_path / "calls", "2.json", rows[25:])
    until("second segment", lambda: spark.table("paired").count() == sum(not r["is_call"] for r in rows))
    query.stop()
    batch = pair(spark.createDataFrame(rows, schema), ["session_id", "turn_id", "call_id"], "event_index", 8).filter("result_pos IS NOT NULL")
    columns = ["session_id", "call_id", "call_pos", "result_pos"]
    assert sorted(map(str, spark.table("paired").select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))

    chunks = [{"session_id": "s", "message_id": f"m{i % 2}", "role": "assistant", "kind": "agent_message", "event_index": i, "text": f"<{i}>"} for i in range(10)]
    schema = "session_id string, message_id string, role string, kind string, event_index long, text string"
    write(tmp_path / "deltas", "1.json", chunks[:5])
    query = run(live.merge_deltas(spark.readStream.schema(schema).json(str(tmp_path / "deltas"))), "update", "merged", wait=False)
    until("first chunks", lambda: spark.table("merged").count() == 2)
    write(tmp_path / "deltas", "2.json", chunks[4:])
    until("all chunks", lambda: spark.table("merged").count() == 4)
    query.stop()
    last = spark.table("merged").groupBy("message_id").agg(F.max_by("text", "chunks").alias("text"), F.max("chunks").alias("n"))
    assert {r.message_id: (r.text, r.n) for r in last.collect()} == {"m0": ("<0><2><4><6><8>", 5), "m1": ("<1><3><5><7><9>", 5)}


def test_status_stops_after_silence(spark, tmp_path):
    row = lambda s, i, kind: {"session_id": s, "event_index": i, "kind": kind, "role": None}
    write(tmp_path / "st", "1.json", [row("a", 0, "task_started"), row("b", 0, "task_started"), row("b", 1, "task_complete")])
    stream = spark.readStream.schema("session_id string, event_index long, kind string, role string").json(str(tmp_path / "st"))
    query = run(live.live_status(stream, stale_ms=500), "update", "statuses", wait=False)
    until("stopped", lambda: spark.table("statuses").filter("session_id = 'a' AND status = 'stopped'").count())
    query.stop()
    seen = {(r.session_id, r.status) for r in spark.table("statuses").collect()}
    assert {("a", "running"), ("a", "stopped"), ("b", "completed")} <= seen and ("b", "stopped") not in seen


def test_change_log(spark, tmp_path):
    write(tmp_path / "ch", "1.json", [{"id": 1, "title": "a", "changed_ms": 5}, {"id": 2, "title": "b", "changed_ms": 7}])
    stream = spark.readStream.schema("id long, title string, changed_ms long").json(str(tmp_path / "ch"))
    query = stream.writeStream.foreachBatch(live.change_log_sink(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    write(tmp_path / "ch", "2.json", [{"id": 1, "title": "c", "changed_ms": 9}])
    query.processAllAvailable()
    query.stop()
    current = live.latest_sessions(spark.read.parquet(str(tmp_path / "log")))
    assert {r.id: r.title for r in current.collect()} == {1: "c", 2: "b"}
    assert [(r.id, r.watermark_ms) for r in live.changes_since(current, 7).collect()] == [(1, 9)]


def test_hourly_counts_stream_equals_batch(spark, tmp_path):
    rows = [{"ts": f"2026-01-01T0{i % 5}:00:01Z", "kind": "k"} for i in range(20)]
    write(tmp_path / "h", "1.json", rows)
    stream = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path / "h"))
    query = run(live.hourly_counts(stream), "complete", "hours")
    query.stop()
    batch = live.hourly_counts(spark.read.schema("ts timestamp, kind string").json(str(tmp_path / "h")), None)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))
