"""Names inside texts against a plain substring test, and spawn calls against a walk over the events."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seslog.operators import contains, trace


def test_names_equal_a_plain_search(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abé😀 ") for _ in range(n))
    names = [(g, word(r.randint(0, 30))) for g in "xy" for _ in range(60)] + [("x", None), ("z", "alone"), ("x", "a name of more than twelve"), ("x", "a name of more than twelvf")]
    texts = [(g, i, word(r.randint(0, 80)) + r.choice(names)[1].__str__()) for g in "xyw" for i in range(60)] + [("x", 900, None), ("x", 901, ""), ("x", 902, "so a name of more than twelve")]
    got = contains.contained_names(spark.createDataFrame(texts, "g string, i int, text string"), spark.createDataFrame(names, "g string, name string"), "g", ["i"])
    want = {(g, i, n) for g, i, t in texts for h, n in names if g == h and n and t and n in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def walk(calls, children):
    """The assignment one event after another."""
    by_child, explicit = {}, set()
    ids = {c["child_id"] for c in children}
    for call in sorted(calls, key=lambda c: c["event_index"]):
        args = json.loads(call["arguments"])
        named = args.get("agent_id") or args.get("thread_id") or args.get("target")
        if named in ids:
            by_child[named] = call["event_index"]
            explicit.add(named)
            continue
        message = args.get("message") or args.get("prompt") or ""
        for child in sorted(children, key=lambda c: c["child_order"]):
            if child["child_id"] not in by_child and any(child[k] and child[k] in message for k in ("nickname", "role", "title")):
                by_child[child["child_id"]] = call["event_index"]
                break
    return {(c, e, c in explicit) for c, e in by_child.items()}


CALL = "session_id string, event_index long, ts_ms long, name string, arguments string"
CHILD = "session_id string, child_id string, child_order int, nickname string, role string, title string"


@pytest.mark.parametrize("seed", range(3))
def test_spawn_calls_equal_the_walk(spark, seed):
    r = random.Random(seed)
    roles = ["worker", "reviewer", "work", None, ""]
    calls, children = [], []
    for session in "abcd":
        children += [{"session_id": session, "child_id": f"id{i}", "child_order": i, "nickname": r.choice([None, f"nick{i % 5}", f"nick{i}"]), "role": r.choice(roles), "title": r.choice([None, "a title longer than a gram " + str(i % 3)])} for i in range(15)]
        for event in range(60):
            body = {"message": " ".join(r.choice(["worker", "reviewer", "please", f"nick{r.randint(0, 15)}", "a title longer than a gram " + str(r.randint(0, 3))]) for _ in range(r.randint(0, 3)))}
            if r.random() < 0.2:
                body = {r.choice(["agent_id", "thread_id", "target"]): f"id{r.randint(0, 18)}", **body}
            calls.append({"session_id": session, "event_index": event, "ts_ms": event, "name": "spawn_agent", "arguments": json.dumps(body)})
    got = trace.spawn_matches(spark.createDataFrame([tuple(c.values()) for c in calls], CALL), spark.createDataFrame([tuple(c.values()) for c in children], CHILD))
    rows = {}
    for row in got.collect():
        rows.setdefault(row.session_id, set()).add((row.child_id, row.event_index, row.explicit))
    for session in "abcd":
        assert rows.get(session, set()) == walk([c for c in calls if c["session_id"] == session], [c for c in children if c["session_id"] == session])


def test_a_crowded_session_stays_linear(spark):
    """Every call and every child share a role, and each child has a nickname of its own."""
    n = 20_000
    calls = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("event_index"), F.col("id").alias("ts_ms"), F.lit("spawn_agent").alias("name"),
                                  F.to_json(F.struct(F.concat(F.lit("worker, ask <nick"), F.col("id").cast("string"), F.lit(">")).alias("message"))).alias("arguments"))
    kids = spark.range(n).select(F.lit("s").alias("session_id"), F.concat(F.lit("id"), F.col("id").cast("string")).alias("child_id"), F.col("id").cast("int").alias("child_order"),
                                 F.concat(F.lit("<nick"), F.col("id").cast("string"), F.lit(">")).alias("nickname"), F.lit("worker").alias("role"), F.lit(None).cast("string").alias("title"))
    got = trace.spawn_matches(calls, kids).cache()
    assert got.count() == n and got.filter("child_id <> concat('id', event_index)").count() == 0
    texts = calls.select("session_id", "event_index", "arguments")
    assert contains.contained_names(texts, kids.select("session_id", F.explode(F.array("nickname", "role")).alias("name")), "session_id", ["event_index"], "arguments").count() == 2 * n


def test_crowded_groups_are_indexed_and_others_tried(spark, monkeypatch):
    """Groups of few names and crowded ones side by side; repeated and null keys."""
    monkeypatch.setattr(contains, "FEW", 20)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    names = [("few", word(r.randint(1, 20))) for _ in range(10)] + [("many", word(r.randint(1, 20))) for _ in range(60)] + [(None, "a"), ("few", "")]
    texts = [(g, i % 30, word(r.randint(0, 40)) + r.choice(names)[1]) for g in ("few", "many") for i in range(40)] + [("few", None, names[0][1]), (None, 1, "a"), ("many", None, names[20][1])]
    got = contains.contained_names(spark.createDataFrame(texts, "g string, i int, text string"), spark.createDataFrame(names, "g string, name string"), "g", ["i"])
    want = {(g, i, n) for g, i, t in texts for h, n in names if g is not None and i is not None and g == h and n and n in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_small_sessions_share_a_call_into_python(spark):
    calls = spark.range(600).select((F.col("id") % 200).alias("session_id"), F.col("id").alias("event_index"), F.col("id").alias("ts_ms"), F.lit("spawn_agent").alias("name"),
                                    F.lit('{"message": "ask the worker"}').alias("arguments"))
    kids = spark.range(400).select((F.col("id") % 200).alias("session_id"), F.col("id").alias("child_id"), F.lit(None).cast("int").alias("child_order"),
                                   F.lit("worker").alias("nickname"), F.lit(None).cast("string").alias("role"), F.lit("").alias("title"))
    got = trace.spawn_matches(calls, kids)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    assert sorted((x.session_id, x.child_id, x.event_index) for x in got.collect()) == sorted((i % 200, i, i) for i in range(400))


def test_notifications_are_parsed_once(spark):
    """The branches read what was parsed; none repeats the parsing."""
    note = '<subagent_notification>{"agent_path": " kid1 ", "status": "done"}</subagent_notification>'
    events = [("s", 1, 1, note, "x"), ("s", 2, 2, "see below", "subagent_notification about kid2"), ("s", 3, 3, "{}", "kid2 is not told of"),
              ("s", 4, 4, "x", '{"type": "subagent_notification"} kid1'), ("s", 5, 5, '{"agentId": "kid3", "thread_id": "kid2"}', None), ("s", 6, 6, '{"agent_id": "kid9"}', "agent_path kid1"), (None, 7, 7, note, "x"), ("s", None, 8, "x", "agent_path kid4")]
    kids = [("s", f"kid{i}") for i in (1, 2, 3, 4)] + [("s", "kid1"), ("t", "kid1"), (None, "kid1"), ("s", None)]
    got = trace.notification_matches(spark.createDataFrame(events, "session_id string, event_index long, ts_ms long, text string, record string"), spark.createDataFrame(kids, "session_id string, child_id string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "parse_json" not in plan and "parsejson" not in plan and "variantexpressionevalutils" not in plan
    assert sorted(map(tuple, got.collect())) == [("s", "kid1", 6, 6), ("s", "kid2", 5, 5), ("s", "kid3", 5, 5)]
