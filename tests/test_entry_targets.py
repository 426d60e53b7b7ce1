"""Targets of replaced history entries against a plain search through the items of the turn."""

import random

from pyspark.sql import functions as F

from seslog.operators import reading as rd

ITEM = "session_id string, turn_index long, item_index long, type string, text string, name string, call_id string, arguments string, output string, message_id string, ts_ms long"
ENTRY = "session_id string, compact_event long, entry_index long, target_turn long, role string, type string, content_kinds array<string>, message_id string, call_id string, preview string, timestamp string"


def search(entry, items):
    """The choice for an entry without a known id."""
    wanted = {"user": "user-message", "assistant": "assistant-message", "tool": "tool-call"}.get(entry["role"])
    fit = [i for i in items if i["session_id"] == entry["session_id"] and i["turn_index"] == entry["target_turn"] and (wanted is None or i["type"] == wanted)]
    if not fit:
        return None
    preview = " ".join((entry["preview"] or "").split()).lower()
    text = lambda i: " ".join(x for x in (i["text"], i["name"], i["message_id"]) if x).lower()
    held = [i["item_index"] for i in fit if preview and (preview in text(i) or text(i)[:80] in preview)]
    if held:
        return min(held)
    if len(fit) == 1:
        return fit[0]["item_index"]
    before = [i["item_index"] for i in fit if entry["at"] is not None and i["ts_ms"] is not None and i["ts_ms"] <= entry["at"]]
    if before:
        return max(before)
    return max(i["item_index"] for i in fit) if entry["role"] == "assistant" else min(i["item_index"] for i in fit)


def test_targets_equal_a_plain_search(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "a longer piece of text", "x"]
    say = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    items, entries = [], []
    for session in "ab":
        for turn in range(6):
            for n in range(r.randint(0, 7)):
                items.append({"session_id": session, "turn_index": turn, "item_index": n, "type": r.choice([*rd.TARGET_TYPES, "token-count"]), "text": r.choice([None, say(3), say(30)]), "name": r.choice([None, "tool"]), "call_id": None, "arguments": None, "output": None, "message_id": None, "ts_ms": r.choice([None, r.randint(0, 9) * 1000])})
            for n in range(8):
                at = r.choice([None, r.randint(0, 9) * 1000])
                entries.append({"session_id": session, "compact_event": turn, "entry_index": n, "target_turn": turn, "role": r.choice(["user", "assistant", "tool", "other", None]), "type": "message", "content_kinds": None, "message_id": None, "call_id": None,
                                "preview": r.choice([None, "", say(2), say(40)]), "timestamp": None if at is None else f"1970-01-01T00:00:0{at // 1000}Z", "at": at})
    frame = spark.createDataFrame([tuple(v for k, v in e.items() if k != "at") for e in entries], ENTRY)
    got = rd.entry_targets(frame, spark.createDataFrame([tuple(i.values()) for i in items], ITEM))
    usable = [i for i in items if i["type"] in rd.TARGET_TYPES]
    want = {(e["session_id"], e["compact_event"], e["entry_index"]): t for e in entries if (t := search(e, usable)) is not None}
    assert {(x.session_id, x.compact_event, x.entry_index): x.item_index for x in got.collect()} == want


def test_a_crowded_turn_stays_linear(spark):
    n = 5_000
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("every item says this, and its number is <"), F.col("id").cast("string"), F.lit(">"))
    items = spark.range(n).select(F.lit("s").alias("session_id"), F.lit(0).cast("long").alias("turn_index"), F.col("id").alias("item_index"), F.lit("user-message").alias("type"), text.alias("text"), *[none.alias(c) for c in ("name", "call_id", "arguments", "output", "message_id")], F.col("id").alias("ts_ms"))
    preview = F.when(F.col("id") % 2 == 0, text).otherwise("every item says this")
    entries = spark.range(n).select(F.lit("s").alias("session_id"), F.lit(0).cast("long").alias("compact_event"), F.col("id").alias("entry_index"), F.lit(0).cast("long").alias("target_turn"), F.lit("user").alias("role"), F.lit("message").alias("type"),
                                    F.lit(None).cast("array<string>").alias("content_kinds"), none.alias("message_id"), none.alias("call_id"), preview.alias("preview"), none.alias("timestamp"))
    got = rd.entry_targets(entries, items)
    assert got.filter("item_index <> CASE WHEN entry_index % 2 = 0 THEN entry_index ELSE 0 END").count() == 0 and got.count() == n


def _entries_and_items(spark):
    none = F.lit(None).cast("string")
    items = spark.range(6).select(F.lit("s").alias("session_id"), F.lit(0).cast("long").alias("turn_index"), F.col("id").alias("item_index"), F.when(F.col("id") % 2 == 0, "user-message").otherwise("assistant-message").alias("type"),
                                  F.concat(F.lit("says  <"), F.col("id").cast("string"), F.lit(">")).alias("text"), *[none.alias(c) for c in ("name", "call_id", "arguments", "output", "message_id")], F.col("id").alias("ts_ms"))
    entries = items.select("session_id", F.lit(0).cast("long").alias("compact_event"), F.col("item_index").alias("entry_index"), F.col("turn_index").alias("target_turn"), F.substring_index("type", "-", 1).alias("role"), F.lit("message").alias("type"),
                           F.lit(None).cast("array<string>").alias("content_kinds"), none.alias("message_id"), none.alias("call_id"), F.concat(F.lit("Says <"), F.col("item_index").cast("string")).alias("preview"), none.alias("timestamp"))
    return entries, items.withColumn("text", F.regexp_replace("text", "  ", " "))


def test_the_plan_of_targets_repeats_nothing(spark):
    """Each branch once held all that came before it, so the driver held a plan many times as large as the query."""
    entries, items = _entries_and_items(spark)
    got = rd.entry_targets(entries, items)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and plan.count("join ") <= 6
    assert sorted((x.entry_index, x.item_index) for x in got.collect()) == [(i, i) for i in range(6)]


def test_references_are_joined_to_staged_targets(spark):
    entries, items = _entries_and_items(spark)
    got = rd.compression_references(rd.entry_targets(entries, items), rd.owners(items))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("join ") <= 9
    assert sorted((x.entry_index, x.owner_index) for x in got.collect()) == [(i, i) for i in range(6)]
