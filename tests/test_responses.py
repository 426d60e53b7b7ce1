import json

from test_turns import slim

from seslog.operators import responses as rs
from seslog.operators import turns as tn


def test_usage_goes_to_the_response_that_ended_before_it(spark):
    at = lambda s: f"2026-09-09T03:00:{s}Z"
    item = lambda t, **p: {"type": "response_item", "timestamp": at(t), "payload": p}
    msg = lambda t, **p: {"type": "event_msg", "timestamp": at(t), "payload": p}
    usage = lambda t, total, out, reason: msg(t, type="token_count", info={
        "total_token_usage": {"total_tokens": total}, "model_context_window": 100_000, "last_token_usage": {"output_tokens": out, "reasoning_output_tokens": reason}})
    events = [
        msg("05.000", type="user_message", message="begin"), item("20.000", type="reasoning", summary=[{"text": "think"}]),
        item("32.197", type="function_call", name="bash", call_id="c", arguments="pwd"), item("32.268", type="function_call_output", call_id="c", output="/data/dev"),
        usage("32.269", 40_000, 344, 44), item("44.491", type="reasoning", summary=[{"text": "more"}]),
        item("48.298", type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]), usage("48.300", 36_000, 692, 556),
    ]
    built = tn.assemble(slim(spark, [("s", i, json.dumps(e)) for i, e in enumerate(events)]), block_size=3)
    rows = rs.with_tool_call_tokens(rs.measured_responses(built.items, built.turns, 2), built.items).orderBy("start_ms").collect()
    base = 1_788_922_800_000
    assert [(r.start_ms - base, r.end_ms - base) for r in rows] == [(5_000, 32_197), (32_268, 48_298)]
    assert [(r.generated_tokens, r.tool_call_tokens) for r in rows] == [(390, 2), (1_248, 0)]
    usage_items = [i.context_usage.percent for i in built.items.filter("type = 'token-count'").orderBy("item_index").collect()]
    assert usage_items == [40, 36]
    inferred = rs.inferred_responses(built.items, built.turns, 2)
    assert rs.measured_else_inferred(rs.measured_responses(built.items, built.turns), inferred).filter("NOT measured").count() == 0


def test_context_percent_rules(spark):
    from pyspark.sql import functions as F

    from seslog.operators.context import context_usage

    cases = {
        '{"percent":0.5}': (50, None, None), '{"context_percent":250}': (100, None, None), '{"percent":0}': (1, None, None),
        '{"total_token_usage":{"total_tokens":90},"last_token_usage":{"total_tokens":"1,000"},"model_context_window":4000}': (25, 1000, 4000),
        '{"last_token_usage":{"input_tokens":30,"output_tokens":20},"context_window":200}': (25, 50, 200), '{"last_token_usage":{"total_tokens":5}}': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", context_usage(F.parse_json("t")).alias("u"))
    assert {r.t: r.u and (r.u.percent, r.u.used, r.u.limit) for r in df.collect()} == cases


def test_history_text_is_walked_as_deep_as_the_reference(spark):
    import random

    from pyspark.sql import functions as F

    from seslog.operators.normalize import _history_entry

    keys = ("text", "value", "message", "content", "summary", "output", "input", "arguments")

    def text(value, depth=0):
        if value is None or depth > 4:
            return ""
        if isinstance(value, str):
            return value
        if isinstance(value, list):
            return "\n".join(t for t in (text(v, depth + 1) for v in value) if t)
        if value.get("encrypted_content") is not None:
            return "[encrypted_content redacted]"
        return "\n".join(dict.fromkeys(t for t in (text(value.get(k), depth + 1) for k in keys) if t))

    def whole(entry):
        if not isinstance(entry, dict):
            return text(entry)
        return "\n\n".join(t for t in (text(entry.get(k)) for k in ("content", "message", "text", "value", "output", "arguments")) if t)

    r = random.Random(2)

    def made(depth):
        pick = r.random()
        if depth == 0 or pick < 0.2:
            return r.choice(["a", "b", "c", "", None])
        if pick < 0.55:
            return [made(depth - 1) for _ in range(r.randint(0, 3))]
        if pick < 0.6:
            return {"encrypted_content": "z"}
        return {k: made(depth - 1) for k in r.sample(keys, 2)}

    entries = [{"content": [{"content": [{"text": "x"}]}]}, {"content": [["same", "same"]]}, {"output": {"message": {"content": [{"text": "deep"}]}}}]
    entries += [{"content": made(6), "output": made(5)} for _ in range(60)] + [[made(5)] for _ in range(20)]
    assert whole(entries[0]) == "x"
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)], "i int, e string")
    got = {g.i: g.t for g in rows.select("i", _history_entry(F.parse_json("e"), F.lit(0))["preview"].alias("t")).collect()}
    assert [got[i] for i in range(len(entries))] == [whole(e).strip() for e in entries]
