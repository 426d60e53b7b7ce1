import random

from pyspark.sql import functions as F
from test_logs import GENERIC, PI, UUID

from seslog.operators import segment
from seslog.operators import turns as tn


def by_session(df, session, *order):
    return df.filter(F.col("session_id") == session).orderBy(*order).collect()


def test_generic_session(fixture_assembly):
    turns = by_session(fixture_assembly.turns, GENERIC, "turn_index")
    assert [(t.turn_id, t.status, t.n_items) for t in turns] == [("turn-a", "completed", 6), ("turn-b", "aborted", 2)]
    assert turns[0].context.model == "m-1" and turns[0].cwd == "/work/app"
    items = by_session(fixture_assembly.items, GENERIC, "turn_index", "item_index")
    assert [i.type for i in items] == [
        "user-message", "reasoning", "tool-call", "assistant-message", "token-count", "event", "user-message", "context-compact"]
    call = items[2]
    assert (call.status, call.output, call.output_index, call.completed_ms - call.ts_ms) == ("completed", "ok and more", 8, 3500)
    assert items[4].context_usage.percent == 50 and items[4].token_usage.generated_tokens == 100
    assert items[6].text == "Again"


def test_message_and_uuid_sessions(fixture_assembly):
    pi = by_session(fixture_assembly.items, PI, "turn_index", "item_index")
    assert [(i.turn_index, i.type) for i in pi] == [(0, "user-message"), (0, "assistant-message"), (0, "tool-call"), (0, "assistant-message"), (1, "user-message")]
    assert pi[1].token_usage.cost == 0.25 and pi[1].reasoning.encrypted
    uuid = [i for i in by_session(fixture_assembly.items, UUID, "item_index") if i.type == "tool-call"]
    assert [(i.call_id, i.name, i.status, i.output) for i in uuid] == [("k1", "Bash", "completed", "a b"), ("k2", "Read", "failed", "boom")]


def test_status(fixture_assembly, spark):
    got = {r.session_id: r.status for r in tn.session_status(fixture_assembly.turns).collect()}
    assert got == {GENERIC: "aborted", PI: "running", UUID: "waiting"}
    files = fixture_assembly.turns.select("session_id").distinct().withColumn("mtime_ms", F.lit(0))
    assert {r.session_id: r.status for r in tn.session_status(fixture_assembly.turns, files, 1_800_000).collect()}[PI] == "stopped"


def test_titles_and_metadata(fixture_events):
    from seslog.functions.js import text_at
    from seslog.functions.redact import clean_user_text
    from seslog.operators.sessions import parent_session_id, session_metadata, session_titles

    meta = {r.session_id: r for r in session_metadata(fixture_events).collect()}
    assert (meta[GENERIC].cwd, meta[GENERIC].model, meta[GENERIC].originator) == ("/work/app", "m-1", "cli")
    assert (meta[PI].model, meta[PI].model_provider, meta[PI].source) == ("m-2", "prov", "pi-agent")
    assert (meta[UUID].cwd, meta[UUID].model, meta[UUID].originator) == ("/work/cc", "m-3", "claude_code")
    parent = session_metadata(fixture_events).select("session_id", parent_session_id(F.col("parent_session")).alias("p"))
    assert {r.session_id: r.p for r in parent.collect()}[PI] == "33333333-3333-4333-8333-333333333333"
    rows = fixture_events.withColumns({"info_name": text_at(F.col("raw"), "name"), "user_text": clean_user_text(F.col("text"))})
    assert {r.session_id: r.title for r in session_titles(rows).collect()} == {GENERIC: "Please fix the build", PI: "Pi session", UUID: "do two things"}


def slim(spark, rows):
    """Slim events from (session, kind, text, options)."""
    from seslog.functions.staging import stage
    from seslog.operators.normalize import normalize
    from seslog.sources.logs import parse_records

    lines = spark.createDataFrame([(s, i, i + 1, line, False) for s, i, line in rows], "session_id string, event_index long, line_number long, line string, blank boolean")
    return tn.slim_events(stage(normalize(parse_records(lines))))


def event(kind, **payload):
    import json

    return json.dumps({"type": "event_msg", "timestamp": payload.pop("ts", None), "payload": {"type": kind, **payload}})


def test_fork_replay_resume_and_repeats(spark):
    fork = [event("user_message", message="old"), event("user_message", message="older"), event("agent_message", message="old answer"), event("task_started", turn_id="t"), event("user_message", message="new"), event("agent_message", message="answer")]
    resume = [event("task_started", turn_id="a"), event("user_message", message="go  on"), event("turn_aborted"), event("task_started", turn_id="b"), event("user_message", message="go on"), event("agent_message", message="ok")]
    repeat = [event("user_message", message="same"), event("user_message", message="same"), event("agent_message", message="x"), event("agent_message", message="x")]
    rows = [(s, i, line) for s, block in (("fork", fork), ("resume", resume), ("repeat", repeat)) for i, line in enumerate(block)]
    built = tn.assemble(slim(spark, rows), block_size=2)
    texts = {s: [(i.turn_index, i.text) for i in by_session(built.items, s, "turn_index", "item_index")] for s in ("fork", "resume", "repeat")}
    assert texts["fork"] == [(0, "new"), (0, "answer")]
    assert texts["resume"] == [(1, "go on"), (1, "ok")]
    assert texts["repeat"] == [(0, "same"), (0, "same"), (0, "x")]
    assert [t.status for t in by_session(built.turns, "resume", "turn_index")] == ["aborted", "waiting"]


def brute_force_starts(codes):
    state, out = segment.EMPTY, []
    for i, code in enumerate(codes):
        state, start = segment.step(state, code)
        if start:
            out.append(i)
    return out


def test_segmentation_in_blocks_equals_one_pass(spark):
    random.seed(7)
    sessions = {f"s{k}": [random.choice(segment.CODES[:]) for _ in range(n)] for k, n in enumerate((1, 5, 200, 731))}
    df = spark.createDataFrame([(s, i, c) for s, codes in sessions.items() for i, c in enumerate(codes)], "session_id string, event_index long, code int")
    got = {}
    for row in segment.turn_starts(df, 16).collect():
        got.setdefault(row.session_id, []).append(row.event_index)
    for s, codes in sessions.items():
        assert sorted(got.get(s, [])) == brute_force_starts(codes)


def test_user_turn_needs_an_answer_or_an_ended_turn():
    ask = segment.ASK | segment.ITEM
    assert brute_force_starts([segment.OPEN | segment.ITEM, ask, segment.ANSWER, ask]) == [0, 3]
    assert brute_force_starts([segment.OPEN, segment.TERMINAL, segment.ASK, ask, ask]) == [0, 4]
    assert brute_force_starts([segment.OPEN, segment.SAME_TURN, segment.ANSWER, ask, segment.SAME_TURN]) == [0, 3, 4]
