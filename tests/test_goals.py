import json

from test_logs import GENERIC

from seslog.functions.staging import stage
from seslog.operators import goals as gl
from seslog.operators.normalize import normalize
from seslog.sources.logs import parse_records

START = gl.Template("start", "Goal: {objective} ({goal_id})")
NEXT = gl.Template("continuation", "Continue {objective} #{iteration} pi-goal-continuation:{marker}")
GOAL_ID = "0a0a0a0a-0a0a-4a0a-8a0a-0a0a0a0a0a0a"


def events(spark, records):
    lines = spark.createDataFrame(
        [(i, i + 1, r if isinstance(r, str) else json.dumps(r), False) for i, r in enumerate(records)], "event_index long, line_number long, line string, blank boolean")
    return stage(normalize(parse_records(lines.selectExpr("'s' AS session_id", "*"))))


def test_message_dialect_packets(spark):
    state = {"type": "custom", "customType": "goal-state", "id": "g1", "data": {"goal": {
        "id": GOAL_ID, "text": "ship <it>", "status": "active", "startedAt": 1, "updatedAt": 2, "iteration": 3, "tokensUsed": 4, "timeUsedSeconds": 5, "baselineTokens": 0}}}
    user = lambda text, parent="g1": {"type": "message", "id": "u", "parentId": parent, "message": {"role": "user", "content": [{"type": "text", "text": text}]}}
    opening = f"Goal: ship &lt;it&gt; ({GOAL_ID})"
    follow = f"Continue ship &lt;it&gt; #3 pi-goal-continuation:{GOAL_ID}:3:{GOAL_ID}"
    log = [{"type": "session", "version": 3}, state, user(opening), state, user(follow), user(opening), state, user(opening, "other"), state, user(opening + "!")]
    got = {r.event_index: (r.goal_kind, r.goal_text) for r in gl.message_goals(events(spark, log), [START, NEXT]).collect()}
    assert got == {1: ("suppress-state", None), 2: ("objective", "ship <it>"), 3: ("suppress-state", None), 4: ("suppress", None)}


def test_generic_dialect_packets(spark):
    meta = {"type": "session_meta", "payload": {"id": GENERIC, "session_id": GENERIC}}
    goal = lambda text, tokens, at: {"type": "event_msg", "payload": {"type": "thread_goal_updated", "threadId": GENERIC, "goal": {
        "threadId": GENERIC, "objective": text, "status": "active", "tokensUsed": tokens, "timeUsedSeconds": 0, "createdAt": 0, "updatedAt": at}}}
    packet = lambda text, n: {"type": "response_item", "payload": {
        "type": "message", "role": "user", "content": [{"type": "input_text", "text": f"GO {text} used {n} end"}], "internal_chat_message_metadata_passthrough": {"turn_id": GENERIC}}}
    log = [
        meta, goal("a", 10, 1), packet("a", 9), packet("a", 10), goal("b", 5, 2), packet("a", 12), packet("a", 11), "{bad", packet("a", 50), goal("b", 1, 1), packet("b", 3), packet("b", "x")]
    got = {r.event_index: (r.goal_kind, r.goal_text) for r in gl.thread_goals(events(spark, log), "GO {objective} used {tokens_used} end").collect()}
    assert got == {3: ("objective", "a"), 5: ("suppress", None), 10: ("objective", "b")}
