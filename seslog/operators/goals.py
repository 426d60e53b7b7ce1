"""Goal control packets: user messages that a host writes to keep an agent working on a goal.

A packet is recognised by the exact text its host writes for a known goal state. Those texts belong to the hosts and
change with their versions, so they are passed in as templates with placeholders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import field, is_object, kind_of, text_at
from seslog.functions.ordered import event_block, ordered_scan, previous_row, running_sum

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SESSION_VERSION = 3


@dataclass(frozen=True)
class Template:
    """kind: start, update, resume or continuation; placeholders: {objective} {goal_id} {iteration} {tokens_used}
    {token_budget} {marker}."""

    kind: str
    text: str


def _count(value: Column) -> Column:
    """Non-negative JSON number."""
    return F.when((kind_of(value) == "number") & (F.try_variant_get(value, "$", "double") >= 0), F.try_variant_get(value, "$", "double"))


def _escaped(text: Column) -> Column:
    for source, target in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def _goal_state() -> Column:
    """The active goal a state record carries; NULL for any other record or an unknown shape."""
    raw = F.col("raw")
    goal = field(raw, "data.goal")
    get = lambda k: field(goal, k)
    counted = [_count(get(k)).isNotNull() for k in ("startedAt", "updatedAt", "iteration", "tokensUsed", "timeUsedSeconds", "baselineTokens")]
    valid = (F.col("raw_type") == "custom") & (text_at(raw, "customType") == "goal-state") & is_object(goal) & text_at(goal, "id").rlike(UUID)
    valid = valid & (kind_of(get("text")) == "string") & (text_at(goal, "status") == "active") & (_count(get("iteration")) % 1 == 0)
    for condition in counted:
        valid = valid & condition
    for name in ("activeStartedAt", "tokenBudget"):
        valid = valid & (F.try_variant_get(goal, f"$.{name}", "variant").isNull() | _count(get(name)).isNotNull())
    whole = lambda k: _count(get(k)).cast("long").cast("string")
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(
        text_at(raw, "id").alias("record_id"), F.col("event_index").alias("event_index"), text_at(goal, "text").alias("objective"), text_at(goal, "id").alias("goal_id"),
        whole("iteration").alias("iteration"), whole("tokensUsed").alias("tokens_used"), whole("tokenBudget").alias("token_budget")))


def message_goals(events: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Packets of the message dialect: (session_id, event_index, goal_kind, goal_text).

    A packet directly follows the record of an active goal state, names it as its parent and equals a template filled
    with that state. Start and update packets show the objective, the others are hidden; the state record itself too.
    """
    known = events.filter(F.col("event_index") == 0).filter(
        (F.col("raw_type") == "session") & (text_at(F.col("raw"), "version") == str(SESSION_VERSION))).select("session_id")
    rows = events.join(known, "session_id", "left_semi").withColumn("__goal", _goal_state())
    rows = ordered_scan(rows, ["session_id"], event_block(), ["event_index"], __state=previous_row(F.col("__goal")))
    raw, state = F.col("raw"), F.col("__state")
    content = F.try_variant_get(raw, "$.message.content", "array<variant>")
    single = F.get(content, 0)
    strict = (F.col("raw_type") == "message") & (text_at(raw, "message.role") == "user") & (F.size(content) == 1) & (text_at(single, "type") == "text")
    strict = strict & (text_at(raw, "parentId") == state["record_id"])
    text = text_at(single, "text")
    marker = F.regexp_extract(text, r"pi-goal-continuation:([^\s>]+)", 1)
    fresh = marker.startswith(F.concat_ws(":", state["goal_id"], state["iteration"], F.lit(""))) & F.element_at(F.split(marker, ":"), -1).rlike(UUID)
    kind = None
    for template in templates:
        filled = F.lit(template.text)
        for name, value in {
            "objective": _escaped(state["objective"]), "goal_id": _escaped(state["goal_id"]), "iteration": state["iteration"], "tokens_used": state["tokens_used"],
            "token_budget": state["token_budget"], "marker": marker,
        }.items():
            if "{" + name + "}" in template.text:
                filled = F.replace(filled, F.lit("{" + name + "}"), value)
        same = (text == filled) & (fresh if template.kind == "continuation" else F.lit(True))
        kind = F.when(same, template.kind) if kind is None else kind.when(same, template.kind)
    found = rows.filter(strict & state.isNotNull()).withColumn("__kind", kind).filter("__kind IS NOT NULL")
    shown = F.col("__kind").isin("start", "update")
    packets = found.select(
        "session_id", "event_index", F.when(shown, "objective").otherwise("suppress").alias("goal_kind"), F.when(shown, state["objective"]).alias("goal_text"))
    states = found.select("session_id", state["event_index"].alias("event_index"), F.lit("suppress-state").alias("goal_kind"), F.lit(None).cast("string").alias("goal_text"))
    return packets.unionByName(states)


def thread_goals(events: DataFrame, template: str) -> DataFrame:
    """Packets of the generic dialect: (session_id, event_index, goal_kind, goal_text).

    A goal update is accepted only if neither its time nor its token count go back; a damaged record resets the state.
    A packet equals the template for the accepted objective with a token count not below what was seen before. Each
    objective is shown once, later packets are hidden. Which update is accepted depends on the one accepted before, so
    the goal records between two damaged records of a session are folded in order; only these records, with their ids,
    numbers and packet texts, reach the fold.
    """
    raw, payload = F.col("raw"), F.col("payload")
    head = events.filter((F.col("event_index") == 0) & (F.col("raw_type") == "session_meta")).select("session_id", text_at(payload, "session_id").alias("__thread"), text_at(payload, "id").alias("__id"))
    threads = head.filter((F.col("__thread") == F.col("__id")) & F.col("__thread").rlike(UUID)).select("session_id", "__thread")
    rows = events.join(threads, "session_id")
    bad = F.col("semantic_kind") == "diagnostic"
    goal = field(payload, "goal")
    numbers = [_count(field(goal, k)) for k in ("tokensUsed", "timeUsedSeconds", "createdAt", "updatedAt")]
    update = (F.col("raw_type") == "event_msg") & (F.col("payload_type") == "thread_goal_updated") & (text_at(payload, "threadId") == F.col("__thread")) & (text_at(goal, "threadId") == F.col("__thread"))
    update = update & (text_at(goal, "status") == "active") & (F.length(F.btrim(text_at(goal, "objective"))) > 0) & (numbers[3] >= numbers[2])
    for value in numbers:
        update = update & value.isNotNull()
    content = F.try_variant_get(payload, "$.content", "array<variant>")
    asked = (F.col("raw_type") == "response_item") & (F.col("payload_type") == "message") & (F.col("role") == "user") & (F.size(content) == 1)
    asked = asked & (text_at(F.get(content, 0), "type") == "input_text") & text_at(payload, "internal_chat_message_metadata_passthrough.turn_id").rlike(UUID)
    opening = template.split("{objective}")[0]
    packet = F.when(asked, text_at(F.get(content, 0), "text"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    narrow = rows.select(
        "session_id", "event_index", bad.alias("bad"), F.when(yes(update), text_at(goal, "objective")).alias("objective"), F.when(yes(update), numbers[0]).alias("tokens"),
        F.when(yes(update), numbers[3]).alias("updated"), F.when(yes(packet.startswith(opening)), packet).alias("packet"))
    parts = ordered_scan(narrow.filter("bad OR objective IS NOT NULL OR packet IS NOT NULL"), ["session_id"], event_block(), ["event_index"], part=running_sum(F.col("bad").cast("int")))
    key = events.schema["session_id"].dataType.simpleString()
    before, after = template.split("{tokens_used}")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state, lowest, out = None, 0.0, []
        for row in group.sort_values("event_index").itertuples(index=False):
            if row.objective is not None and isinstance(row.objective, str):
                if state is None or (row.updated >= state[1] and row.tokens >= state[2]):
                    state, lowest = (row.objective, row.updated, row.tokens), row.tokens
            elif state is not None and isinstance(row.packet, str):
                prefix, suffix = before.replace("{objective}", state[0]), after.replace("{objective}", state[0])
                number = row.packet[len(prefix): len(row.packet) - len(suffix)]
                if row.packet.startswith(prefix) and row.packet.endswith(suffix) and number.isascii() and number.isdigit() and int(number) >= lowest:
                    lowest = float(number)
                    out.append((row.session_id, row.event_index, state[0]))
        return pd.DataFrame(out, columns=["session_id", "event_index", "objective"])

    packets = parts.filter("NOT bad").groupBy("session_id", "part").applyInPandas(fold, f"session_id {key}, event_index long, objective string")
    firsts = packets.groupBy("session_id", "objective").agg(F.min("event_index").alias("__first"))
    first = F.col("event_index") == F.col("__first")
    return packets.join(firsts, ["session_id", "objective"]).select(
        "session_id", "event_index", F.when(first, "objective").otherwise("suppress").alias("goal_kind"), F.when(first, F.col("objective")).alias("goal_text"))


def first_objectives(goals: DataFrame) -> DataFrame:
    """The objective a session's list title shows instead of a control packet."""
    return goals.filter("goal_kind = 'objective'").groupBy(F.col("session_id").alias("id")).agg(F.min_by("goal_text", "event_index").alias("objective"))
