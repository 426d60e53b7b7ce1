"""events -> turns and items: segmentation, typing, de-duplication, call/result pairing, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import text_at
from seslog.functions.ordered import (
    EVENTS_PER_BLOCK, event_block, following_row, last_value, ordered_scan, running_sum,
)
from seslog.functions.redact import clean_user_text, is_machine_only
from seslog.functions.staging import stage
from seslog.functions.text import nonempty, normalize_text, trim_space
from seslog.operators import segment
from seslog.operators.context import payload_context_usage

WAIT_CALLS = ("wait_agent", "handoff")
STALE_RUNNING_MS = 30 * 60 * 1000
TERMINAL_STATUS = {"task_complete": "completed", "task_failed": "failed", "turn_aborted": "aborted"}
SESSION, TURN = ["session_id"], ["session_id", "turn_seq"]


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_user_message() -> Column:
    return _true((F.col("kind") == "user_message") | ((F.col("semantic_kind") == "message") & (F.col("role") == "user")))


def is_assistant_message() -> Column:
    return _true((F.col("kind") == "agent_message") | ((F.col("semantic_kind") == "message") & (F.col("role") == "assistant")))


def merge_output(previous: Column, following: Column) -> Column:
    """Two outputs of one call: the longer one if it contains the other, else both with a blank line between."""
    left, right = trim_space(previous), trim_space(following)
    return (
        F.when(nonempty(following).isNull(), previous).when(nonempty(previous).isNull(), following)
        .when((right == "") | F.contains(left, right), previous).when(F.contains(right, left), following)
        .otherwise(F.concat(left, F.lit("\n\n"), right))
    )


def coalesce_deltas(events: DataFrame) -> DataFrame:
    """Chunks of one message become one event at the first chunk's place, texts joined in order."""
    delta = _true(F.col("is_delta") & F.col("message_id").isNotNull() & (F.col("semantic_kind") == "message"))
    flagged = events.withColumn("__delta", delta)
    keys = ["session_id", "message_id", "role", "kind"]
    rest = [c for c in events.columns if c not in (*keys, "event_index", "text", "ts_ms", "attachments")]
    pieces = F.array_sort(F.collect_list(F.struct("event_index", F.coalesce("text", F.lit("")).alias("text"))))
    extra = {}
    if "attachments" in events.columns:
        gathered = F.array_sort(F.collect_list(F.struct("event_index", F.col("attachments").alias("a"))))
        extra["attachments"] = F.flatten(F.transform(gathered, lambda p: p["a"]))
    merged = (
        flagged.filter("__delta").groupBy(*keys)
        .agg(
            F.min("event_index").alias("__first"),
            F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
            F.min_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("event_index"))).alias("ts_ms"),
            F.max_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("event_index"))).alias("delta_completed_ms"),
            F.count(F.lit(1)).alias("chunks"),
            F.min_by(F.struct(*rest), "event_index").alias("__rest"),
            *[expr.alias(name) for name, expr in extra.items()],
        )
        .select(*keys, F.col("__first").alias("event_index"), "text", "ts_ms", *extra, "delta_completed_ms", "chunks", "__rest.*")
    )
    plain = flagged.filter(~F.col("__delta")).drop("__delta")
    return plain.unionByName(merged, allowMissingColumns=True)


def drop_fork_replay(events: DataFrame) -> DataFrame:
    """Without the replayed transcript before the first task start of a forked session."""
    index = F.col("event_index")
    starts = events.filter("payload_type = 'task_started'").groupBy("session_id").agg(F.min("event_index").alias("__start"))
    transcript = _true(
        (F.col("role") == "assistant") | F.col("semantic_kind").isin("tool_call", "tool_result", "reasoning")
        | F.col("payload_type").isin(*TERMINAL_STATUS)
    )
    counted = ~_true((F.col("kind").isin("meta", "context")) | (F.col("semantic_kind") == "meta"))
    prefix = (
        events.join(starts, "session_id").filter((index < F.col("__start")) & counted)
        .groupBy("session_id")
        .agg(F.max("__start").alias("__cut"), F.max(transcript).alias("__replay"), F.count_if(is_user_message()).alias("__users"))
        .filter("__replay OR __users > 1").select("session_id", "__cut")
    )
    return events.join(prefix, "session_id", "left").filter(F.col("__cut").isNull() | (index >= F.col("__cut"))).drop("__cut")


def with_turns(events: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Events of turns with ``turn_seq`` (0-based) and ``opens``; meta records and what precedes all turns are dropped."""
    user = is_user_message()
    ptype = F.col("payload_type")
    started = _true(ptype == "task_started")
    context = _true(F.col("kind") == "context")
    implicit = _true(
        F.col("raw_type").isin("event_msg", "response_item") | ptype.isin("user_message", "turn_aborted")
        | F.col("compact_kind").isNotNull() | F.col("semantic_kind").isin("message", "tool_call", "tool_result", "diagnostic")
    )
    rows = events.filter(~_true((F.col("kind") == "meta") | (F.col("semantic_kind") == "meta")))
    first = rows.filter(started | context | implicit).groupBy("session_id").agg(F.min("event_index").alias("__zero"))
    rows = rows.join(first, "session_id").filter("event_index >= __zero")
    opening = F.col("event_index") == F.col("__zero")
    named = started | opening | (context & F.col("turn_id").isNotNull())
    block = event_block(size=block_size)
    rows = ordered_scan(
        rows, SESSION, block, ["event_index"],
        __named=last_value(F.when(named, F.struct("turn_id")), before=True),
    )
    assistant = is_assistant_message()
    semantic = F.col("semantic_kind")
    has_results, has_calls = F.col("n_results") > 0, F.col("n_calls") > 0
    answer = ~started & ~context & (
        has_results | semantic.isin("tool_call", "tool_result", "reasoning")
        | (assistant & (has_calls | F.col("has_attachments") | (normalize_text(F.col("text")) != "")))
        | (ptype.isin("task_complete", "task_failed") & F.col("last_agent_message").isNotNull())
    )
    quiet = ptype.isin(*TERMINAL_STATUS)
    item = ~started & ~context & F.when(user, F.col("has_attachments") | F.col("useful")).otherwise(~_true(quiet) & ~assistant)
    same = F.col("__named.turn_id") == F.col("turn_id")
    action = (
        F.when(started | opening, segment.OPEN)
        .when(context & F.col("turn_id").isNotNull(), F.when(_true(same), segment.SAME_TURN).otherwise(segment.OTHER_TURN))
        .when(user & F.col("turn_id").isNull(), segment.ASK).otherwise(segment.NONE)
    )
    coded = stage(rows.withColumn("code", segment.event_code(action, item, ~started & ~context & quiet, answer)).drop("__named", "__zero"))
    starts = segment.turn_starts(coded.select("session_id", "event_index", "code"), block_size).withColumn("opens", F.lit(True))
    marked = coded.join(starts, ["session_id", "event_index"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    return ordered_scan(
        stage(marked.drop("code")), SESSION, block, ["event_index"], turn_seq=running_sum(F.col("opens").cast("int"))
    ).withColumn("turn_seq", F.col("turn_seq") - 1)


def slim_events(events: DataFrame) -> DataFrame:
    """The columns of normalized events that turns and items need."""
    payload = F.col("payload")
    cleaned = clean_user_text(F.col("text"))
    return events.withColumns({
        "last_agent_message": nonempty(text_at(payload, "last_agent_message")),
        "payload_status": nonempty(text_at(payload, "status")),
        "phase": text_at(payload, "phase"),
        "payload_cwd": text_at(payload, "cwd"),
        "context": F.when(F.col("kind") == "context", F.struct(
            text_at(payload, "model").alias("model"), text_at(payload, "approval_policy").alias("approval_policy"),
            text_at(payload, "sandbox_policy.type").alias("sandbox"), text_at(payload, "timezone").alias("timezone"))),
        "context_usage": payload_context_usage(),
        "details": F.when(F.col("semantic_kind") == "tool_result", F.coalesce(
            F.to_json(F.try_variant_get("raw", "$.message.details", "variant")),
            F.to_json(F.try_variant_get("payload", "$.message.details", "variant")))),
        "user_text": F.when(is_user_message(), cleaned),
    }).select(
        "session_id", "event_index", "kind", "semantic_kind", "raw_type", "payload_type", "role", "ts_ms", "turn_id",
        "message_id", "call_id", "text", "user_text", "tool_name", "tool_input", "tool_output", "success", "tool_calls",
        "tool_results", "attachments", "reasoning", "token_usage", "compact", "is_delta", "last_agent_message",
        "payload_status", "phase", "payload_cwd", "context", "context_usage", "details",
    )


def with_flags(slim: DataFrame) -> DataFrame:
    return slim.withColumns({
        "compact_kind": F.col("compact.kind"),
        "n_results": F.coalesce(F.size("tool_results"), F.lit(0)),
        "n_calls": F.coalesce(F.size("tool_calls"), F.lit(0)),
        "has_attachments": F.coalesce(F.size("attachments"), F.lit(0)) > 0,
        "useful": _true(F.col("user_text") != "") & ~is_machine_only(F.col("user_text")),
    })


CALL_FIELDS = ("event_index", "sub", "op", "call_id", "name", "arguments", "output", "status", "text")


def _candidates(events: DataFrame) -> DataFrame:
    """One row per thing an event adds to its turn: an item, a tool call, or a tool result."""
    none = F.lit(None).cast("string")

    def part(op: str, sub, call_id=none, name=none, arguments=none, output=none, status=none, text=none) -> Column:
        return F.struct(
            F.lit(op).alias("op"), F.lit(sub).cast("int").alias("sub") if isinstance(sub, int) else sub.cast("int").alias("sub"),
            call_id.alias("item_call_id"), name.alias("item_name"), arguments.alias("item_arguments"),
            output.alias("item_output"), status.alias("item_status"), text.alias("item_text"),
        )

    verdict = lambda ok: F.when(_true(ok == False), "failed").otherwise("completed")  # noqa: E712,E731
    semantic, ptype = F.col("semantic_kind"), F.col("payload_type")
    nothing = F.slice(F.array(part("x", 0)), 1, 0)
    results = F.transform(
        F.coalesce("tool_results", F.array().cast("array<struct<call_id:string,output:string,success:boolean>>")),
        lambda r, i: part("result", i, r["call_id"], F.lit("tool"), none, r["output"], verdict(r["success"])),
    )
    calls = F.transform(
        F.coalesce("tool_calls", F.array().cast("array<struct<call_id:string,name:string,arguments:string>>")),
        lambda c, i: part("call", i + 1001, c["call_id"], F.coalesce(c["name"], F.lit("tool")), c["arguments"], none, F.lit("started")),
    )
    status = F.coalesce(F.col("payload_status"), verdict(F.col("success")))
    body = (
        F.when((semantic == "tool_result") & (F.col("n_results") > 0), nothing)
        .when(semantic == "diagnostic", F.array(part("event", 1000)))
        .when(is_user_message(), F.when(F.col("has_attachments") | F.col("useful"), F.array(part("user-message", 1000, text=F.col("user_text")))).otherwise(nothing))
        .when(is_assistant_message(), F.concat(F.array(part("assistant-message", 1000, text=F.coalesce("text", F.lit("")))), calls))
        .when(ptype == "token_count", F.array(part("token-count", 1000)))
        .when(semantic == "tool_call", F.array(part(
            "call", 1000, F.col("call_id"), F.col("tool_name"), F.col("tool_input"), none, F.coalesce("payload_status", F.lit("started")))))
        .when(semantic == "tool_result", F.array(part(
            "result", 1000, F.col("call_id"), F.col("tool_name"), none, F.col("tool_output"), status)))
        .when(ptype.isin("task_complete", "task_failed"), F.when(
            F.col("last_agent_message").isNotNull(), F.array(part("assistant-message", 1000, text=F.col("last_agent_message")))).otherwise(nothing))
        .when(ptype == "turn_aborted", nothing)
        .when(semantic == "reasoning", F.array(part(
            "reasoning", 1000, text=F.coalesce(nonempty(F.col("reasoning.summary")), F.col("text"), F.lit("")))))
        .when(F.col("compact_kind").isNotNull(), F.array(part(
            "context-compact", 1000, text=F.coalesce(F.col("compact.message"), F.col("text"), F.lit("")))))
        .when(F.col("raw_type") == "response_item", F.array(part("response-item", 1000))).otherwise(F.array(part("event", 1000)))
    )
    content = events.filter(~_true(ptype == "task_started") & ~_true(F.col("kind") == "context"))
    return content.select("*", F.inline(F.concat(results, body)))


def _keep_messages(candidates: DataFrame) -> DataFrame:
    """Without repeated assistant messages and without the cross-channel echo of a user message."""
    place = F.struct("event_index", "sub")
    said = candidates.filter("op IN ('assistant-message', 'user-message')").withColumn(
        "__text", F.md5(normalize_text(F.col("item_text")))
    )
    by_text = ["session_id", "turn_seq", "op", "__text"]
    response = F.col("raw_type") == "response_item"
    event_side = (F.col("kind") == "user_message") | (F.col("raw_type") == "event_msg")
    side = F.when(_true(response), "r").when(_true(event_side), "e")
    facts = said.groupBy(*by_text).agg(
        F.min(place).alias("__first"), F.min_by(side, F.when(side.isNotNull(), place)).alias("__side"),
    )
    ids = said.filter("op = 'user-message' AND message_id IS NOT NULL").groupBy(*by_text, "message_id").agg(F.min(place).alias("__first_id"))
    judged = said.join(facts, by_text).join(ids, [*by_text, "message_id"], "left")
    blank = normalize_text(F.col("item_text")) == ""
    assistant_kept = F.col("has_attachments") | (~blank & (place == F.col("__first")))
    echo = _true(side != F.col("__side")) | _true(place > F.col("__first_id"))
    user_kept = F.col("has_attachments") | (~blank & ~echo)
    kept = judged.filter(F.when(F.col("op") == "assistant-message", assistant_kept).otherwise(user_kept))
    others = candidates.filter("op NOT IN ('assistant-message', 'user-message')")
    return others.unionByName(kept.select(*candidates.columns))


def _pair_calls(candidates: DataFrame, block_size: int) -> DataFrame:
    """Tool-call items: calls with the merged output of their results, and results without a call."""
    ops = candidates.filter("op IN ('call', 'result')")
    keyed = ops.filter("item_call_id IS NOT NULL")
    place = F.struct("event_index", "sub")
    targeted = ordered_scan(
        keyed, ["session_id", "turn_seq", "item_call_id"], event_block(size=block_size), ["event_index", "sub"],
        __call=last_value(F.when(F.col("op") == "call", place), before=True),
    )
    results = targeted.filter("op = 'result' AND __call IS NOT NULL").select(
        "session_id", "turn_seq", F.col("__call.event_index").alias("event_index"), F.col("__call.sub").alias("sub"),
        F.struct(
            F.col("event_index").alias("i"), F.col("sub").alias("s"), F.col("item_output").alias("output"),
            F.col("item_status").alias("status"), F.col("ts_ms").alias("ts"), F.col("details").alias("details"),
        ).alias("__r"),
    )
    grouped = results.groupBy("session_id", "turn_seq", "event_index", "sub").agg(F.array_sort(F.collect_list("__r")).alias("__rs"))
    last = F.element_at("__rs", -1)
    merged = grouped.select(
        "session_id", "turn_seq", "event_index", "sub",
        F.aggregate("__rs", F.lit(None).cast("string"), lambda acc, r: merge_output(acc, r["output"])).alias("__output"),
        last["status"].alias("__status"), last["ts"].alias("completed_ms"), last["i"].alias("output_index"),
        last["details"].alias("__details"), F.lit(True).alias("__paired"),
    )
    calls = ops.filter("op = 'call'").join(merged, ["session_id", "turn_seq", "event_index", "sub"], "left")
    orphans = targeted.filter("op = 'result' AND __call IS NULL").drop("__call").unionByName(
        ops.filter("op = 'result' AND item_call_id IS NULL")
    )
    paired = calls.withColumns({
        "item_output": F.when(_true(F.col("__paired")), F.col("__output")).otherwise(F.col("item_output")),
        "item_status": F.coalesce("__status", "item_status"),
        "details": F.coalesce("__details", F.lit(None).cast("string")),
    }).drop("__output", "__status", "__paired", "__details")
    return paired.unionByName(orphans, allowMissingColumns=True).withColumn("op", F.lit("tool-call"))


@dataclass
class Assembly:
    turns: DataFrame
    items: DataFrame


def assemble(slim: DataFrame, block_size: int = EVENTS_PER_BLOCK, goals: DataFrame | None = None) -> Assembly:
    """Turns and items of all sessions. ``slim`` comes from slim_events (already coalesced or not).

    ``goals`` (session_id, event_index, goal_kind, goal_text) replaces control packets by their objective.
    """
    # Written once: every later step branches, and must not repeat the normalization expressions in its plan.
    events = drop_fork_replay(coalesce_deltas(stage(slim)))
    if goals is not None:
        events = events.join(goals, ["session_id", "event_index"], "left").filter(
            ~_true(F.col("goal_kind").isin("suppress", "suppress-state"))
        ).withColumn("user_text", F.when(F.col("goal_kind") == "objective", F.col("goal_text")).otherwise(F.col("user_text"))).drop(
            "goal_kind", "goal_text")
    staged = stage(with_turns(with_flags(events), block_size))
    candidates = _candidates(staged)
    tools = _pair_calls(candidates, block_size)
    rest = _keep_messages(candidates.filter("op NOT IN ('call', 'result')"))
    kept = rest.unionByName(tools, allowMissingColumns=True)
    items = ordered_scan(
        stage(kept), TURN, event_block(size=block_size), ["event_index", "sub"], item_index=running_sum(F.lit(1), before=True)
    ).select(
        "session_id", "turn_seq", "item_index", F.col("op").alias("type"), F.col("event_index").alias("source_index"), "output_index",
        "ts_ms", "completed_ms", F.col("item_text").alias("text"), F.col("item_name").alias("name"),
        F.when(F.col("op") == "tool-call", F.coalesce("item_call_id", F.concat(F.lit("item-"), F.col("item_index").cast("string")))).alias("call_id"),
        F.col("item_status").alias("status"), F.col("item_arguments").alias("arguments"), F.col("item_output").alias("output"),
        F.when(F.col("op").isin("user-message", "assistant-message"), F.col("message_id")).alias("message_id"),
        F.when(F.col("payload_type").isin("task_complete", "task_failed"), "final").otherwise(F.col("phase")).alias("phase"),
        F.when(F.col("op").isin("assistant-message", "token-count"), F.col("token_usage")).alias("token_usage"),
        F.when(F.col("op").isin("assistant-message", "reasoning"), F.col("reasoning")).alias("reasoning"),
        F.when(F.col("op") == "context-compact", F.col("compact")).alias("compact"), "context_usage", "details",
        "kind", "raw_type", "payload_type", "attachments",
    )
    items = stage(items)
    return _finish(staged, items, block_size)


def _finish(events: DataFrame, items: DataFrame, block_size: int) -> Assembly:
    ends = F.col("payload_type").isin(*TERMINAL_STATUS)
    status = F.create_map(*[F.lit(x) for pair in TERMINAL_STATUS.items() for x in pair])
    index = F.col("event_index")
    is_context = _true(F.col("kind") == "context")
    facts = events.groupBy(*TURN).agg(
        F.min_by(F.when(F.col("payload_type") == "task_started", F.col("turn_id")).otherwise(F.col("turn_id")), index).alias("turn_id"),
        F.min("event_index").alias("first_index"),
        F.min_by("ts_ms", index).alias("started_ms"),
        F.max_by(F.element_at(status, F.col("payload_type")), F.when(ends, index)).alias("ended_as"),
        F.max_by("ts_ms", F.when(ends, index)).alias("completed_ms"),
        F.max_by("context", F.when(is_context, index)).alias("context"),
        F.coalesce(
            F.max_by("payload_cwd", F.when(is_context & F.col("payload_cwd").isNotNull(), index)),
            F.min_by(F.when(_true(F.col("payload_type") == "task_started"), None).otherwise(F.col("payload_cwd")), index),
        ).alias("cwd"),
        F.max("ts_ms").alias("last_event_ms"),
    )
    waiting = (F.col("type") == "tool-call") & F.col("name").isin(*WAIT_CALLS) & F.col("output").isNull() & ~F.col("status").isin("completed", "failed")
    spoken = ~F.col("type").isin("reasoning", "token-count")
    by_items = items.groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max(_true(waiting)).alias("waits"),
        F.max_by("type", F.when(spoken, F.col("item_index"))).alias("last_type"),
        F.count_if(F.col("type") != "user-message").alias("n_other"),
        F.min_by(normalize_text(F.col("text")), F.when(F.col("type") == "user-message", F.col("item_index"))).alias("first_user"),
    )
    turns = facts.join(by_items, TURN, "left")
    turns = ordered_scan(
        stage(turns), SESSION, F.floor(F.col("turn_seq") / block_size), ["turn_seq"], __next_user=following_row(F.col("first_user"))
    )
    resumed = (F.col("ended_as") == "aborted") & (F.coalesce("n_other", F.lit(0)) == 0) & F.col("__next_user").isNotNull()
    turns = stage(turns.withColumn("__drop", F.when(_true(resumed), F.col("__next_user"))))
    drops = turns.filter("__drop IS NOT NULL").select(*TURN, "__drop")
    trimmed = items.join(drops, TURN, "left").filter(~_true(normalize_text(F.col("text")) == F.col("__drop"))).drop("__drop")
    left = trimmed.join(drops.select(*TURN), TURN, "left_semi").groupBy(*TURN).agg(F.count(F.lit(1)).alias("__left"))
    counted = turns.join(left, TURN, "left").withColumn(
        "n_items", F.when(F.col("__drop").isNotNull(), F.coalesce("__left", F.lit(0))).otherwise(F.coalesce("n_items", F.lit(0)))
    )
    kept = counted.filter((F.col("n_items") > 0) | F.col("context").isNotNull() | _true(F.col("ended_as") == "aborted"))
    inferred = F.when(_true(F.col("waits")) | _true(F.col("last_type") == "assistant-message"), "waiting").otherwise("running")
    numbered = ordered_scan(
        stage(kept), SESSION, F.floor(F.col("turn_seq") / block_size), ["turn_seq"], turn_index=running_sum(F.lit(1), before=True)
    ).select(
        "session_id", "turn_seq", "turn_index",
        F.coalesce("turn_id", F.concat(F.lit("turn-"), (F.col("turn_seq") + 1).cast("string"))).alias("turn_id"), "first_index",
        "started_ms", "completed_ms", F.coalesce("ended_as", inferred).alias("status"), "cwd", "context", "n_items", "last_event_ms",
    )
    numbered = stage(numbered)
    indexed = trimmed.join(numbered.select(*TURN, "turn_index"), TURN)
    # Dropping resumed prompts leaves gaps only in turns that keep nothing else, so item indexes stay dense.
    return Assembly(numbered.drop("turn_seq"), stage(indexed.drop("turn_seq")))


def session_status(turns: DataFrame, files: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
    """Status of the last turn; 'running' without a write for half an hour is 'stopped'."""
    last = turns.groupBy("session_id").agg(F.max_by("status", "turn_index").alias("status"))
    if files is None or now_ms is None:
        return last
    stale = (F.col("status") == "running") & (F.lit(now_ms) - F.col("mtime_ms") >= STALE_RUNNING_MS)
    return last.join(files.select("session_id", "mtime_ms"), "session_id", "left").select(
        "session_id", F.when(_true(stale), "stopped").otherwise(F.col("status")).alias("status")
    )


def tail_status(records: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Status of each session from the records of its log's tail; sessions whose tail has no usable record have no row.

    A session's status is how its last turn ends, so the tail tells it without the rest of the log.
    """
    from seslog.operators.normalize import normalize

    usable = records.filter("is_valid")
    built = assemble(slim_events(stage(normalize(usable))))
    return session_status(built.turns, usable.groupBy("session_id").agg(F.max("mtime_ms").alias("mtime_ms")), now_ms)
