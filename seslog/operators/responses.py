"""Response intervals, input waits, turn ends and context changes, from items and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import (
    DAY_MS, EVENTS_PER_BLOCK, event_block, following_row, last_value, next_value, ordered_scan, previous_row, running_max, running_sum,
)
from seslog.functions.staging import stage
from seslog.functions.text import byte_tokens, joined_text
from seslog.operators.intervals import complete, covered_time
from seslog.operators.timejoin import sum_within
from seslog.operators.timing import half_up

TURN = ["session_id", "turn_index"]
SPOKEN = ("reasoning", "assistant-message")


def inferred_responses(items: DataFrame, turns: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Reasoning and assistant items from the previous boundary (end or time of the item before) to their time."""
    joined = items.join(turns.select(*TURN, F.col("started_ms").alias("__turn_start")), TURN)
    boundary = F.when(F.col("type").isin(*SPOKEN), F.col("ts_ms")).otherwise(F.coalesce("completed_ms", "ts_ms"))
    rows = ordered_scan(
        joined, TURN, event_block("item_index", block_size), ["item_index"], __before=last_value(boundary, before=True)
    )
    start = F.coalesce("__before", "__turn_start")
    return rows.filter(F.col("type").isin(*SPOKEN) & (F.col("ts_ms") > start)).select(
        *TURN, "item_index", F.col("source_index").alias("event_index"), F.col("type").alias("response_type"),
        start.alias("start_ms"), F.col("ts_ms").alias("end_ms"),
    )


def measured_responses(items: DataFrame, turns: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Token usage attributed to the response that ended at the last generated item before it.

    Generated items (reasoning, assistant messages, tool calls) form a response until usage closes it; a user message
    discards an open one. A response starts at the latest of: the last user message (or the turn start), the end of
    a tool call of an earlier response, the end of an earlier closed response.
    """
    ts, kind = F.col("ts_ms"), F.col("type")
    user = kind == "user-message"
    spoken = kind.isin(*SPOKEN) & ts.isNotNull()
    generated = spoken | ((kind == "tool-call") & ts.isNotNull())
    closes = F.col("token_usage").isNotNull() & ((kind == "token-count") | (spoken & (kind == "assistant-message")))
    block = event_block("item_index", block_size)
    numbered = ordered_scan(
        items, TURN, block, ["item_index"],
        response=running_sum(F.when(user | closes, 1).otherwise(0), before=True),
        epoch=running_sum(F.when(user & ts.isNotNull(), 1).otherwise(0)),
        user_ms=last_value(F.when(user, ts)),
    )
    closer = F.struct(
        "item_index", F.col("source_index").alias("event_index"), kind.alias("response_type"), "token_usage", "context_usage")
    parts = stage(numbered.filter(~user).groupBy(*TURN, "epoch", "response").agg(
        F.max("user_ms").alias("user_ms"),
        F.max(F.when(generated, ts)).alias("end_ms"),
        F.max(F.when(kind == "tool-call", F.col("completed_ms"))).alias("done_ms"),
        F.min_by(closer, F.when(closes, F.col("item_index"))).alias("closer"),
    ))
    reached = F.greatest(F.col("done_ms"), F.when(F.col("closer").isNotNull(), F.col("end_ms")))
    bounded = ordered_scan(
        parts, [*TURN, "epoch"], event_block("response", block_size), ["response"], __reached=running_max(reached, before=True)
    ).join(turns.select(*TURN, F.col("started_ms").alias("__turn_start"), F.col("context.model").alias("model")), TURN)
    start = F.greatest(F.coalesce("user_ms", "__turn_start"), F.col("__reached"))
    rows = bounded.filter(F.col("closer").isNotNull() & (F.col("end_ms") > start)).select(
        *TURN, start.alias("start_ms"), "end_ms", "closer.*", "model"
    )
    return rows.select(
        *TURN, "item_index", "event_index", "response_type", "start_ms", "end_ms", "model",
        F.col("token_usage.output_tokens").alias("output_tokens"),
        F.coalesce("token_usage.reasoning_tokens", F.lit(0)).alias("reasoning_tokens"),
        F.col("token_usage.generated_tokens").alias("usage_tokens"), F.col("token_usage.input_tokens").alias("input_tokens"),
        F.col("token_usage.cache_read_tokens").alias("cache_read_tokens"),
        F.col("token_usage.cache_write_tokens").alias("cache_write_tokens"),
        F.col("token_usage.total_tokens").alias("total_tokens"), F.col("token_usage.cost").alias("cost"),
    )


def tool_call_tokens(name: Column, arguments: Column) -> Column:
    return byte_tokens(joined_text(name, arguments))


def with_tool_call_tokens(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Adds the estimated tokens of the tool calls issued inside each response."""
    points = items.filter("type = 'tool-call' AND ts_ms IS NOT NULL").select(
        *TURN, F.col("ts_ms").alias("t"), F.coalesce(tool_call_tokens(F.col("name"), F.col("arguments")), F.lit(0)).alias("weight")
    )
    totals = sum_within(responses.select(*TURN, F.col("item_index").alias("id"), "start_ms", "end_ms"), points, TURN)
    named = totals.select(*TURN, F.col("id").alias("item_index"), F.col("total").alias("tool_call_tokens"))
    return responses.join(named, [*TURN, "item_index"], "left").withColumn(
        "generated_tokens", F.col("usage_tokens") + F.coalesce("tool_call_tokens", F.lit(0))
    )


def measured_else_inferred(measured: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred responses only for turns without a measured one."""
    rest = inferred.join(measured.select(*TURN).distinct(), TURN, "left_anti")
    return measured.withColumn("measured", F.lit(True)).unionByName(rest.withColumn("measured", F.lit(False)), allowMissingColumns=True)


def input_waits(turn_edges: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """From the last assistant message of a turn to the first user message of the next, where positive.

    ``turn_edges``: one row per turn with last_assistant_ms and first_user_ms.
    """
    rows = ordered_scan(
        turn_edges, ["session_id"], event_block("turn_index", block_size), ["turn_index"],
        end_ms=following_row(F.col("first_user_ms")),
    )
    return rows.filter("end_ms > last_assistant_ms").select(
        "session_id", "turn_index", F.col("last_assistant_ms").alias("start_ms"), "end_ms",
        (F.col("end_ms") - F.col("last_assistant_ms")).alias("duration_ms"),
    )


def turn_edges(items: DataFrame) -> DataFrame:
    place = F.when(F.col("ts_ms").isNotNull(), F.col("item_index"))
    return items.groupBy(*TURN).agg(
        F.max_by("ts_ms", F.when(F.col("type") == "assistant-message", place)).alias("last_assistant_ms"),
        F.min_by("ts_ms", F.when(F.col("type") == "user-message", place)).alias("first_user_ms"),
    )


def turn_ends(turns: DataFrame, items: DataFrame) -> DataFrame:
    """Completion time of each turn, or the time of its latest item as a lower bound."""
    latest = items.groupBy(*TURN).agg(F.max(F.coalesce("completed_ms", "ts_ms")).alias("__latest"))
    return turns.join(latest, TURN, "left").withColumns({
        "end_ms": F.coalesce("completed_ms", "__latest"), "turn_estimated": F.col("completed_ms").isNull(),
    }).drop("__latest")


def session_bounds(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Start and end of each session from its turns and events, and its wall time."""
    first = turns.groupBy("session_id").agg(
        F.min_by("started_ms", "turn_index").alias("__turn_start"), F.max_by("completed_ms", "turn_index").alias("__turn_end"))
    edge = events.groupBy("session_id").agg(F.min_by("ts_ms", "event_index").alias("__first"), F.max_by("ts_ms", "event_index").alias("__last"))
    start, end = F.coalesce("__turn_start", "__first"), F.greatest("__turn_end", "__last")
    return edge.join(first, "session_id", "left").select(
        "session_id", start.alias("start_ms"), end.alias("end_ms"), F.when(end >= start, end - start).alias("wall_ms")
    )


def session_times(bounds: DataFrame, intervals: DataFrame, waits: DataFrame, width_ms: int = DAY_MS) -> DataFrame:
    """bounds with active_ms, the time covered by its intervals, and waiting_ms, that covered by its waits for input; 0 where there is none.

    intervals and waits: session_id, start_ms, end_ms; those without both bounds, or that end before they start, do not count.
    """
    covered = lambda rows, name: covered_time(complete(rows), ["session_id"], width_ms).select("session_id", F.col("covered_ms").alias(name))
    rows = bounds.join(covered(intervals, "active_ms"), "session_id", "left").join(covered(waits, "waiting_ms"), "session_id", "left")
    return rows.fillna(0, ["active_ms", "waiting_ms"])


def context_changes(snapshots: DataFrame, block: Column, order: list[str], percent: str = "percent") -> DataFrame:
    """Change against the snapshot before, one decimal, rounded half up."""
    rows = ordered_scan(snapshots, ["session_id"], block, order, __previous=previous_row(F.col(percent)))
    return rows.withColumn("delta_percent", half_up(F.col(percent) - F.col("__previous"), 1)).drop("__previous")


def execution_context_changes(responses: DataFrame, block: Column, order: list[str]) -> DataFrame:
    """Change against the response directly before, only if that one had a usable baseline (used and limit > 0)."""
    usable = F.col("used").isNotNull() & (F.col("context_limit") > 0)
    rows = ordered_scan(responses, ["session_id"], block, order, __base=previous_row(F.when(usable, F.col("percent"))))
    return rows.withColumn("change_percent", half_up(F.col("percent") - F.col("__base"), 1)).drop("__base")


def context_for_assistant(rows: DataFrame, keys: list[str], block: Column, order: list[str]) -> DataFrame:
    """Context of each assistant message: the first token record before the next assistant message, else the last earlier one.

    ``rows`` has ``type`` and ``usage`` (non-null only on usable token records).
    """
    assistant = F.col("type") == "assistant-message"
    scanned = ordered_scan(
        rows, keys, block, order,
        __next=next_value(F.when(assistant | F.col("usage").isNotNull(), F.struct(assistant.alias("a"), F.col("usage").alias("u")))),
        __last=last_value(F.col("usage"), before=True),
    )
    # A usable token record that comes before the next assistant message is the very next marker.
    after = F.when(~F.col("__next.a"), F.col("__next.u"))
    return scanned.filter(assistant).withColumn("context", F.coalesce(after, "__last")).drop("__next", "__last")


def steps(intervals: DataFrame, id_column: str, contexts: DataFrame | None = None) -> DataFrame:
    """Intervals in event order, those without an event last.

    contexts (session_id, id_column, event_index, percent, delta_percent, snap_ms) gives the context of the waits for a model; other
    steps have none.
    """
    rows = intervals.withColumn("result_kind", F.when(F.col("tokens").isNotNull(), "recorded"))
    if contexts is not None:
        cells = ("percent", "delta_percent", "snap_ms")
        found = contexts.select("session_id", id_column, "event_index", F.struct(*cells).alias("__c"))
        waits = F.col("bucket") == "llm_wait"
        rows = rows.join(found, ["session_id", id_column, "event_index"], "left").withColumns({c: F.when(waits, F.col(f"__c.{c}")) for c in cells}).drop("__c")
        rows = rows.withColumn("context_source", F.when(F.col("percent").isNotNull(), "recorded"))
    return rows.orderBy("session_id", F.col("event_index").asc_nulls_last(), id_column)
