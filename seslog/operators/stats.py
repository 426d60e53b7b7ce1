"""Diagnostic statistics over events and tool calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.text import char_tokens, joined_text, normalize_text, slashes, strip_long_path_prefix, trim_space
from seslog.operators.timing import half_up

ERROR_WORDS = "(?i)error|failed|失败|错误"
TERMINAL_ERROR = "(?i)error|failed|failure|stderr|失败|错误"
TEXT_FIELDS = ("title", "preview", "kind", "raw_type", "payload_type")

# Which event kinds are tool outputs.
OUTPUT_KINDS = ("function_call_output", "custom_tool_call_output", "mcp_tool_call_end", "tool_search_output")


def event_counts(events: DataFrame) -> DataFrame:
    """Events per session by kind and by role, long form."""
    pairs = F.array(F.struct(F.lit("kind").alias("by"), F.col("kind").alias("value")), F.struct(F.lit("role").alias("by"), F.col("role").alias("value")))
    return events.select("session_id", F.inline(pairs)).filter("value IS NOT NULL").groupBy("session_id", "by", "value").agg(F.count(F.lit(1)).alias("n"))


def detail_stats(events: DataFrame, turns: DataFrame, children: DataFrame) -> DataFrame:
    """Counts shown with a session: events, bad lines, compactions, important events, turns, children, size."""
    base = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("semantic_kind") == "diagnostic").alias("bad_lines"),
        F.count_if(F.col("compact_kind").isNotNull()).alias("compactions"), F.count_if("important").alias("important"),
        F.sum("raw_size").alias("size"))
    n_turns = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    n_children = children.groupBy(F.col("parent_id").alias("session_id")).agg(F.count(F.lit(1)).alias("children"))
    return base.join(n_turns, "session_id", "left").join(n_children, "session_id", "left").fillna(0, ["turns", "children"])


def estimate_tokens(columns: Sequence[str]) -> Column:
    """Explicit tokens, else a quarter of the record size, else a quarter of its visible text."""
    size = F.coalesce(F.nullif(F.col("raw_size"), F.lit(0)), F.nullif(F.col("payload_size"), F.lit(0))) if "payload_size" in columns else F.nullif(F.col("raw_size"), F.lit(0))
    text = joined_text(*[F.col(c) for c in TEXT_FIELDS if c in columns])
    explicit = F.when(F.col("tokens").isNotNull(), F.greatest(F.lit(0), half_up(F.col("tokens")))) if "tokens" in columns else F.lit(None)
    return F.coalesce(explicit, F.when(size > 0, F.greatest(F.lit(1), F.ceil(size / 4))), char_tokens(text)).cast("long")


def estimate_bytes(columns: Sequence[str]) -> Column:
    text = joined_text(*[F.col(c) for c in TEXT_FIELDS if c in columns])
    return F.coalesce(F.nullif(F.col("raw_size"), F.lit(0)), F.length(text)).cast("long")


def event_statistics(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, estimated tokens and bytes per event kind, most frequent first."""
    return events.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(estimate_tokens(events.columns)).alias("approx_tokens"),
        F.sum(estimate_bytes(events.columns)).alias("approx_bytes"),
    ).orderBy(*keys, F.col("n").desc(), F.col("approx_tokens").desc(), "kind")


def with_share(statistics: DataFrame) -> DataFrame:
    """Share of all events and average tokens, one decimal; the input has one row per kind."""
    total = statistics.agg(F.sum("n").alias("__total")).withColumn("__k", F.lit(1))
    return statistics.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").select(  # one row
        *statistics.columns, half_up(F.col("n") / F.col("__total") * 100, 1).alias("share_percent"),
        half_up(F.col("approx_tokens") / F.col("n"), 1).alias("average_tokens"))


def _known_rule() -> Column:
    """Marks groups of matched calls. A filter on rule_id itself would be pushed below the projection that computes it
    and evaluate every rule a second time."""
    return F.max(F.col("rule_id").isNotNull()).alias("__known")


def operation_breakdown(outputs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tool outputs per kind and matched rule."""
    grouped = outputs.filter(F.col("kind").isin(*OUTPUT_KINDS)).groupBy(*keys, "kind", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("approx_tokens").alias("approx_tokens"), F.sum("approx_bytes").alias("approx_bytes"), _known_rule())
    return grouped.filter("__known").drop("__known")


def tool_context_statistics(calls: DataFrame, window: Column, keys: Sequence[str] = (), text: str | None = None) -> DataFrame:
    """Per (rule, target): calls, argument and output bytes, context tokens, largest output, share of the window.

    ``calls`` has rule_id, rule_title, target, arguments, output, event_index, ord. Of equally large outputs the last
    one is the primary.
    """
    output, arguments = F.coalesce("output", F.lit("")), F.coalesce("arguments", F.lit(""))
    rows = calls
    if text:
        rows = rows.filter(F.lower(F.concat_ws("\n", "rule_title", "target", output)).contains(text.strip().lower()))
    size = F.octet_length(output)
    out_tokens = char_tokens(output)
    grouped = rows.groupBy(*keys, "rule_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(arguments)).alias("argument_bytes"), F.sum(size).alias("output_bytes"),
        F.sum(char_tokens(arguments) + out_tokens).alias("context_tokens"), F.max(size).alias("max_output_bytes"),
        F.max(out_tokens).alias("max_output_tokens"), F.max_by("event_index", F.struct(size, F.col("ord"))).alias("primary_event"),
        F.count_distinct("event_index").alias("n_events"), _known_rule()).filter("__known").drop("__known")
    share = lambda c: F.when(window > 0, F.col(c) / window * 100)
    return grouped.withColumns({"window_share": share("context_tokens"), "max_output_share": share("max_output_tokens")})


TOOL_SORTS = {
    "context-share": lambda: F.coalesce("window_share", F.lit(-1)).desc(), "max-output": lambda: F.col("max_output_bytes").desc(),
    "target": lambda: F.col("target").asc(), "output-bytes": lambda: F.col("output_bytes").desc(),
}


def sort_tool_statistics(statistics: DataFrame, sort: str) -> DataFrame:
    first = TOOL_SORTS.get(sort, TOOL_SORTS["output-bytes"])()
    return statistics.orderBy(first, F.col("context_tokens").desc(), F.col("target").asc(), F.col("rule_id").asc())


def latest_window(rows: DataFrame, order: Column) -> DataFrame:
    """Latest positive context window of each session, 0 where there is none."""
    latest = F.max_by("window", F.when(F.col("window") > 0, order))
    return rows.groupBy("session_id").agg(F.coalesce(latest, F.lit(0)).alias("context_window"))


def error_counts(events: DataFrame, items: DataFrame) -> DataFrame:
    """The larger of the numbers of events and of items that mention an error."""
    count = lambda df, name: df.groupBy("session_id").agg(F.count_if(F.col("text").rlike(ERROR_WORDS)).alias(name))
    joined = count(events, "__e").join(count(items, "__i"), "session_id", "left")
    return joined.select("session_id", F.greatest("__e", F.coalesce("__i", F.lit(0))).alias("errors"))


def directory_tree(sessions: DataFrame) -> DataFrame:
    """Sessions and latest time below every directory of their working directories; those without one under 'none'."""
    raw = slashes(strip_long_path_prefix(trim_space(F.coalesce("cwd", F.lit("")))))
    parts = F.filter(F.split(raw, "/"), lambda p: p != "")
    head = F.when(raw.startswith("/"), "/").otherwise("")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda n: F.concat(F.col("__head"), F.array_join(F.slice("__parts", 1, n), "/")))
    paths = F.when(F.size("__parts") > 0, prefixes).otherwise(F.array(F.lit("__projectless__")))
    rows = sessions.select("changed_ms", parts.alias("__parts"), head.alias("__head"))
    return rows.select("changed_ms", F.explode(paths).alias("path")).groupBy("path").agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.greatest(F.max("changed_ms"), F.lit(0)), F.lit(0)).alias("latest_ms"))


def terminal_blocks(items: DataFrame) -> DataFrame:
    """Blocks of the terminal view: a tool call with output gives two, its output is an error block if it reads so."""
    kind, status = F.col("type"), F.coalesce("status", F.lit(""))
    error = F.concat_ws("\n", status, F.coalesce("phase", F.lit("")), F.coalesce("output", F.lit(""))).rlike(TERMINAL_ERROR)
    role = (
        F.when(kind == "user-message", "user").when(kind == "assistant-message", "assistant")
        .when(kind.isin("tool-call", "response-item"), F.when(error, "error").otherwise("tool")).otherwise("meta"))
    block = lambda part, r: F.struct(F.lit(part).alias("part"), r.alias("role"))
    both = F.array(block("call", F.lit("tool")), block("output", F.when(error, "error").otherwise("output")))
    rows = items.filter((kind == "token-count") | (F.coalesce("text", F.lit("")) != "") | ~kind.isin("user-message", "assistant-message"))
    return rows.select(
        "session_id", "turn_index", "item_index",
        F.inline(F.when((kind == "tool-call") & F.col("output").isNotNull(), both).otherwise(F.array(block("item", role)))))


def terminal_role_counts(blocks: DataFrame) -> DataFrame:
    role = F.col("role")
    return blocks.groupBy("session_id").agg(
        F.count_if(role == "user").alias("user"), F.count_if(role == "assistant").alias("assistant"),
        F.count_if(role.isin("tool", "output")).alias("tool"), F.count_if(role == "error").alias("error"))


def turn_bar_scale(turns: DataFrame) -> DataFrame:
    """Bar length of each turn relative to the longest turn of its session, 1..100."""
    scale = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).when(F.col("active_ms") > 0, F.col("active_ms")).otherwise(0)
    longest = turns.groupBy("session_id").agg(F.max(scale).alias("__max"))
    bar = F.greatest(F.lit(1.0), F.least(F.lit(100.0), half_up(scale / F.col("__max") * 100, 1)))
    return turns.join(longest, "session_id").select(
        "session_id", "turn_index", F.when(F.col("__max") > 0, bar).otherwise(100.0).alias("bar_percent"))


def timeline(turns: DataFrame, block_size: int, group: int = 5, plain_limit: int = 24) -> DataFrame:
    """Timeline entries: with more than 24 turns, runs of plain turns are grouped by up to five.

    ``turns``: session_id, turn_index, duration_ms, signal (has a compaction or sub-agents). The weight of an entry is
    its duration (the mean where unknown), but at least 8 % of the mean.
    """
    from seslog.functions.ordered import event_block, last_value, ordered_scan

    size = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = ordered_scan(
        turns, ["session_id"], event_block("turn_index", block_size), ["turn_index"],
        __signal=last_value(F.when(F.col("signal"), F.col("turn_index"))),
    ).join(size, "session_id")
    run_start = F.coalesce(F.col("__signal") + 1, F.lit(0))
    grouped = (F.col("__n") > plain_limit) & ~F.col("signal")
    first = F.when(grouped, run_start + F.floor((F.col("turn_index") - run_start) / group) * group).otherwise(F.col("turn_index"))
    entries = rows.groupBy("session_id", first.alias("start_turn")).agg(
        F.max("turn_index").alias("end_turn"), F.nullif(F.sum(F.coalesce("duration_ms", F.lit(0))), F.lit(0)).alias("duration_ms"))
    mean = entries.filter("duration_ms > 0").groupBy("session_id").agg(F.avg("duration_ms").alias("__mean"))
    fallback = F.coalesce("__mean", F.lit(1.0))
    weight = F.greatest(F.lit(1.0), fallback * 0.08, F.coalesce("duration_ms", fallback))
    return entries.join(mean, "session_id", "left").select("session_id", "start_turn", "end_turn", "duration_ms", weight.alias("weight"))


def hand_off(items: DataFrame, turns: DataFrame, children: DataFrame) -> DataFrame:
    """Facts for handing a session on: first request, status, last answer, tool calls, turns, children."""
    place = F.struct("turn_index", "item_index")
    said = lambda kind: F.when((F.col("type") == kind) & (normalize_text(F.col("text")) != ""), place)
    facts = items.groupBy("session_id").agg(
        F.min_by("text", said("user-message")).alias("goal"), F.max_by("text", said("assistant-message")).alias("last_answer"),
        F.count_if(F.col("type") == "tool-call").alias("tool_calls"))
    state = turns.groupBy("session_id").agg(F.max_by("status", "turn_index").alias("status"), F.count(F.lit(1)).alias("turns"))
    kids = children.groupBy(F.col("parent_id").alias("session_id")).agg(F.count(F.lit(1)).alias("children"))
    return state.join(facts, "session_id", "left").join(kids, "session_id", "left").fillna(0, ["children", "tool_calls"])


def latest_usage_total(items: DataFrame) -> DataFrame:
    """Total tokens of the last token record of each session."""
    place = F.when(F.col("type") == "token-count", F.struct("turn_index", "item_index"))
    return items.groupBy("session_id").agg(F.max_by("total_tokens", place).alias("total_tokens"))


def outcome_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


