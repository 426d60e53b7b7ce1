"""Queries over the timed event view and the time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seslog.functions.ordered import DAY_MS, event_block, last_value, ordered_scan, running_sum, with_position
from seslog.functions.staging import stage
from seslog.operators import responses as rs
from seslog.operators import timejoin as tj
from seslog.operators.stats import event_counts, error_counts, event_statistics, latest_window, with_share
from seslog.plans.registry import query
from seslog.plans.views import (
    EVT_EVENTS_SQL, EVT_ORDER, TOOL_INTERVALS_SQL, TOOL_WIDTH_MS, evt_block, evt_events, evt_rows, millis, table,
    tool_intervals, with_ctes,
)

WIDE = 32 * DAY_MS
HOUR = 3_600_000


# Turns of the timed events: a sign-up opens one, everything up to the next sign-up belongs to it.
EVT_TURNS_SQL = EVT_EVENTS_SQL + """,
evt_turned AS (SELECT *, sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END)
   OVER (PARTITION BY session_id ORDER BY event_index ROWS UNBOUNDED PRECEDING) - 1 AS turn_index FROM evt_events),
evt_turns AS (SELECT session_id, CAST(turn_index AS BIGINT) AS turn_index, min(ts_ms) AS started_ms,
   arg_max(ts_ms, event_index) FILTER (kind = 'task_failed') AS completed_ms, max(ts_ms) AS latest_ms,
   arg_max(ts_ms, event_index) FILTER (kind = 'agent_message') AS last_assistant_ms,
   arg_min(ts_ms, event_index) FILTER (kind = 'user_message') AS first_user_ms
   FROM evt_turned WHERE turn_index >= 0 GROUP BY ALL)"""


def evt_turned(spark, sf):
    rows = evt_rows(spark, sf)
    return ordered_scan(
        rows, ["session_id"], evt_block(), EVT_ORDER,
        turn_index=running_sum(F.when(F.col("kind") == "user_message", 1).otherwise(0).cast("long")),
        event_index=running_sum(F.lit(1).cast("long"), before=True),
    ).withColumn("turn_index", F.col("turn_index") - 1)


def evt_turns(turned):
    index = F.col("event_index")
    at = lambda kind: F.when(F.col("kind") == kind, index)
    return turned.filter("turn_index >= 0").groupBy("session_id", "turn_index").agg(
        F.min("ts_ms").alias("started_ms"), F.max_by("ts_ms", at("task_failed")).alias("completed_ms"),
        F.max("ts_ms").alias("latest_ms"), F.max_by("ts_ms", at("agent_message")).alias("last_assistant_ms"),
        F.min_by("ts_ms", at("user_message")).alias("first_user_ms"),
    )


@query("f8_input_waits", with_ctes(EVT_TURNS_SQL, """w AS (SELECT session_id, turn_index, last_assistant_ms AS start_ms,
  lead(first_user_ms) OVER (PARTITION BY session_id ORDER BY turn_index) AS end_ms FROM evt_turns)""",
  "SELECT session_id, turn_index, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM w WHERE end_ms > start_ms"))
def f8(spark, sf):
    return rs.input_waits(evt_turns(evt_turned(spark, sf)))


@query("f11_turn_end_lower_bound", with_ctes(EVT_TURNS_SQL, """SELECT session_id, turn_index,
  coalesce(completed_ms, latest_ms) AS end_ms, completed_ms IS NULL AS turn_estimated FROM evt_turns"""))
def f11(spark, sf):
    turned = evt_turned(spark, sf)
    items = turned.filter("turn_index >= 0").withColumn("completed_ms", F.lit(None).cast("long"))
    return rs.turn_ends(evt_turns(turned), items).select("session_id", "turn_index", "end_ms", "turn_estimated")


@query("f12_session_bounds", with_ctes(EVT_TURNS_SQL, """e AS (SELECT session_id, min(ts_ms) AS f, max(ts_ms) AS l FROM evt_events GROUP BY 1)""",
  """t AS (SELECT session_id, arg_min(started_ms, turn_index) AS s FROM evt_turns GROUP BY 1)""",
  """SELECT session_id, coalesce(s, f) AS start_ms, l AS end_ms, l - coalesce(s, f) AS wall_ms FROM e LEFT JOIN t USING (session_id)"""))
def f12(spark, sf):
    turned = evt_turned(spark, sf)
    return rs.session_bounds(evt_turns(turned), turned)


SNAP_SQL = """snap AS (SELECT session_id, event_index, ts_ms, percent FROM evt_events WHERE kind = 'token_count')"""


@query("f13_context_snapshots", with_ctes(EVT_EVENTS_SQL, SNAP_SQL, """SELECT session_id, event_index, percent,
  floor((CAST(percent AS DOUBLE) - lag(percent) OVER (PARTITION BY session_id ORDER BY ts_ms, event_index)) * 10 + 0.5) / 10 AS delta_percent
  FROM snap"""))
def f13(spark, sf):
    snaps = evt_events(spark, sf).filter("kind = 'token_count'").select("session_id", "event_index", "ts_ms", F.col("percent").cast("double").alias("percent"))
    distinct = snaps.dropDuplicates(["session_id", "ts_ms", "event_index", "percent"])
    return rs.context_changes(distinct, evt_block(), ["ts_ms", "event_index"]).select("session_id", "event_index", "percent", "delta_percent")


@query("f14_execution_context_change", with_ctes(EVT_EVENTS_SQL, SNAP_SQL.replace("percent FROM", "percent, value FROM"),
  """p AS (SELECT *, lag(CASE WHEN value >= 5 THEN percent END) OVER (PARTITION BY session_id ORDER BY ts_ms, event_index) AS base FROM snap)""",
  "SELECT session_id, event_index, floor((CAST(percent AS DOUBLE) - base) * 10 + 0.5) / 10 AS change_percent FROM p"))
def f14(spark, sf):
    rows = evt_events(spark, sf).filter("kind = 'token_count'").select(
        "session_id", "event_index", "ts_ms", F.col("percent").cast("double").alias("percent"),
        F.when(F.col("value") >= 5, F.col("value")).alias("used"), F.lit(100).alias("context_limit"),
    )
    return rs.execution_context_changes(rows, evt_block(), ["ts_ms", "event_index"]).select("session_id", "event_index", "change_percent")


@query("f16_context_of_assistant_message", with_ctes(EVT_EVENTS_SQL, """
 m AS (SELECT *, min(CASE WHEN kind = 'agent_message' THEN event_index END) OVER w AS next_a,
   min(CASE WHEN kind = 'token_count' AND percent > 10 THEN event_index END) OVER w AS next_c,
   max(CASE WHEN kind = 'token_count' AND percent > 10 THEN event_index END)
     OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_c
   FROM evt_events WINDOW w AS (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
 """SELECT m.session_id, m.event_index, c.percent AS context_percent FROM m LEFT JOIN evt_events c ON c.session_id = m.session_id
   AND c.event_index = CASE WHEN next_c IS NOT NULL AND (next_a IS NULL OR next_c < next_a) THEN next_c ELSE last_c END
   WHERE m.kind = 'agent_message'"""))
def f16(spark, sf):
    usage = F.when((F.col("kind") == "token_count") & (F.col("percent") > 10), F.struct("percent"))
    rows = evt_events(spark, sf).select(
        "session_id", "event_index", "ts_ms", F.when(F.col("kind") == "agent_message", "assistant-message").otherwise("other").alias("type"), usage.alias("usage"))
    out = rs.context_for_assistant(rows, ["session_id"], evt_block(), ["ts_ms", "event_index"])
    return out.select("session_id", "event_index", F.col("context.percent").alias("context_percent"))


@query("f17_last_context_per_turn", with_ctes(EVT_TURNS_SQL, """SELECT session_id, CAST(turn_index AS BIGINT) AS turn_index,
  arg_max(percent, event_index) FILTER (kind = 'token_count') AS context_percent FROM evt_turned WHERE turn_index >= 0 GROUP BY ALL"""))
def f17(spark, sf):
    return evt_turned(spark, sf).filter("turn_index >= 0").groupBy("session_id", "turn_index").agg(
        F.max_by("percent", F.when(F.col("kind") == "token_count", F.col("event_index"))).alias("context_percent"))


@query("d10_event_to_turn", with_ctes(EVT_TURNS_SQL, """orders_at AS (SELECT event_id AS point_id, user_id AS session_id, epoch_us(ts) // 1000 - 7200000 AS t FROM events)""",
  """b AS (SELECT session_id, turn_index, started_ms, coalesce(completed_ms, lead(started_ms) OVER (PARTITION BY session_id ORDER BY turn_index)) AS end_ms FROM evt_turns)""",
  """SELECT point_id, p.session_id, min(turn_index) AS turn_index FROM orders_at p LEFT JOIN b ON b.session_id = p.session_id
   AND t >= started_ms AND (end_ms IS NULL OR t <= end_ms) GROUP BY ALL"""))
def d10(spark, sf):
    from seslog.functions.ordered import following_row
    from seslog.functions.staging import stage

    turns = stage(evt_turns(evt_turned(spark, sf)))
    bounded = ordered_scan(turns, ["session_id"], event_block("turn_index"), ["turn_index"], __next=following_row(F.col("started_ms")))
    spans = stage(bounded.select("session_id", F.col("turn_index").alias("ord"), F.col("turn_index").alias("interval_id"),
                           F.col("started_ms").alias("start_ms"), F.coalesce("completed_ms", "__next").alias("end_ms")))
    points = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("point_id"), (millis("ts") - 7_200_000).alias("t"))
    return tj.first_covering(points, spans, ["session_id"], WIDE).select("session_id", "point_id", F.col("interval_id").alias("turn_index"))


@query("d9_child_to_turn", """WITH t AS (SELECT o_custkey AS session_id, o_orderkey AS turn_id, epoch_ms(o_orderdate) AS start_ms,
   epoch_ms(o_orderdate) + 20 * 86400000 AS end_ms FROM orders),
 c AS (SELECT row_number() OVER () AS rid, l_suppkey * 13 % 1500 AS session_id, l_orderkey AS child_id, l_linenumber AS child_no, epoch_ms(l_shipdate) AS anchor_ms FROM lineitem)
 SELECT session_id, child_id, child_no, turn_id FROM (SELECT rid, c.session_id, child_id, child_no, arg_min(turn_id, (start_ms, turn_id)) AS turn_id
 FROM c LEFT JOIN t ON t.session_id = c.session_id AND anchor_ms >= start_ms AND anchor_ms <= end_ms GROUP BY ALL)""")
def d9(spark, sf):
    """Turns of a session in time order; a child goes to the first turn that holds its anchor, else to the root (NULL)."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("interval_id"), millis("o_orderdate").alias("start_ms"))
    turns = with_position(orders, ["session_id"], F.floor(F.col("start_ms") / TOOL_WIDTH_MS), ["start_ms", "interval_id"], "ord").withColumn(
        "end_ms", F.col("start_ms") + 20 * DAY_MS)
    children = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 13 % 1500).alias("session_id"), F.col("l_orderkey").alias("child_id"), F.col("l_linenumber").alias("child_no"), millis("l_shipdate").alias("t"))
    placed = tj.first_covering(children, turns, ["session_id"], TOOL_WIDTH_MS)
    return placed.select("session_id", "child_id", "child_no", F.col("interval_id").alias("turn_id"))


@query("d11_nearest_context", with_ctes(EVT_EVENTS_SQL, """
 q AS (SELECT session_id, event_index, ts_ms FROM evt_events WHERE kind = 'agent_message')""",
 """s AS (SELECT session_id, event_index AS snap_index, ts_ms AS snap_ms, percent FROM evt_events WHERE kind = 'token_count')""",
 """j AS (SELECT q.session_id, q.event_index, percent, snap_ms, row_number() OVER (PARTITION BY q.session_id, q.event_index
    ORDER BY abs(snap_ms - ts_ms), snap_ms, snap_index) AS rn FROM q LEFT JOIN s USING (session_id))""",
 "SELECT session_id, event_index, percent, snap_ms FROM j WHERE rn = 1"))
def d11(spark, sf):
    rows = evt_events(spark, sf)
    snaps = rows.filter("kind = 'token_count'").select(
        "session_id", F.col("ts_ms").alias("t"), F.col("event_index").alias("ord"), "percent", F.col("ts_ms").alias("snap_ms"))
    targets = rows.filter("kind = 'agent_message'").select("session_id", "event_index", F.col("ts_ms").alias("t"))
    return tj.nearest(targets, snaps, ["session_id"], ["percent", "snap_ms"], WIDE).drop("t")


PIECES_SQL = f"""p AS (SELECT o_custkey AS session_id, o_orderkey AS turn_id, l_linenumber AS no, epoch_ms(o_orderdate) + l_linenumber * {DAY_MS} AS day_ms,
  max(l_quantity) AS l_quantity, max(l_suppkey) AS l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
 seg AS (SELECT session_id, turn_id, no AS segment_id, day_ms + (l_suppkey % 6) * {HOUR} AS s, day_ms + (l_suppkey % 6 + 18) * {HOUR} AS e FROM p),
 resp AS (SELECT session_id, turn_id, no AS span_id, no AS ord, day_ms - 10 * {HOUR} AS s, day_ms - 10 * {HOUR} + CAST(l_quantity AS BIGINT) * 1200000 AS e FROM p)"""


def _pieces(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn_id"), millis("o_orderdate").alias("d"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("turn_id"), "l_linenumber").agg(
        F.max("l_quantity").alias("l_quantity"), F.max("l_suppkey").alias("l_suppkey"))
    rows = orders.join(lines, "turn_id").withColumn("day_ms", F.col("d") + F.col("l_linenumber") * DAY_MS)
    keys = ["session_id", "turn_id"]
    hour = F.col("l_suppkey") % 6
    seg = rows.select(*keys, F.col("l_linenumber").alias("segment_id"), (F.col("day_ms") + hour * HOUR).alias("start_ms"), (F.col("day_ms") + (hour + 18) * HOUR).alias("end_ms"))
    begin = F.col("day_ms") - 10 * HOUR
    resp = rows.select(*keys, F.col("l_linenumber").alias("span_id"), F.col("l_linenumber").alias("ord"), begin.alias("start_ms"),
                       (begin + F.col("l_quantity").cast("long") * 1_200_000).alias("end_ms"))
    return seg, resp


@query("d12_greatest_overlap", with_ctes(PIECES_SQL, """o AS (SELECT session_id, turn_id, segment_id, span_id, ord, least(seg.e, resp.e) - greatest(seg.s, resp.s) AS ov
  FROM seg JOIN resp USING (session_id, turn_id) WHERE least(seg.e, resp.e) - greatest(seg.s, resp.s) > 0)""",
  """SELECT session_id, turn_id, segment_id, span_id, ov AS overlap_ms FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id, turn_id, segment_id ORDER BY ov DESC, ord) AS rn FROM o) WHERE rn = 1"""))
def d12(spark, sf):
    seg, resp = _pieces(spark, sf)
    return tj.greatest_overlap(seg, resp, ["session_id", "turn_id"], TOOL_WIDTH_MS)


@query("d13_tool_tokens_in_response", with_ctes(TOOL_INTERVALS_SQL, """SELECT r.turn_id, r.line_no, CAST(coalesce(sum(CASE WHEN t.tool IS NOT NULL
   THEN greatest(1, ceil(octet_length(encode(t.tool || chr(10) || t.part_id)) / 4.0)) END), 0) AS BIGINT) AS tool_call_tokens
  FROM tool_intervals r LEFT JOIN tool_intervals t ON t.session_id = r.session_id AND t.bucket = 'tool_execution'
   AND t.start_ms >= r.start_ms AND t.start_ms <= r.end_ms
  WHERE r.bucket = 'llm_wait' AND r.end_ms >= r.start_ms GROUP BY ALL"""))
def d13(spark, sf):
    rows = tool_intervals(spark, sf)
    responses = rows.filter("bucket = 'llm_wait' AND end_ms >= start_ms").select("session_id", F.struct("turn_id", "line_no").alias("id"), "start_ms", "end_ms")
    points = rows.filter("bucket = 'tool_execution'").select(
        "session_id", F.col("start_ms").alias("t"), rs.tool_call_tokens(F.col("tool"), F.col("part_id").cast("string")).alias("weight"))
    out = tj.sum_within(responses, points, ["session_id"], TOOL_WIDTH_MS)
    return out.select("id.turn_id", "id.line_no", F.col("total").alias("tool_call_tokens"))


@query("f18_step_list", with_ctes(TOOL_INTERVALS_SQL, """SELECT session_id, turn_id, line_no AS event_index, bucket, tokens,
  CASE WHEN end_ms >= start_ms THEN end_ms - start_ms END AS duration_ms FROM tool_intervals"""))
def f18(spark, sf):
    from seslog.operators.timing import with_duration

    rows = with_duration(tool_intervals(spark, sf).withColumnRenamed("line_no", "event_index"))
    return rs.steps(rows, "turn_id").select("session_id", "turn_id", "event_index", "bucket", "tokens", "duration_ms")


@query("c7_call_result_pairing", """WITH c AS (SELECT o_custkey AS session_id, o_orderkey AS call_pos, o_orderpriority AS call_id FROM orders WHERE o_orderkey % 3 = 0),
 r AS (SELECT o_custkey AS session_id, o_orderkey AS result_pos, o_orderpriority AS call_id, o_orderstatus AS output FROM orders WHERE o_orderkey % 3 <> 0),
 m AS (SELECT r.*, (SELECT max(call_pos) FROM c WHERE c.session_id = r.session_id AND c.call_id = r.call_id AND c.call_pos < r.result_pos) AS call_pos FROM r)
 SELECT session_id, call_id, call_pos, result_pos, 'completed' AS status FROM m
 UNION ALL SELECT session_id, call_id, call_pos, NULL, 'started' FROM c WHERE NOT EXISTS
   (SELECT 1 FROM m WHERE m.session_id = c.session_id AND m.call_id = c.call_id AND m.call_pos = c.call_pos)""")
def c7(spark, sf):
    from seslog.operators.pairing import pair

    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("call_id"),
        (F.col("o_orderkey") % 3 == 0).alias("is_call"))
    return pair(rows, ["session_id", "call_id"], "pos").select("session_id", "call_id", "call_pos", "result_pos", "status")


@query("c2_fork_replay_prefix", with_ctes(EVT_EVENTS_SQL, """s AS (SELECT session_id, min(event_index) FILTER (event_type = 'error') AS cut FROM evt_events GROUP BY 1)""",
 """p AS (SELECT session_id, cut FROM evt_events JOIN s USING (session_id) WHERE event_index < cut GROUP BY ALL
   HAVING count(*) FILTER (event_type IN ('purchase', 'click')) > 0 OR count(*) FILTER (event_type = 'signup') > 1)""",
 "SELECT e.session_id, e.event_index, e.event_type FROM evt_events e LEFT JOIN p USING (session_id) WHERE cut IS NULL OR event_index >= cut"))
def c2(spark, sf):
    from seslog.operators.turns import drop_fork_replay

    kind = F.col("event_type")
    rows = evt_events(spark, sf).withColumns({
        "payload_type": F.when(kind == "error", "task_started").otherwise("event"),
        "role": F.when(kind == "purchase", "assistant").when(kind == "signup", "user"),
        "semantic_kind": F.when(kind == "click", "tool_call").when(kind.isin("purchase", "signup"), "message").otherwise("event"),
    })
    return drop_fork_replay(rows).select("session_id", "event_index", "event_type")


@query("c17_session_metadata", with_ctes(EVT_EVENTS_SQL, """SELECT session_id,
  arg_min('m' || percent, event_index) FILTER (event_type = 'signup') AS title,
  arg_max('m' || percent, event_index) FILTER (event_type = 'view') AS model,
  arg_max('m' || percent, event_index) FILTER (event_type = 'click') AS reasoning_effort,
  arg_min(ts_ms, event_index) FILTER (event_type = 'purchase') AS started_ms FROM evt_events GROUP BY 1"""))
def c17(spark, sf):
    from seslog.operators.sessions import first_where, last_where

    label = F.concat(F.lit("m"), F.col("percent").cast("string"))
    kind = F.col("event_type")
    return evt_events(spark, sf).groupBy("session_id").agg(
        first_where(label, kind == "signup").alias("title"), last_where(label, kind == "view").alias("model"),
        last_where(label, kind == "click").alias("reasoning_effort"), first_where(F.col("ts_ms"), kind == "purchase").alias("started_ms"))


NOW = 1_706_000_000_000


@query("c12_session_status_stale", with_ctes(EVT_TURNS_SQL, f"""st AS (SELECT session_id, CAST(turn_index AS BIGINT) AS turn_index,
   CASE WHEN count(*) FILTER (kind = 'task_failed') > 0 THEN 'failed' ELSE 'running' END AS status FROM evt_turned WHERE turn_index >= 0 GROUP BY ALL)""",
 f"""l AS (SELECT session_id, arg_max(status, turn_index) AS status FROM st GROUP BY 1),
   m AS (SELECT session_id, max(ts_ms) AS mtime FROM evt_events GROUP BY 1)""",
 f"SELECT session_id, CASE WHEN status = 'running' AND {NOW} - mtime >= 1800000 THEN 'stopped' ELSE status END AS status FROM l JOIN m USING (session_id)"))
def c12(spark, sf):
    from seslog.operators.turns import session_status

    turned = evt_turned(spark, sf)
    turns = turned.filter("turn_index >= 0").groupBy("session_id", "turn_index").agg(
        F.when(F.count_if(F.col("kind") == "task_failed") > 0, "failed").otherwise("running").alias("status"))
    return session_status(turns, turned.groupBy("session_id").agg(F.max("ts_ms").alias("mtime_ms")), NOW)


@query("e3_event_type_statistics", """SELECT event_type AS kind, count(*) AS n,
   CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value + 0.5) ELSE greatest(1, ceil(length(props) / 4.0)) END) AS BIGINT) AS approx_tokens,
   CAST(sum(length(props)) AS BIGINT) AS approx_bytes FROM events GROUP BY 1""")
def e3(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("tokens"),
        F.length("props").alias("raw_size"), F.lit(None).cast("string").alias("title"))
    return event_statistics(rows)


@query("e5_event_share", """SELECT event_type AS kind, count(*) AS n, floor(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 * 10 + 0.5) / 10 AS share_percent,
  floor(avg(greatest(1, ceil(length(props) / 4.0))) * 10 + 0.5) / 10 AS average_tokens FROM events GROUP BY 1""")
def e5(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.lit(None).cast("double").alias("tokens"), F.length("props").alias("raw_size"), F.lit(None).cast("string").alias("title"))
    return with_share(event_statistics(rows)).select("kind", "n", "share_percent", "average_tokens")


@query("e8_latest_context_window", with_ctes(EVT_EVENTS_SQL, """SELECT session_id, coalesce(arg_max(percent * 1000, event_index)
   FILTER (kind = 'token_count' AND percent > 20), 0) AS context_window FROM evt_events GROUP BY 1"""))
def e8(spark, sf):
    rows = evt_events(spark, sf).withColumn("window", F.when((F.col("kind") == "token_count") & (F.col("percent") > 20), F.col("percent") * 1000))
    return latest_window(rows, F.col("event_index"))


@query("e18_error_count", """SELECT user_id AS session_id, greatest(count(*) FILTER (regexp_matches(event_type || props, '(?i)error|failed|失败|错误')),
   count(*) FILTER (event_type = 'click' AND regexp_matches(props, '9'))) AS errors FROM events GROUP BY 1""")
def e18(spark, sf):
    rows = evt_rows(spark, sf)
    items = rows.filter("event_type = 'click'").select("session_id", F.when(F.col("props").contains("9"), "failed").otherwise("ok").alias("text"))
    return error_counts(rows.select("session_id", F.concat("event_type", "props").alias("text")), items)


@query("g10_event_filter", """SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '(?i)tool|call|function|mcp|patch|click') AND props LIKE '%7%'""")
def g10(spark, sf):
    from seslog.operators.reading import event_filter

    rows = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "click", "function_call").otherwise(F.col("event_type")).alias("kind"),
        F.lit(None).cast("string").alias("raw_type"), F.lit(None).cast("string").alias("payload_type"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("preview"), F.col("props").alias("record"))
    return event_filter(rows, "tool", "7").select("event_id", "event_type")


FROM_MS, TO_MS = 1_704_326_400_000, 1_705_536_000_000


@query("h8_event_query", with_ctes(EVT_EVENTS_SQL, f"""SELECT session_id, event_index, kind, percent FROM evt_events
  WHERE kind IN ('token_count', 'function_call') AND ts_ms >= {FROM_MS} AND ts_ms <= {TO_MS} AND lower(kind || chr(10) || props) LIKE '%k%: 8%'"""))
def h8(spark, sf):
    from seslog.operators.reading import query_events

    rows = evt_events(spark, sf).withColumn("search_text", F.concat_ws("\n", "kind", "props"))
    return query_events(rows, kinds=["token_count", "function_call"], since=FROM_MS, until=TO_MS, text='K":  8').select(
        "session_id", "event_index", "kind", "percent")


@query("s4_json_path", """SELECT event_id, TRY(json_extract_string(src, '$.k')) AS value,
  CASE WHEN trim(src) = '' THEN 'empty' WHEN NOT json_valid(src) THEN 'not-json' WHEN TRY(json_extract(src, '$.k')) IS NULL THEN 'not-found' END AS reason
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{bad' WHEN 2 THEN ' ' ELSE '{"a":1}' END AS src FROM events)""")
def s4(spark, sf):
    from seslog.functions.jsonpath import extract

    n = F.col("event_id") % 4
    rows = table(spark, sf, "events").select(
        "event_id", F.when(n == 0, F.col("props")).when(n == 1, "{bad").when(n == 2, " ").otherwise('{"a":1}').alias("src"))
    value, reason = extract(F.col("src"), "k")
    return rows.select("event_id", value.alias("value"), reason.alias("reason"))


__all__ = ["event_counts", "last_value"]


# --- times of a session, contexts of a step ---------------------------------------------------------------------------------
COVERED = """SELECT session_id, sum(greatest(e - greatest(s, coalesce(m, s)), 0)) AS ms FROM (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {0}) GROUP BY 1"""


@query("f12_active_and_waiting", with_ctes(EVT_TURNS_SQL, """e AS (SELECT session_id, min(ts_ms) AS f, max(ts_ms) AS l FROM evt_events GROUP BY 1)""",
  """t AS (SELECT session_id, arg_min(started_ms, turn_index) AS s FROM evt_turns GROUP BY 1)""",
  """w AS (SELECT session_id, last_assistant_ms AS s, lead(first_user_ms) OVER (PARTITION BY session_id ORDER BY turn_index) AS e FROM evt_turns)""",
  """wait AS (SELECT * FROM w WHERE e > s)""",
  """run AS (SELECT session_id, ts_ms AS s, lead(ts_ms, 3) OVER (PARTITION BY session_id ORDER BY event_index) AS e, kind FROM evt_events)""",
  """iv AS (SELECT * FROM run WHERE kind = 'function_call' AND e IS NOT NULL)""",
  "a AS (" + COVERED.format("iv") + ")", "b AS (" + COVERED.format("wait") + ")",
  """SELECT e.session_id, coalesce(t.s, f) AS start_ms, l AS end_ms, l - coalesce(t.s, f) AS wall_ms, coalesce(a.ms, 0) AS active_ms, coalesce(b.ms, 0) AS waiting_ms
  FROM e LEFT JOIN t USING (session_id) LEFT JOIN a USING (session_id) LEFT JOIN b USING (session_id)"""))
def f12_times(spark, sf):
    """A call runs until the third event after it, so calls overlap; a wait is from an answer to the next request."""
    turned = stage(evt_turned(spark, sf))
    turns = stage(evt_turns(turned))
    ends = turned.select("session_id", (F.col("event_index") - 3).alias("event_index"), F.col("ts_ms").alias("end_ms"))
    calls = turned.filter("kind = 'function_call'").select("session_id", "event_index", F.col("ts_ms").alias("start_ms")).join(ends, ["session_id", "event_index"], "left")
    return rs.session_times(rs.session_bounds(turns, turned), calls, rs.input_waits(turns), WIDE)


CONTEXT_SQL = EVT_EVENTS_SQL + """,
 s AS (SELECT session_id, event_index, ts_ms AS snap_ms, percent, percent - lag(percent) OVER (PARTITION BY session_id ORDER BY event_index) AS delta_percent FROM evt_events WHERE kind = 'token_count'),
 q AS (SELECT session_id, event_index, ts_ms, kind, CASE WHEN kind = 'token_count' THEN percent + event_id % 2 END AS own FROM evt_events WHERE kind IN ('token_count', 'agent_message')),
 j AS (SELECT q.session_id, q.event_index, s.percent, s.delta_percent, snap_ms, row_number() OVER (PARTITION BY q.session_id, q.event_index ORDER BY abs(snap_ms - ts_ms), snap_ms, s.event_index) AS rn
   FROM q LEFT JOIN s USING (session_id) WHERE own IS NULL),
 c AS (SELECT session_id, event_index, percent, delta_percent, snap_ms FROM j WHERE rn = 1
   UNION ALL SELECT q.session_id, q.event_index, own, s.delta_percent, s.snap_ms FROM q LEFT JOIN s ON s.session_id = q.session_id AND s.event_index = q.event_index AND s.percent = own WHERE own IS NOT NULL)"""


def _contexts(spark, sf):
    rows = stage(evt_events(spark, sf))
    snaps = rows.filter("kind = 'token_count'").select("session_id", "event_index", F.col("ts_ms").alias("t"), F.col("event_index").alias("ord"), "percent", F.col("ts_ms").alias("snap_ms"))
    changed = rs.context_changes(snaps, event_block(), ["event_index"])
    own = F.when(F.col("kind") == "token_count", F.col("percent") + F.col("event_id") % 2)
    targets = rows.filter("kind IN ('token_count', 'agent_message')").select("session_id", "event_index", F.col("ts_ms").alias("t"), F.col("event_index").alias("ord"), own.alias("own_percent"))
    found = tj.closest_context(targets, changed.drop("event_index"), ["session_id"], WIDE)
    return rows, found.select("session_id", "event_index", "percent", "delta_percent", "snap_ms")


@query("d11_exact_or_nearest", with_ctes(CONTEXT_SQL, "SELECT session_id, event_index, percent, delta_percent, snap_ms FROM c"))
def d11_exact(spark, sf):
    """Half of the token events find the snapshot of their own event, the others keep their own value; answers take the nearest."""
    return _contexts(spark, sf)[1]


@query("f18_step_contexts", with_ctes(CONTEXT_SQL, """SELECT e.session_id, e.event_id, e.event_index, CASE WHEN e.kind = 'agent_message' THEN c.percent END AS percent, CASE WHEN e.kind = 'agent_message' THEN c.delta_percent END AS delta_percent,
  CASE WHEN e.kind = 'agent_message' THEN c.snap_ms END AS snap_ms, CASE WHEN e.kind = 'agent_message' AND c.percent IS NOT NULL THEN 'recorded' END AS context_source FROM evt_events e LEFT JOIN c USING (session_id, event_index)"""))
def f18_contexts(spark, sf):
    """Every event a step; answers are waits for a model and show the context nearest to them."""
    rows, found = _contexts(spark, sf)
    intervals = rows.select("session_id", "event_id", "event_index", "tokens", F.when(F.col("kind") == "agent_message", "llm_wait").otherwise("tool_execution").alias("bucket"))
    contexts = found.join(rows.select("session_id", "event_index", "event_id"), ["session_id", "event_index"])
    return rs.steps(intervals, "event_id", contexts).select("session_id", "event_id", "event_index", "percent", "delta_percent", "snap_ms", "context_source")
