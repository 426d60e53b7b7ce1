"""Queries over the conversations, read as session logs.

Rows are written as the JSON records a log would hold and go through parsing, normalization and turn assembly; the
checks recompute the result from the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seslog.functions import redact
from seslog.functions.staging import stage
from seslog.functions.text import evidence_id
from seslog.operators import normalize as nz
from seslog.operators import reading as rd
from seslog.operators import responses as rs
from seslog.operators import stats, trace
from seslog.operators import turns as tn
from seslog.plans.registry import query
from seslog.plans.views import CONV_EVENTS_SQL, CONVERSATION_EPOCH_S, conv_events, table, with_ctes
from seslog.sources import logs

_cache: dict = {}


def cached(name):
    """Derived tables are written once per data folder and session and then read by every query that needs them."""

    def wrap(fn):
        def inner(spark, sf):
            key = (name, sf, spark.sparkContext.applicationId)
            if key not in _cache:
                _cache[key] = fn(spark, sf)
            return _cache[key]

        return inner

    return wrap


def records(spark, sf):
    """raw_events: user and assistant texts as event messages, system texts as response items."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(CONVERSATION_EPOCH_S) + F.col("conv_id") * 3600 + F.col("turn") * 30), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    spoken = F.struct(
        stamp.alias("timestamp"), F.lit("event_msg").alias("type"),
        F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload"))
    system = F.struct(
        stamp.alias("timestamp"), F.lit("response_item").alias("type"),
        F.struct(F.lit("message").alias("type"), F.col("role").alias("role"),
                 F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("payload"))
    line = F.when(F.col("role").isin("user", "assistant"), F.to_json(spoken)).otherwise(F.to_json(system))
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), (F.col("turn") + 1).alias("line_number"), line.alias("line"), F.lit(False).alias("blank"))
    return logs.parse_records(lines)


@cached("events")
def events(spark, sf):
    return stage(nz.normalize(records(spark, sf)))


@cached("assembly")
def assembly(spark, sf):
    return tn.assemble(tn.slim_events(events(spark, sf)))


# Independent recomputation: turns open at the first spoken row and at each user row after an answer.
TURNED_SQL = CONV_EVENTS_SQL + """,
clean AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, trim(text, E' \\t\\n\\r') AS tidy FROM conv_events),
spoken AS (SELECT *, sum(CASE WHEN prev IS NULL OR (role = 'user' AND prev = 'assistant') THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY event_index ROWS UNBOUNDED PRECEDING) - 1 AS turn_index
  FROM (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY event_index) AS prev FROM clean WHERE role <> 'system')),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index, role, flat ORDER BY event_index) AS rn FROM spoken)
  WHERE flat <> '' AND (role = 'user' OR rn = 1)),
items AS (SELECT session_id, CAST(turn_index AS BIGINT) AS turn_index,
    row_number() OVER (PARTITION BY session_id, turn_index ORDER BY event_index) - 1 AS item_index,
    CASE role WHEN 'user' THEN 'user-message' ELSE 'assistant-message' END AS type, event_index AS source_index, ts_ms,
    CASE role WHEN 'user' THEN tidy ELSE text END AS text, flat FROM kept),
turns AS (SELECT s.session_id, CAST(s.turn_index AS BIGINT) AS turn_index, min(s.ts_ms) AS started_ms,
    CASE WHEN arg_max(i.type, i.item_index) = 'assistant-message' THEN 'waiting' ELSE 'running' END AS status, count(DISTINCT i.item_index) AS n_items
  FROM spoken s JOIN items i ON i.session_id = s.session_id AND i.turn_index = s.turn_index GROUP BY ALL)"""


def turned(body: str) -> str:
    return with_ctes(TURNED_SQL, body)


ISO_SQL = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z')"


@query("b4_normalized_events", with_ctes(CONV_EVENTS_SQL, f"""SELECT session_id, event_index, 'generic' AS format,
  CASE WHEN role = 'system' THEN 'message' ELSE kind END AS kind, CASE WHEN role = 'system' THEN 'meta' ELSE 'message' END AS semantic_kind,
  CASE WHEN role = 'system' THEN 'system' END AS role, ts_ms, text, true AS important FROM conv_events"""))
def b4(spark, sf):
    return events(spark, sf).select("session_id", "event_index", "format", "kind", "semantic_kind", "role", "ts_ms", "text", "important")


@query("b5_semantic_kinds", """SELECT conv_id AS session_id, turn AS event_index, CASE turn % 4 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'tool_result'
  WHEN 2 THEN CASE role WHEN 'system' THEN 'meta' ELSE 'message' END ELSE CASE role WHEN 'system' THEN 'meta' ELSE 'message' END END AS semantic_kind,
  CASE turn % 4 WHEN 0 THEN 'custom_tool_call' WHEN 1 THEN 'function_call_output' WHEN 2 THEN CASE role WHEN 'user' THEN 'user_message'
  WHEN 'assistant' THEN 'agent_message' ELSE 'meta' END ELSE 'message' END AS kind FROM conversations""")
def b5(spark, sf):
    n = F.col("turn") % 4
    raw_type = F.when(n == 0, "event_msg").when(n == 1, "response_item").when(n == 2, None).otherwise("x")
    payload = F.when(n == 0, "custom_tool_call").when(n == 1, "tool_result").when(n == 2, None).otherwise("message")
    rows = table(spark, sf, "conversations").withColumn("kind", nz.classify_kind(raw_type, payload, F.col("role")))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), "kind", nz.classify_semantic(F.col("kind"), F.col("role")).alias("semantic_kind"))


@query("b7_roles", """SELECT conv_id AS session_id, turn AS event_index, CASE turn % 3 WHEN 0 THEN 'tool' WHEN 1 THEN NULL ELSE role END AS role FROM conversations""")
def b7(spark, sf):
    n = F.col("turn") % 3
    given = F.when(n == 0, "toolResult").when(n == 1, "").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), nz.normalize_role(given).alias("role"))


@query("b19_search_text", with_ctes(CONV_EVENTS_SQL, """SELECT session_id, event_index, CASE role
  WHEN 'system' THEN concat_ws(chr(10), 'message', 'meta', 'system', 'response_item', 'message', nullif(text, ''))
  WHEN 'user' THEN concat_ws(chr(10), kind, 'message', 'event_msg', kind, nullif(trim(text, E' \\t\\n\\r'), ''))
  ELSE concat_ws(chr(10), kind, 'message', 'event_msg', kind, nullif(text, '')) END AS search_text FROM conv_events"""))
def b19(spark, sf):
    return events(spark, sf).select("session_id", "event_index", "search_text")


@query("b21_importance", with_ctes(CONV_EVENTS_SQL, """SELECT session_id, event_index, kind IN ('user_message', 'agent_message') AS important FROM conv_events"""))
def b21(spark, sf):
    return conv_events(spark, sf).select("session_id", "event_index", nz.is_important(F.col("kind")).alias("important"))


@query("b22_titles_and_previews", with_ctes(CONV_EVENTS_SQL, """SELECT session_id, event_index,
  CASE role WHEN 'user' THEN '用户消息' WHEN 'assistant' THEN '助手消息' ELSE '系统消息' END AS title,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS preview FROM conv_events"""))
def b22(spark, sf):
    return events(spark, sf).select("session_id", "event_index", "title", "preview")


@query("b23_clean_user_text", """SELECT conv_id AS session_id, turn AS event_index, CASE turn % 4 WHEN 3 THEN '' ELSE trim(text, E' \\t\\n\\r') END AS text FROM conversations""")
def b23(spark, sf):
    n, text = F.col("turn") % 4, F.col("text")
    wrapped = (
        F.when(n == 0, F.concat(F.lit("# In app browser:\n- tab\n## My request for Codex: \n"), text))
        .when(n == 1, F.concat(F.lit("<environment_context>\n<cwd>/x</cwd>\n</environment_context>\n "), text))
        .when(n == 2, F.concat(F.lit("# AGENTS.md instructions for /x\nrules\n<environment_context>x</environment_context>\n"), text))
        .otherwise(F.concat(F.lit("<permissions instructions>\n"), text)))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), redact.clean_user_text(wrapped).alias("text"))


@query("a4_parsed_records", """SELECT conv_id AS session_id, turn AS event_index, turn % 5 <> 0 AS is_valid,
  CASE WHEN turn % 5 = 0 THEN 'invalid-json' END AS error_code, CASE WHEN turn % 5 = 0
  THEN substr(trim(regexp_replace('{' || text, '\\s+', ' ', 'g')), 1, 220) END AS preview FROM conversations""")
def a4(spark, sf):
    line = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("{"), F.col("text"))).otherwise(F.to_json(F.struct("text")))
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), line.alias("line"), F.lit(False).alias("blank"))
    return logs.parse_records(lines).select("session_id", "event_index", "is_valid", "error_code", "preview")


@query("a7_event_by_index", with_ctes(CONV_EVENTS_SQL, "SELECT session_id, event_index, kind, text FROM conv_events WHERE session_id = 7 AND event_index = 2"))
def a7(spark, sf):
    return logs.event_at(conv_events(spark, sf), 7, 2).select("session_id", "event_index", "kind", "text")


RANGE_SQL = CONV_EVENTS_SQL + """,
w AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
  FROM conv_events WHERE event_index >= 1 AND event_index < 6),
s AS (SELECT * FROM w WHERE coalesce(h, 0) < 2)"""


@query("a8_range_scan", with_ctes(RANGE_SQL, "SELECT session_id, event_index, text FROM s WHERE role = 'user'"))
def a8(spark, sf):
    return logs.range_scan(conv_events(spark, sf), 1, 2, 5, F.col("role") == "user")[0].select("session_id", "event_index", "text")


@query("a8_range_page_facts", with_ctes(RANGE_SQL, """z AS (SELECT session_id, max(event_index) + 1 AS size FROM conv_events GROUP BY 1)""",
  """SELECT session_id, max(event_index) + 1 AS next_cursor, count(*) AS scanned, max(event_index) + 1 >= max(size) AS exhausted FROM s JOIN z USING (session_id) GROUP BY 1"""))
def a8_facts(spark, sf):
    return logs.range_scan(conv_events(spark, sf), 1, 2, 5, F.col("role") == "user")[1]


@query("a15_source_union", """SELECT 'live' AS source_id, 'local' AS source_kind, conv_id AS session_id, count(*) AS events FROM conversations GROUP BY 3
  UNION ALL SELECT 'pi', 'pi-agent', conv_id, count(*) FROM conversations WHERE role = 'user' GROUP BY 3""")
def a15(spark, sf):
    rows = conv_events(spark, sf)
    both = logs.union_sources(logs.tag_source(rows, "live", "Local", "local"), logs.tag_source(rows.filter("role = 'user'"), "pi", "Pi", "pi-agent"))
    return both.groupBy("source_id", "source_kind", "session_id").agg(F.count(F.lit(1)).alias("events"))


@query("a20_derived_tables", with_ctes(CONV_EVENTS_SQL, f"""SELECT session_id, event_index, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS event_date, text FROM conv_events"""))
def a20(spark, sf):
    from seslog.sources.sinks import write_events

    path = write_events(conv_events(spark, sf))
    return spark.read.parquet(path).select("session_id", "event_index", F.col("event_date").cast("string").alias("event_date"), "text")


CHUNK_SQL = CONV_EVENTS_SQL + """,
chunks AS (SELECT session_id, event_index, role, kind, ts_ms, text, generate_subscripts(string_split(text, '. '), 1) AS n, unnest(string_split(text, '. ')) AS piece FROM conv_events WHERE role <> 'system')"""


@query("c1_delta_coalescing", with_ctes(CHUNK_SQL, """SELECT session_id, event_index * 100000 + min(n) AS event_index, string_agg(piece, '' ORDER BY n) AS text, count(*) AS chunks,
   ts_ms + max(n) AS delta_completed_ms FROM chunks GROUP BY session_id, event_index, ts_ms"""))
def c1(spark, sf):
    """Messages cut into chunks at sentence ends; chunks of one message carry its id."""
    rows = conv_events(spark, sf).filter("role <> 'system'").select(
        "session_id", F.col("event_index").alias("__i"), "role", "kind", "ts_ms", F.posexplode(F.split("text", r"\. ")).alias("n", "text"))
    chunks = rows.select(
        "session_id", (F.col("__i") * 100_000 + F.col("n") + 1).alias("event_index"), F.concat(F.lit("m"), F.col("__i").cast("string")).alias("message_id"),
        "role", "kind", (F.col("ts_ms") + F.col("n") + 1).alias("ts_ms"), "text", F.lit(True).alias("is_delta"), F.lit("message").alias("semantic_kind"))
    return tn.coalesce_deltas(chunks).select("session_id", "event_index", "text", "chunks", "delta_completed_ms")


@query("c3_turn_segmentation", turned("SELECT session_id, turn_index, 'turn-' || (turn_index + 1) AS turn_id, started_ms, n_items FROM turns"))
def c3(spark, sf):
    return assembly(spark, sf).turns.select("session_id", "turn_index", "turn_id", "started_ms", "n_items")


@query("c4_item_typing", turned("SELECT session_id, turn_index, item_index, type, source_index, ts_ms, text FROM items"))
def c4(spark, sf):
    return assembly(spark, sf).items.select("session_id", "turn_index", "item_index", "type", "source_index", "ts_ms", "text")


@query("c6_assistant_duplicates", with_ctes("""d AS (SELECT conv_id AS session_id, turn * 2 + k AS event_index, turn // 4 AS turn_seq, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat
    FROM conversations, (VALUES (0), (1)) v(k) WHERE role = 'assistant')""",
  "SELECT session_id, turn_seq, min(event_index) AS event_index FROM d WHERE flat <> '' GROUP BY session_id, turn_seq, flat"))
def c6(spark, sf):
    """Every assistant row twice: the second one is a repetition within its turn."""
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "turn", "text")
    candidates = rows.select(
        "session_id", (F.col("turn") * 2 + F.col("k")).alias("event_index"), F.floor(F.col("turn") / 4).alias("turn_seq"), F.lit(1000).alias("sub"),
        F.lit("assistant-message").alias("op"), F.col("text").alias("item_text"), F.lit(None).cast("string").alias("message_id"), F.lit("agent_message").alias("kind"),
        F.lit("event_msg").alias("raw_type"), F.lit(False).alias("has_attachments"))
    return tn._keep_messages(candidates).select("session_id", "turn_seq", "event_index")


@query("c9_turn_status", turned("SELECT session_id, turn_index, status FROM turns"))
def c9(spark, sf):
    return assembly(spark, sf).turns.select("session_id", "turn_index", "status")


@query("c12_session_status", turned("SELECT session_id, arg_max(status, turn_index) AS status FROM turns GROUP BY 1"))
def c12(spark, sf):
    return tn.session_status(assembly(spark, sf).turns)


@query("c15_session_title", turned("SELECT session_id, arg_min(flat, event_index) AS title FROM clean WHERE role = 'user' AND flat <> '' GROUP BY 1"))
def c15(spark, sf):
    from seslog.operators.sessions import session_titles

    rows = events(spark, sf).select(
        "session_id", "event_index", "kind", "semantic_kind", "role", "raw_type", F.lit(None).cast("string").alias("info_name"), redact.clean_user_text(F.col("text")).alias("user_text"))
    return session_titles(rows).filter("title IS NOT NULL")


@query("d20_item_source_event", turned("SELECT session_id, turn_index, item_index, source_index AS event_index FROM items"))
def d20(spark, sf):
    """Every third item has lost its source index and is found again by time, kind and text."""
    rows = assembly(spark, sf).items.withColumn("source_index", F.when(F.col("source_index") % 3 != 0, F.col("source_index")))
    return rd.event_source(rows, events(spark, sf)).select("session_id", "turn_index", "item_index", "event_index")


@query("e1_event_counts", with_ctes(CONV_EVENTS_SQL, """SELECT session_id, 'kind' AS "by", kind AS value, count(*) AS n FROM conv_events GROUP BY ALL
  UNION ALL SELECT session_id, 'role', role, count(*) FROM conv_events GROUP BY ALL"""))
def e1(spark, sf):
    return stats.event_counts(conv_events(spark, sf))


@query("e2_session_detail_stats", turned("""SELECT c.session_id, count(*) AS events, 0 AS bad_lines, 0 AS compactions, count(*) AS important,
  (SELECT count(*) FROM turns t WHERE t.session_id = c.session_id) AS turns, CASE WHEN c.session_id % 5 = 0 THEN 1 ELSE 0 END AS children FROM conv_events c GROUP BY c.session_id"""))
def e2(spark, sf):
    rows = events(spark, sf).withColumn("compact_kind", F.col("compact.kind"))
    children = rows.select("session_id").distinct().filter(F.col("session_id") % 5 == 0).select(F.col("session_id").alias("parent_id"))
    return stats.detail_stats(rows, assembly(spark, sf).turns, children).drop("size")


@query("e15_turn_metrics", with_ctes(TURNED_SQL, """SELECT session_id, turn_index, CAST(nullif(sum(CASE WHEN type = 'assistant-message' THEN length(text) END), 0) AS BIGINT) AS generated_tokens,
   arg_max(source_index, item_index) FILTER (type = 'user-message') AS ending_percent FROM items GROUP BY ALL"""))
def e15(spark, sf):
    """Token counts made from text lengths; user items stand in for the token records."""
    type_ = F.col("type")
    rows = assembly(spark, sf).items.select(
        "session_id", "turn_index", "item_index", F.when(type_ == "user-message", "token-count").otherwise(type_).alias("type"),
        F.when(type_ == "assistant-message", F.struct(F.length("text").alias("generated_tokens"))).alias("token_usage"),
        F.when(type_ == "user-message", F.struct(F.col("source_index").alias("percent"))).alias("context_usage"))
    return rd.turn_metrics(rows).select("session_id", "turn_index", "generated_tokens", F.col("ending_usage.percent").alias("ending_percent"))


@query("e17_terminal_roles", turned("""SELECT session_id, count(*) FILTER (type = 'user-message') AS "user", count(*) FILTER (type = 'assistant-message' AND source_index % 4 <> 1) AS assistant,
  count(*) FILTER (type = 'assistant-message' AND source_index % 4 = 1) + count(*) FILTER (type = 'assistant-message' AND source_index % 4 = 1 AND length(text) % 3 <> 0) AS tool,
  count(*) FILTER (type = 'assistant-message' AND source_index % 4 = 1 AND length(text) % 3 = 0) AS error FROM items GROUP BY 1"""))
def e17(spark, sf):
    """Some answers are read as tool calls with output, a third of which failed."""
    tool = (F.col("type") == "assistant-message") & (F.col("source_index") % 4 == 1)
    rows = assembly(spark, sf).items.withColumns({
        "output": F.when(tool, "out"), "status": F.when(tool & (F.length("text") % 3 == 0), "failed").otherwise("completed"), "phase": F.lit(None).cast("string"),
        "type": F.when(tool, "tool-call").otherwise(F.col("type"))})
    return stats.terminal_role_counts(stats.terminal_blocks(rows))


ENTRY_SQL = """n AS (SELECT conv_id AS session_id, turn + 1 AS entry_index, role, CASE WHEN turn % 3 <> 1 THEN turn + 1 END AS turn_number, length(text) AS text_length FROM conversations)"""


def _entries(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("entry_index"), "role", F.lit(None).cast("string").alias("type"),
        F.when(F.col("turn") % 3 != 1, F.col("turn") + 1).alias("turn_number"), F.length("text").alias("text_length"))


@query("e20_replacement_roles", with_ctes(ENTRY_SQL, "SELECT session_id, role, count(*) AS n FROM n GROUP BY ALL"))
def e20(spark, sf):
    return rd.compaction_roles(_entries(spark, sf), ["session_id"])


@query("e20_covered_turns", with_ctes(ENTRY_SQL, """SELECT session_id, min(turn_number) AS from_turn, max(turn_number) AS to_turn FROM (
   SELECT DISTINCT session_id, turn_number, turn_number - dense_rank() OVER (PARTITION BY session_id ORDER BY turn_number) AS i FROM n WHERE turn_number IS NOT NULL) GROUP BY session_id, i"""))
def e20_turns(spark, sf):
    return rd.covered_turns(_entries(spark, sf), ["session_id"])


@query("e20_longest_entry", with_ctes(ENTRY_SQL, """SELECT session_id, entry_index, text_length FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY text_length DESC, entry_index) AS rn FROM n) WHERE rn = 1"""))
def e20_longest(spark, sf):
    return rd.longest_entry(_entries(spark, sf), ["session_id"])


@query("e21_hand_off", turned("""SELECT t.session_id, arg_max(t.status, t.turn_index) AS status, count(DISTINCT t.turn_index) AS turns,
  (SELECT arg_min(text, source_index) FROM items i WHERE i.session_id = t.session_id AND type = 'user-message') AS goal,
  (SELECT arg_max(text, source_index) FROM items i WHERE i.session_id = t.session_id AND type = 'assistant-message') AS last_answer,
  0 AS tool_calls, CASE WHEN t.session_id % 5 = 0 THEN 1 ELSE 0 END AS children FROM turns t GROUP BY t.session_id"""))
def e21(spark, sf):
    built = assembly(spark, sf)
    children = built.turns.select("session_id").distinct().filter(F.col("session_id") % 5 == 0).select(F.col("session_id").alias("parent_id"))
    return stats.hand_off(built.items, built.turns, children)


@query("f5_inferred_responses", turned("""b AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id, turn_index ORDER BY item_index) AS p FROM items)""").rsplit("\n", 1)[0] + """,
b AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id, turn_index ORDER BY item_index) AS p FROM items)
SELECT session_id, turn_index, item_index, p AS start_ms, ts_ms AS end_ms FROM b WHERE type = 'assistant-message' AND ts_ms > p""")
def f5(spark, sf):
    built = assembly(spark, sf)
    return rs.inferred_responses(built.items, built.turns).select("session_id", "turn_index", "item_index", "start_ms", "end_ms")


@query("f6_measured_responses", with_ctes(TURNED_SQL, """m AS (SELECT *, max(CASE WHEN type = 'user-message' THEN ts_ms END) OVER (PARTITION BY session_id, turn_index ORDER BY item_index) AS u,
     max(CASE WHEN type = 'assistant-message' THEN ts_ms END) OVER (PARTITION BY session_id, turn_index ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
     min(ts_ms) OVER (PARTITION BY session_id, turn_index) AS s FROM items)""",
   """SELECT session_id, turn_index, item_index, greatest(coalesce(u, s), CASE WHEN a >= u OR u IS NULL THEN a END) AS start_ms, ts_ms AS end_ms, CAST(length(text) AS BIGINT) AS usage_tokens
      FROM m WHERE type = 'assistant-message' AND ts_ms > greatest(coalesce(u, s), CASE WHEN a >= u OR u IS NULL THEN a END)"""))
def f6(spark, sf):
    """Every answer carries usage (its text length), so every answer closes one response."""
    built = assembly(spark, sf)
    n = F.length("text").cast("long")
    none = F.lit(None).cast("long")
    usage = F.struct(n.alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"), n.alias("generated_tokens"), none.alias("input_tokens"), none.alias("total_tokens"),
                     none.alias("cache_read_tokens"), none.alias("cache_write_tokens"), F.lit(None).cast("double").alias("cost"))
    rows = built.items.withColumn("token_usage", F.when(F.col("type") == "assistant-message", usage))
    return rs.measured_responses(rows, built.turns).select("session_id", "turn_index", "item_index", "start_ms", "end_ms", "usage_tokens")


@query("f7_measured_else_inferred", turned("SELECT session_id, turn_index, count(*) FILTER (type = 'assistant-message') AS responses, turn_index % 2 = 0 AS measured FROM items GROUP BY ALL HAVING count(*) FILTER (type = 'assistant-message') > 0"))
def f7(spark, sf):
    built = assembly(spark, sf)
    answers = built.items.filter("type = 'assistant-message'").select("session_id", "turn_index", "item_index")
    both = rs.measured_else_inferred(answers.filter(F.col("turn_index") % 2 == 0), answers)
    return both.groupBy("session_id", "turn_index", "measured").agg(F.count(F.lit(1)).alias("responses"))


TIMELINE_SQL = CONV_EVENTS_SQL + """,
t AS (SELECT session_id % 10 AS session_id, row_number() OVER (PARTITION BY session_id % 10 ORDER BY session_id, event_index) - 1 AS turn_index, length(text) AS duration_ms, length(text) % 7 = 0 AS signal FROM conv_events),
c AS (SELECT session_id, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT t.*, n, sum(CASE WHEN signal THEN 1 ELSE 0 END) OVER (PARTITION BY t.session_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING) AS run FROM t JOIN c USING (session_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY session_id, run, signal ORDER BY turn_index) - 1 AS k FROM r),
e AS (SELECT session_id, min(turn_index) AS start_turn, max(turn_index) AS end_turn, CAST(nullif(sum(duration_ms), 0) AS BIGINT) AS duration_ms FROM g
  GROUP BY session_id, signal, run, CASE WHEN n > 24 AND NOT signal THEN k // 5 ELSE turn_index END),
a AS (SELECT session_id, avg(duration_ms) AS m FROM e WHERE duration_ms > 0 GROUP BY 1)"""


@query("f19_turn_timeline", with_ctes(TIMELINE_SQL, """SELECT session_id, start_turn, end_turn, duration_ms, round(greatest(1, coalesce(m, 1) * 0.08, coalesce(duration_ms, coalesce(m, 1))), 4) AS weight
  FROM e LEFT JOIN a USING (session_id)"""))
def f19(spark, sf):
    from seslog.functions.ordered import with_position

    rows = conv_events(spark, sf).select((F.col("session_id") % 10).alias("s"), F.col("session_id").alias("c"), "event_index", F.length("text").alias("duration_ms"))
    ordered = with_position(rows.withColumnRenamed("s", "session_id"), ["session_id"], F.floor(F.col("c") / 1000), ["c", "event_index"], "turn_index")
    turns = ordered.select("session_id", "turn_index", "duration_ms", (F.col("duration_ms") % 7 == 0).alias("signal"))
    return stats.timeline(turns, 65_536).withColumn("weight", F.round("weight", 4))


@query("f20_turn_bars", turned("""SELECT session_id, turn_index, CASE WHEN max(n_items) OVER w > 0
  THEN greatest(1.0, least(100.0, floor(CAST(n_items AS DOUBLE) / CAST(max(n_items) OVER w AS DOUBLE) * 100 * 10 + 0.5) / 10)) ELSE 100.0 END AS bar_percent FROM turns WINDOW w AS (PARTITION BY session_id)"""))
def f20(spark, sf):
    rows = assembly(spark, sf).turns.select("session_id", "turn_index", F.col("n_items").alias("duration_ms"), F.lit(0).alias("active_ms"))
    return stats.turn_bar_scale(rows)


@query("g1_item_nodes", turned("""SELECT session_id, 'item:' || turn_index || ':' || item_index || ':' || type AS node_id, 'turn:' || turn_index AS parent_id, 'message' AS type, flat AS title, ts_ms AS start_ms FROM items"""))
def g1(spark, sf):
    return trace.item_nodes(assembly(spark, sf).items, default_only=False).select("session_id", "node_id", "parent_id", "type", "title", "start_ms")


@query("g4_turn_titles", turned("""SELECT t.session_id, t.turn_index, coalesce(arg_min(flat, item_index) FILTER (type = 'user-message'), arg_min(flat, item_index) FILTER (type = 'assistant-message')) AS title,
   CASE WHEN count(*) FILTER (type = 'user-message') > 0 THEN 'user-message' ELSE 'assistant-message' END AS source FROM turns t JOIN items USING (session_id, turn_index) GROUP BY ALL"""))
def g4(spark, sf):
    built = assembly(spark, sf)
    return rd.turn_titles(built.items, built.turns)


@query("g6_turn_reading_rows", turned("""SELECT t.session_id, t.turn_index, t.status, count(*) FILTER (type = 'user-message') AS user_messages, count(*) FILTER (type = 'assistant-message') AS assistant_messages,
   arg_max(text, item_index) FILTER (type = 'assistant-message') AS last_answer, 0 AS compactions FROM turns t JOIN items USING (session_id, turn_index) GROUP BY ALL"""))
def g6(spark, sf):
    built = assembly(spark, sf)
    return rd.turn_rows(built.items, built.turns).select("session_id", "turn_index", "status", "user_messages", "assistant_messages", "last_answer", "compactions")


@query("g6_turn_messages", turned("SELECT session_id, turn_index, item_index, type, text, length(text) AS text_length FROM items"))
def g6_messages(spark, sf):
    return rd.turn_messages(assembly(spark, sf).items)


@query("g7_item_reading_rows", turned("SELECT session_id, turn_index, item_index, type, source_index, ts_ms, text, length(text) AS text_length FROM items"))
def g7(spark, sf):
    return rd.item_rows(assembly(spark, sf).items).drop("arguments_length", "output_length")


@query("g8_turn_content_filter", turned("""SELECT t.session_id, t.turn_index FROM turns t WHERE EXISTS (SELECT 1 FROM items i WHERE i.session_id = t.session_id AND i.turn_index = t.turn_index AND lower(text) LIKE '%the%')
   OR ('turn-' || (turn_index + 1) || ' ' || status) LIKE '%the%'"""))
def g8(spark, sf):
    built = assembly(spark, sf)
    return rd.turn_content_filter(built.turns, built.items, "message", "the").select("session_id", "turn_index")


@query("g9_item_filter", turned("SELECT session_id, turn_index, item_index FROM items WHERE lower(text) LIKE '%an%'"))
def g9(spark, sf):
    rows = assembly(spark, sf).items.select("session_id", "turn_index", "item_index", "text", "name", "call_id", "status", "arguments", "output", F.lit("user-message").alias("type"))
    return rd.item_filter(rows.drop("type").withColumn("type", F.lit("user-message")), "message", "").filter(F.lower("text").contains("an")).select("session_id", "turn_index", "item_index")


@query("h13_evidence_ids", """SELECT conv_id AS session_id, turn AS event_index, 'source:local%20logs|session:' || conv_id || '|thread:root|turn:' || (turn + 1) || '|event:' || turn || '|object:event' AS evidence_id FROM conversations""")
def h13(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"),
        evidence_id(F.lit("local logs"), F.col("conv_id"), turn=F.col("turn") + 1, event=F.col("turn"), entity="event").alias("evidence_id"))


SKILL_SQL = """i AS (SELECT conv_id AS session_id, turn // 3 AS turn_index, (turn % 4 = 0 AND role = 'user') OR turn % 4 = 1 AS skill FROM conversations)"""


def _skill_turns(spark, sf, kind):
    """Every fourth row declares a skill, where a user says it, every fourth reads a skill's file."""
    n, text = F.col("turn") % 4, F.col("text")
    declared = F.when(n == 0, F.concat(F.lit('<skill name="n" location="/s/SKILL.md">do it</skill>\n'), text)).otherwise(text)
    type_ = F.when(n == 1, "tool-call").when(F.col("role") == "user", "user-message").otherwise("assistant-message")
    items = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 3).alias("turn_index"), type_.alias("type"), declared.alias("text"),
        F.when(n == 1, "read").alias("name"), F.when(n == 1, F.to_json(F.struct(F.concat(F.lit("C:\\s\\"), F.col("role"), F.lit("\\Skill.md")).alias("path")))).alias("arguments"))
    turns = items.select("session_id", "turn_index").distinct().withColumns({"turn_id": F.lit("t"), "status": F.lit("waiting")})
    return rd.turn_content_filter(turns, items, kind).select("session_id", "turn_index")


@query("g8_skill_filter", with_ctes(SKILL_SQL, "SELECT session_id, turn_index FROM i GROUP BY 1, 2 HAVING bool_or(skill)"))
def g8_skill(spark, sf):
    return _skill_turns(spark, sf, "skill")
