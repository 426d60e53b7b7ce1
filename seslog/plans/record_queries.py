"""Queries over log records of every shape: each conversation row is written as one of twelve record shapes.

The rows go through JSON, parsing and normalization; the checks compute the expected fields from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seslog.functions.js import field, text_at
from seslog.functions.staging import stage
from seslog.functions.text import fill_template
from seslog.operators import context as cx
from seslog.operators import normalize as nz
from seslog.operators import reading as rd
from seslog.operators import sessions as ss
from seslog.operators import stats, trace
from seslog.operators import turns as tn
from seslog.plans.conversation_queries import cached
from seslog.plans.registry import query
from seslog.plans.views import CONVERSATION_EPOCH_S, TOOL_INTERVALS_SQL, TOOL_WIDTH_MS, TURN_BOUNDS_SQL, table, tool_intervals, turn_bounds, with_ctes
from seslog.sources import logs
from seslog.sources import sinks, threads

SHAPES = 12


def shaped_records(spark, sf):
    s, lit = F.struct, F.lit
    text, n = F.col("text"), F.col("turn").cast("string")
    stamp = F.date_format(F.timestamp_seconds(lit(CONVERSATION_EPOCH_S) + F.col("conv_id") * 3600 + F.col("turn") * 30), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    iso, size = stamp.alias("timestamp"), F.length("text")
    mid = F.concat(lit("m"), n)
    head = lambda kind: (lit(kind).alias("type"), mid.alias("id"), F.concat(lit("p"), n).alias("parentId"), iso)
    part = lambda kind, name="text": s(lit(kind).alias("type"), text.alias(name))
    call = s(lit("toolCall").alias("type"), F.concat(lit("c"), n).alias("id"), lit("read").alias("name"), s(text.alias("path")).alias("arguments"))
    usage = s(size.alias("input"), (size % 97).alias("output"), (size % 11).alias("reasoning"), lit(None).cast("int").alias("cacheRead"), s((size / 8).alias("total")).alias("cost"))
    own = (lit("p").alias("parentUuid"), mid.alias("uuid"), iso, F.concat(lit("s"), F.col("conv_id").cast("string")).alias("sessionId"))
    item = lambda *cols: s(iso, lit("response_item").alias("type"), s(*cols).alias("payload"))
    json = lambda value: F.to_json(value, {"ignoreNullFields": "false"})
    history = F.array(
        s(lit("message").alias("type"), F.col("role").alias("role"), F.array(s(lit("input_text").alias("type"), text.alias("text"))).alias("content"), F.concat(lit("turn-"), n).alias("turn_id")),
        s(lit("message").alias("type"), lit("assistant").alias("role"), F.array(s(lit("output_text").alias("type"), lit("fixed").alias("text"))).alias("content"), lit(None).cast("string").alias("turn_id")))
    shapes = [
        json(s(*head("message"), s(lit("User").alias("role"), F.array(part("text")).alias("content")).alias("message"))),
        # Parts of different shape: written side by side as JSON text.
        F.replace(json(s(*head("message"), s(lit("assistant").alias("role"), lit("@@").alias("content"), usage.alias("usage")).alias("message"))), lit('"@@"'), lit("@@")),
        json(s(*head("message"), s(lit("toolResult").alias("role"), F.concat(lit("c"), n).alias("toolCallId"), lit("read").alias("toolName"), F.array(part("text")).alias("content"), (F.col("turn") % 2 == 1).alias("isError")).alias("message"))),
        json(s(*own, lit("user").alias("type"), s(lit("user").alias("role"), text.alias("content")).alias("message"))),
        json(s(*own, lit("assistant").alias("type"), s(lit("assistant").alias("role"), F.array(s(lit("tool_use").alias("type"), F.concat(lit("k"), n).alias("id"), lit("Bash").alias("name"), s(text.alias("command")).alias("input"))).alias("content")).alias("message"))),
        json(s(*own, lit("user").alias("type"), s(lit("user").alias("role"), F.array(
            s(lit("tool_result").alias("type"), F.concat(lit("k"), n).alias("tool_use_id"), text.alias("content"), lit(False).alias("is_error")),
            s(lit("tool_result").alias("type"), F.concat(lit("j"), n).alias("tool_use_id"), lit("boom").alias("content"), lit(True).alias("is_error"))).alias("content")).alias("message"))),
        json(s(iso, lit("compacted").alias("type"), s(text.alias("message"), F.col("turn").alias("window_number"), history.alias("replacement_history")).alias("payload"))),
        json(item(lit("reasoning").alias("type"), F.array(s(text.alias("text"))).alias("summary"), F.substring("text", 1, 20).alias("encrypted_content"))),
        json(item(lit("message").alias("type"), lit("user").alias("role"), F.array(
            s(lit("input_text").alias("type"), text.alias("text"), lit(None).cast("string").alias("image_url")),
            s(lit("input_image").alias("type"), lit(None).cast("string").alias("text"), F.concat(lit("data:image/png;base64,"), F.repeat(lit("QUJD"), (F.col("turn") + 1).cast("int"))).alias("image_url")),
            s(lit("input_image").alias("type"), lit(None).cast("string").alias("text"), F.concat(lit("https://img.example.com/"), n).alias("image_url"))).alias("content"))),
        json(s(iso, lit("event_msg").alias("type"), s(lit("token_count").alias("type"), s(
            s(F.format_string("%,d", size).alias("total_tokens")).alias("total_token_usage"), lit(4096).alias("model_context_window"),
            s((size % 300).alias("input_tokens"), lit(7).alias("output_tokens"), lit(None).cast("int").alias("reasoning_output_tokens")).alias("last_token_usage")).alias("info")).alias("payload"))),
        json(item(lit("custom_tool_call_output").alias("type"), F.concat(lit("x"), n).alias("call_id"), text.alias("stdout"), lit("warn").alias("stderr"), s(lit("shell").alias("name")).alias("function"))),
        F.concat(lit("{"), text),
    ]
    parts = F.concat(F.lit('[{"type":"thinking","thinking":"hm","thinkingSignature":"sig"},'), F.to_json(part("text")), F.lit(","), F.to_json(call), F.lit("]"))
    shape = (F.col("conv_id") + F.col("turn")) % SHAPES
    line = None
    for index, value in enumerate(shapes):
        value = F.replace(value, F.lit("@@"), parts) if index == 1 else value
        line = F.when(shape == index, value) if line is None else line.when(shape == index, value)
    lines = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), (F.col("turn") + 1).alias("line_number"), line.alias("line"), F.lit(False).alias("blank"))
    return logs.parse_records(lines)


@cached("shaped")
def shaped(spark, sf):
    return stage(nz.normalize(shaped_records(spark, sf)))


KEY = ["session_id", "event_index"]
R_SQL = """r AS (SELECT conv_id AS session_id, turn AS event_index, (conv_id + turn) % 12 AS shape, turn, role, text, length(text) AS size, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM conversations)"""


def shaped_sql(body: str) -> str:
    return with_ctes(R_SQL, body)


@query("b1_dialects", shaped_sql("""SELECT session_id, event_index, CASE WHEN shape <= 2 THEN 'pi-agent' WHEN shape <= 5 THEN 'claude-code' ELSE 'generic' END AS format, CASE shape WHEN 0 THEN 'message' WHEN 1 THEN 'message' WHEN 2 THEN 'function_call_output'
  WHEN 3 THEN 'message' WHEN 4 THEN 'message' WHEN 5 THEN 'function_call_output' WHEN 6 THEN 'compacted' WHEN 7 THEN 'reasoning' WHEN 8 THEN 'message' WHEN 9 THEN 'token_count' WHEN 10 THEN 'custom_tool_call_output' ELSE 'jsonl_parse_error' END AS kind,
  CASE WHEN shape IN (0, 3, 8) THEN 'user' WHEN shape IN (1, 4) THEN 'assistant' WHEN shape IN (2, 5) THEN 'tool' END AS role FROM r"""))
def b1(spark, sf):
    return shaped(spark, sf).select(*KEY, "format", "kind", "role")


@query("b2_message_dialect", shaped_sql("""SELECT session_id, event_index, 'm' || turn AS message_id, 'p' || turn AS parent_id, CASE shape WHEN 2 THEN 'c' || turn ELSE 'm' || turn END AS call_id, text, CASE shape WHEN 2 THEN text END AS tool_output,
  CASE shape WHEN 2 THEN 'read' END AS tool_name, CASE shape WHEN 2 THEN turn % 2 = 0 END AS success FROM r WHERE shape <= 2"""))
def b2(spark, sf):
    return shaped(spark, sf).filter("format = 'pi-agent'").select(*KEY, "message_id", "parent_id", "call_id", "text", "tool_output", "tool_name", "success")


@query("b3_uuid_dialect", shaped_sql("""SELECT session_id, event_index, 'm' || turn AS message_id, 'p' AS parent_id, CASE shape WHEN 3 THEN text ELSE '' END AS text, CASE shape WHEN 5 THEN text END AS tool_output FROM r WHERE shape BETWEEN 3 AND 5"""))
def b3(spark, sf):
    return shaped(spark, sf).filter("format = 'claude-code'").select(*KEY, "message_id", "parent_id", "text", "tool_output")


@query("b8_identity_keys", shaped_sql("""SELECT session_id, event_index, CASE WHEN shape <= 5 THEN 'm' || turn END AS message_id, CASE WHEN shape <= 2 THEN 'p' || turn WHEN shape <= 5 THEN 'p' END AS parent_id,
  CASE WHEN shape = 2 THEN 'c' || turn WHEN shape <= 1 THEN 'm' || turn WHEN shape = 5 THEN 'k' || turn WHEN shape = 10 THEN 'x' || turn END AS call_id, false AS is_delta FROM r"""))
def b8(spark, sf):
    return shaped(spark, sf).select(*KEY, "message_id", "parent_id", "call_id", "is_delta")


@query("b9_text_parts", shaped_sql("""SELECT session_id, event_index, CASE WHEN shape IN (4, 5, 9, 10) THEN 0 ELSE 1 END AS parts, CASE WHEN shape IN (4, 5, 9, 10) THEN '' WHEN shape = 11 THEN substr(trim('{' || flat), 1, 220) ELSE text END AS text FROM r"""))
def b9(spark, sf):
    return shaped(spark, sf).select(*KEY, F.size("text_parts").alias("parts"), "text")


@query("b12_compactions", shaped_sql("""SELECT session_id, event_index, 'compacted' AS kind, 'summary' AS phase, text AS message, size AS message_length, 2 AS history_count, turn AS window_number FROM r WHERE shape = 6"""))
def b12(spark, sf):
    rows = shaped(spark, sf).filter("compact IS NOT NULL")
    return rows.select(*KEY, *[F.col(f"compact.{c}").alias(c) for c in ("kind", "phase", "message", "message_length", "history_count")], F.col("compact.window_number").cast("long").alias("window_number"))


@query("b12_compaction_entries", shaped_sql("""SELECT session_id, event_index, 1 AS entry_index, 'message' AS type, role, 'turn-' || turn AS turn_id, 'input_text' AS content_kind, trim(text, E' \\t\\n\\r') AS preview FROM r WHERE shape = 6
  UNION ALL SELECT session_id, event_index, 2, 'message', 'assistant', NULL, 'output_text', 'fixed' FROM r WHERE shape = 6"""))
def b12_entries(spark, sf):
    rows = shaped(spark, sf).filter("compact IS NOT NULL").select(*KEY, F.explode("compact.history").alias("e"))
    return rows.select(*KEY, F.col("e.index").alias("entry_index"), "e.type", "e.role", "e.turn_id", F.get("e.content_kinds", 0).alias("content_kind"), "e.preview")


@query("b13_attachments", shaped_sql("""SELECT session_id, event_index, 'inline' AS kind, 'image/png' AS media_type, (turn + 1) * 3 AS byte_length, 'inline image/png ' || (turn + 1) * 3 || ' bytes' AS label FROM r WHERE shape = 8
  UNION ALL SELECT session_id, event_index, 'url', NULL, NULL, 'remote image img.example.com' FROM r WHERE shape = 8"""))
def b13(spark, sf):
    return shaped(spark, sf).select(*KEY, F.explode("attachments").alias("a")).select(*KEY, "a.kind", "a.media_type", "a.byte_length", "a.label")


@query("b14_reasoning", shaped_sql("""SELECT session_id, event_index, CASE shape WHEN 7 THEN text ELSE 'hm' END AS summary, shape = 1 OR true AS encrypted, CASE shape WHEN 7 THEN least(size, 20) ELSE 3 END AS encrypted_length FROM r WHERE shape IN (1, 7)"""))
def b14(spark, sf):
    return shaped(spark, sf).filter("reasoning IS NOT NULL").select(*KEY, "reasoning.summary", "reasoning.encrypted", "reasoning.encrypted_length")


@query("b15_token_usage", shaped_sql("""SELECT session_id, event_index, CASE shape WHEN 1 THEN size % 97 ELSE 7 END AS output_tokens, CASE shape WHEN 1 THEN size % 11 ELSE 0 END AS reasoning_tokens, CASE shape WHEN 1 THEN size % 97 + size % 11 ELSE 7 END AS generated_tokens,
  CASE shape WHEN 1 THEN size ELSE size % 300 END AS input_tokens, CASE shape WHEN 1 THEN 0 END AS cache_read_tokens, CASE shape WHEN 1 THEN size / 8.0 END AS cost FROM r WHERE shape IN (1, 9)"""))
def b15(spark, sf):
    names = ("output_tokens", "reasoning_tokens", "generated_tokens", "input_tokens", "cache_read_tokens", "cost")
    return shaped(spark, sf).filter("token_usage IS NOT NULL").select(*KEY, *[F.col(f"token_usage.{c}").alias(c) for c in names])


@query("b16_tool_fields", shaped_sql("""SELECT session_id, event_index, CASE shape WHEN 2 THEN 'read' WHEN 5 THEN 'function_call_output' ELSE 'shell' END AS tool_name, CASE shape WHEN 10 THEN concat_ws(chr(10), nullif(text, ''), 'warn') ELSE text END AS tool_output FROM r WHERE shape IN (2, 5, 10)"""))
def b16(spark, sf):
    return shaped(spark, sf).filter("semantic_kind = 'tool_result'").select(*KEY, "tool_name", "tool_output")


@query("b17_embedded_tool_calls", shaped_sql("""SELECT session_id, event_index, CASE shape WHEN 1 THEN 'c' || turn ELSE 'k' || turn END AS call_id, CASE shape WHEN 1 THEN 'read' ELSE 'Bash' END AS name, text AS argument FROM r WHERE shape IN (1, 4)"""))
def b17(spark, sf):
    rows = shaped(spark, sf).select(*KEY, F.explode("tool_calls").alias("c"))
    doc = F.try_parse_json("c.arguments")
    return rows.select(*KEY, "c.call_id", "c.name", F.coalesce(text_at(doc, "path"), text_at(doc, "command")).alias("argument"))


@query("b17_embedded_tool_results", shaped_sql("""SELECT session_id, event_index, 'k' || turn AS call_id, text AS output, true AS success FROM r WHERE shape = 5 UNION ALL SELECT session_id, event_index, 'j' || turn, 'boom', false FROM r WHERE shape = 5"""))
def b17_results(spark, sf):
    return shaped(spark, sf).select(*KEY, F.explode("tool_results").alias("c")).select(*KEY, "c.*")


@query("b18_record_sizes", shaped_sql("""SELECT session_id, event_index, length('{"parentUuid":"p","uuid":"m' || turn || '","timestamp":"2024-01-01T00:00:00.000Z","sessionId":"s' || session_id || '","type":"user","message":{"role":"user","content":' || to_json(text) || '}}') AS raw_size, 0 AS payload_size
  FROM r WHERE shape = 3"""))
def b18(spark, sf):
    return shaped(spark, sf).filter("format = 'claude-code' AND kind = 'message' AND role = 'user'").select(*KEY, "raw_size", "payload_size")


@query("b20_diagnostic_rows", shaped_sql("""SELECT session_id, event_index, turn + 1 AS line_number, 'invalid-json' AS code, substr(trim('{' || flat), 1, 220) AS preview FROM r WHERE shape = 11"""))
def b20(spark, sf):
    return shaped(spark, sf).filter("diagnostic IS NOT NULL").select(*KEY, "diagnostic.line_number", "diagnostic.code", "diagnostic.preview")


@query("f15_context_usage", shaped_sql("""SELECT session_id, event_index, CASE WHEN (size % 300 + 7) <= 0 THEN 1 ELSE greatest(1, least(100, floor(used / 4096.0 * 100 + 0.5))) END AS percent, used, 4096 AS context_limit
  FROM (SELECT *, size AS used FROM r WHERE shape = 9)"""))
def f15(spark, sf):
    rows = shaped(spark, sf).filter("payload_type = 'token_count'").select(*KEY, cx.payload_context_usage().alias("u"))
    return rows.select(*KEY, F.col("u.percent").cast("long").alias("percent"), "u.used", F.col("u.limit").alias("context_limit"))


@query("s2_content_text", shaped_sql("SELECT session_id, event_index, text FROM r WHERE shape IN (0, 2)"))
def s2(spark, sf):
    content = field(F.col("raw"), "message.content")
    return shaped(spark, sf).filter("raw_type = 'message' AND size(tool_calls) = 0").select(*KEY, nz.content_text(content, ("text", "value")).alias("text"))


@query("s8_producer_truncation", "SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(text, '(?i)\\btruncated\\b|已截断') AS truncated FROM documents")
def s8(spark, sf):
    """Every third text with a mark behind it; others may say the word themselves."""
    return table(spark, sf, "documents").select("doc_id", sinks.truncation_mark(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\n[output truncated]").otherwise(""))).alias("truncated"))


@query("s9_template_fill", "SELECT doc_id, 'read ' || source || ' (' || lang || ')' AS line FROM documents")
def s9(spark, sf):
    from seslog.functions.text import clean_filled

    filled = fill_template(F.lit("read  {source} ({lang}) {missing} ："), {"source": F.col("source"), "lang": F.col("lang")})
    return table(spark, sf, "documents").select("doc_id", clean_filled(filled).alias("line"))


@query("c8_output_merge", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' tail' WHEN 1 THEN text || ' tail' WHEN 2 THEN text ELSE trim(text, E' \\t\\n\\r') || chr(10) || chr(10) || '~other~' END AS output FROM documents""")
def c8(spark, sf):
    n, text = F.col("doc_id") % 4, F.col("text")
    longer = F.concat(text, F.lit(" tail"))
    first = F.when(n == 0, text).when(n == 1, longer).otherwise(text)
    second = F.when(n == 0, longer).when(n == 1, text).when(n == 2, "").otherwise("~other~")
    return table(spark, sf, "documents").select("doc_id", tn.merge_output(first, second).alias("output"))


@query("c20_skill_declarations", """SELECT doc_id, 'skill' || doc_id % 9 AS name, '/skills/' || source AS location, trim(text, E' \\t\\n\\r') AS instruction, 'do it' AS user_text FROM documents WHERE doc_id % 2 = 0""")
def c20(spark, sf):
    block = F.concat(F.lit('<skill name="skill'), (F.col("doc_id") % 9).cast("string"), F.lit('" location="/skills/'), F.col("source"), F.lit('/">\n'), F.col("text"), F.lit("\n</skill>\n do it "))
    rows = table(spark, sf, "documents").select("doc_id", trace.skill_declaration(F.when(F.col("doc_id") % 2 == 0, block).otherwise(F.col("text"))).alias("d"))
    return rows.filter("d IS NOT NULL").select("doc_id", "d.name", "d.location", "d.instruction", "d.user_text")


@query("c21_skill_reads", """SELECT doc_id, source AS skill, '/s/' || source || '/SKILL.md' AS location, CASE doc_id % 4 WHEN 0 THEN 'attempted' WHEN 1 THEN 'failed' ELSE 'confirmed' END AS state FROM documents WHERE doc_id % 5 <> 0""")
def c21(spark, sf):
    arguments = F.when(F.col("doc_id") % 5 == 0, '{"path":"/s/readme.md"}').otherwise(F.concat(F.lit('{"path":" /s/'), F.col("source"), F.lit('/SKILL.md/"}')))
    rows = table(spark, sf, "documents").select("doc_id", trace.skill_read(F.lit("read"), arguments).alias("d"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("output"),
                                                F.when(F.col("doc_id") % 4 == 1, "failed").otherwise("completed").alias("status"))
    return rows.filter("d IS NOT NULL").select("doc_id", "d.skill", "d.location", trace.skill_read_state(F.col("output"), F.col("status")).alias("state"))


def _batches(spark, sf):
    """One sub-agent call per part with two tasks; sizes decide how they end."""
    s, n = F.struct, F.col("p_size")
    arguments = F.to_json(s(F.lit("parallel").alias("mode"), F.array(s(F.col("p_brand").alias("agent"), F.col("p_name").alias("task")), s(F.lit(" ").alias("agent"), F.lit("second").alias("task"))).alias("tasks")))
    details = F.to_json(s(F.array(
        s(F.col("p_brand").alias("agent"), (n % 3).alias("exitCode"), F.when(n % 5 == 0, "HTTP 429 Too many").alias("errorMessage")),
        s(F.lit("other").alias("agent"), F.lit(0).alias("exitCode"), F.lit(None).cast("string").alias("errorMessage"))).alias("results")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("session_id"), F.lit("c").alias("call_id"), F.lit("subagent").alias("name"), arguments.alias("arguments"), F.lit("out").alias("output"), F.lit("completed").alias("status"),
        F.when(n % 7 != 0, details).alias("details"))


FIRST_SQL = "CASE WHEN p_size % 5 = 0 THEN 'rate_limited' WHEN p_size % 3 = 0 THEN 'succeeded' ELSE 'failed' END"


@query("c19_embedded_batches", f"""SELECT p_partkey AS session_id, 'c' AS call_id, CASE WHEN {FIRST_SQL} = 'succeeded' THEN 'succeeded' ELSE 'partial' END AS status, 2 AS results FROM part WHERE p_size % 7 <> 0""")
def c19(spark, sf):
    return trace.embedded_batches(trace.embedded_results(_batches(spark, sf)))


@query("d21_request_results", f"""SELECT p_partkey AS session_id, 'c' AS call_id, 0 AS task_index, p_brand AS requested_agent, p_name AS task, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS result_agent, CASE WHEN p_size % 7 = 0 THEN 'pending' ELSE {FIRST_SQL} END AS status FROM part
  UNION ALL SELECT p_partkey, 'c', 1, '未指定代理', 'second', CASE WHEN p_size % 7 <> 0 THEN 'other' END, CASE WHEN p_size % 7 = 0 THEN 'pending' ELSE 'succeeded' END FROM part""")
def d21(spark, sf):
    calls = _batches(spark, sf)
    return trace.request_results(trace.embedded_requests(calls), trace.embedded_results(calls)).drop("summary")


@query("e23_outcome_counts", f"""SELECT status, count(*) AS n FROM (SELECT {FIRST_SQL} AS status FROM part WHERE p_size % 7 <> 0 UNION ALL SELECT 'succeeded' FROM part WHERE p_size % 7 <> 0) GROUP BY 1""")
def e23(spark, sf):
    return stats.outcome_counts(trace.embedded_results(_batches(spark, sf)), [])


@query("e24_latest_usage_total", """SELECT l_orderkey AS session_id, CAST(arg_max(l_partkey, (l_linenumber, l_suppkey, l_partkey)) AS BIGINT) AS total_tokens FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def e24(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn_index"), F.struct("l_suppkey", "l_partkey").alias("item_index"), F.col("l_partkey").alias("total_tokens"),
        F.when(F.col("l_returnflag") != "N", "token-count").otherwise("event").alias("type"))
    return stats.latest_usage_total(rows).filter("total_tokens IS NOT NULL")


@query("g12_notification_summary", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'unknown' END AS state, 'a' || doc_id AS agent_id, CASE doc_id % 4 WHEN 2 THEN 'note' ELSE trim(text, E' \\t\\n\\r') END AS body FROM documents""")
def g12(spark, sf):
    n, agent = F.col("doc_id") % 4, F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    s = F.struct
    payload = (
        F.when(n == 0, F.to_json(s(agent.alias("agent_path"), s(F.col("text").alias("completed")).alias("status"))))
        .when(n == 1, F.to_json(s(agent.alias("agent_id"), F.lit("Cancelled").alias("state"), F.col("text").alias("output"))))
        .when(n == 2, F.to_json(s(agent.alias("thread_id"), F.lit("in progress").alias("status"), F.lit("note").alias("message"))))
        .otherwise(F.to_json(s(agent.alias("agentId"), F.col("text").alias("result")))))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<subagent_notification>\n"), payload, F.lit("\n</subagent_notification>"))).otherwise(payload)
    rows = table(spark, sf, "documents").select("doc_id", trace.notification_summary(trace.notification_payload(wrapped)).alias("x"))
    return rows.select("doc_id", "x.state", "x.agent_id", "x.body")


@query("d3_spawn_edges", """SELECT CAST(p_partkey // 2 AS VARCHAR) AS parent_id, CAST(p_partkey AS VARCHAR) AS child_id, 'unknown' AS status FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT CAST(s_nationkey AS VARCHAR), s_name, 'open' FROM supplier""")
def d3(spark, sf):
    s = F.struct
    source = F.to_json(s(s(s(F.floor(F.col("p_partkey") / 2).cast("string").alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")))
    sessions = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, source).otherwise("cli").alias("source"))
    stored = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("parent_id"), F.col("s_name").alias("child_id"), F.lit("open").alias("status"))
    return ss.all_edges(sessions, stored)


@query("a12_thread_rows", """SELECT 't' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'first' ELSE 'shown' END AS title, 'C:/x/' || o_orderkey AS path, epoch_ms(o_orderdate) AS updated_ms, epoch_ms(o_orderdate) AS created_ms, o_orderstatus = 'F' AS archived
  FROM orders WHERE o_orderkey % 10 <> 9""")
def a12(spark, sf):
    n, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), key).alias("id"), F.when(n == 0, F.col("o_orderpriority")).otherwise("").alias("title"), F.when(n == 1, "first").alias("first_user_message"), F.lit("shown").alias("preview"),
        F.when(F.col("o_orderkey") % 10 != 9, F.concat(F.lit("\\\\?\\C:/x/"), key)).alias("rollout_path"), (ms / 1000).cast("long").alias("created_at"), F.lit(None).cast("long").alias("created_at_ms"),
        F.lit(None).cast("long").alias("updated_at"), ms.alias("updated_at_ms"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("archived"))
    return threads.map_threads(rows).select("id", "title", "path", "updated_ms", "created_ms", "archived")


@query("a13_spawn_edge_rows", """SELECT 'p' || o_custkey AS parent_id, 'c' || o_orderkey AS child_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'unknown' END AS status FROM orders WHERE o_orderkey % 5 <> 0""")
def a13(spark, sf):
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("parent_thread_id"), F.when(key % 5 != 0, F.concat(F.lit("c"), key.cast("string"))).otherwise("").alias("child_thread_id"),
        F.when(key % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return threads.map_edges(rows)


@query("a16_file_names", """SELECT page_id, '00000000-0000-4000-8000-' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS session_id, 1704067200000 + (page_id % 60) * 1000 AS started_ms FROM pages""")
def a16(spark, sf):
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    second = F.lpad((F.col("page_id") % 60).cast("string"), 2, "0")
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("rollout-2024-01-01T00-00-"), second, F.lit("-"), uuid)).otherwise(F.concat(F.lit("2024-01-01T00-00-"), second, F.lit("-000Z_"), uuid))
    path = F.concat(F.lit("C:\\logs\\"), name, F.lit(".jsonl"))
    return table(spark, sf, "pages").select("page_id", logs.session_id_from_file(path).alias("session_id"), logs.session_start_from_file(path).alias("started_ms"))


@query("a17_legacy_ids", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 's' || page_id ELSE CASE page_id % 3 WHEN 1 THEN 'task-1:../s' || page_id ELSE 's' || page_id END END AS id FROM pages""")
def a17(spark, sf):
    n, key = F.col("page_id") % 3, F.concat(F.lit("s"), F.col("page_id").cast("string"))
    given = F.when(n == 0, F.concat(F.lit("task-1:"), key)).when(n == 1, F.concat(F.lit("task-1:../"), key)).otherwise(key)
    return table(spark, sf, "pages").select("page_id", logs.legacy_session_id(given).alias("id"))


@query("a18_path_mapping", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/new/home/sessions/' || page_id ELSE 'D:\\other\\' || page_id END AS path, CASE WHEN page_id % 2 = 0 THEN 'sessions/' || page_id ELSE 'D:/other/' || page_id END AS relative FROM pages""")
def a18(spark, sf):
    key = F.col("page_id").cast("string")
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\\\\?\\C:\\old\\sessions\\"), key)).otherwise(F.concat(F.lit("D:\\other\\"), key))
    mapped = logs.map_home_path(given, "/new/home", "C:\\old")
    return table(spark, sf, "pages").select("page_id", mapped.alias("path"), logs.relative_path(mapped, "/new/home").alias("relative"))


@query("a14_model_windows", """SELECT p_brand AS model, CAST(max(p_size) * 1000 AS BIGINT) AS context_window FROM part GROUP BY 1""")
def a14(spark, sf):
    """One document per brand: the same model id once per size, the largest last."""
    entry = F.to_json(F.struct(F.col("p_brand").alias("id"), (F.col("p_size") * 1000).alias("contextWindow")))
    distinct = table(spark, sf, "part").select("p_brand", "p_size").distinct().select("p_brand", F.col("p_size").alias("o"), entry.alias("e"))
    texts = distinct.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda x: x["e"]), ",").alias("all"))
    docs = texts.select(F.parse_json(F.concat(F.lit('{"providers":{"a":{"models":['), F.col("all"), F.lit("]}}}"))).alias("doc"))
    return logs.model_windows(docs)


@query("c5_user_echoes", """SELECT conv_id AS session_id, turn * 3 AS event_index FROM conversations WHERE role = 'user' AND trim(text) <> '' UNION ALL SELECT conv_id, turn * 3 + 2 FROM conversations WHERE role = 'user' AND trim(text) <> ''""")
def c5(spark, sf):
    """Every user row three times: as event message, as its response-item echo (dropped), and repeated as event message (kept)."""
    rows = table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    candidates = rows.select(
        "session_id", (F.col("turn") * 3 + F.col("k")).alias("event_index"), F.lit(0).alias("turn_seq"), F.lit(1000).alias("sub"), F.lit("user-message").alias("op"), F.col("text").alias("item_text"),
        F.lit(None).cast("string").alias("message_id"), F.when(F.col("k") == 1, "message").otherwise("user_message").alias("kind"), F.when(F.col("k") == 1, "response_item").otherwise("event_msg").alias("raw_type"), F.lit(False).alias("has_attachments"))
    return tn._keep_messages(candidates).select("session_id", "event_index")


@query("g2_trace_assembly", with_ctes(TOOL_INTERVALS_SQL, TURN_BOUNDS_SQL, """nodes AS (
  SELECT session_id, 'thread:' || session_id AS node_id, NULL AS parent_id, 'thread' AS type, min(lower_ms) AS start_ms, max(upper_ms) AS end_ms FROM turn_bounds GROUP BY session_id
  UNION ALL SELECT session_id, 'turn:' || turn_id, 'thread:' || session_id, 'turn', lower_ms, upper_ms FROM turn_bounds
  UNION ALL SELECT session_id, 'item:' || turn_id || ':' || line_no || ':c' || part_id || '-' || supplier_id, 'turn:' || turn_id, 'tool', start_ms, end_ms FROM tool_intervals WHERE bucket = 'tool_execution'
  UNION ALL SELECT session_id, 'response:' || turn_id || ':' || line_no || '-' || part_id || '-' || supplier_id, 'turn:' || turn_id, 'response', start_ms, end_ms FROM tool_intervals WHERE bucket = 'llm_wait' AND end_ms >= start_ms)""",
  """SELECT session_id, node_id, parent_id, type, CASE WHEN end_ms >= start_ms THEN end_ms - start_ms END AS duration_ms, row_number() OVER (PARTITION BY session_id, coalesce(parent_id, '') ORDER BY start_ms, node_id) - 1 AS position FROM nodes"""))
def g2(spark, sf):
    rows = tool_intervals(spark, sf)
    bounds = turn_bounds(rows)
    name = F.concat_ws("-", F.col("part_id").cast("string"), F.col("supplier_id").cast("string"))
    turns = bounds.select("session_id", F.col("turn_id").alias("turn_index"), F.lit("t").alias("title"), F.col("lower_ms").alias("start_ms"), F.col("upper_ms").alias("end_ms"), F.lit(None).cast("string").alias("status"))
    top = turns.groupBy("session_id").agg(F.lit("s").alias("title"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    items = rows.filter("bucket = 'tool_execution'").select(
        "session_id", F.col("turn_id").alias("turn_index"), F.col("line_no").alias("item_index"), F.lit("tool-call").alias("type"), F.col("tool").alias("name"), F.concat(F.lit("c"), name).alias("call_id"),
        F.lit(None).cast("string").alias("text"), F.col("start_ms").alias("ts_ms"), F.col("end_ms").alias("completed_ms"), F.lit("completed").alias("status"))
    responses = rows.filter("bucket = 'llm_wait' AND end_ms >= start_ms").select(
        "session_id", F.col("turn_id").alias("turn_index"), F.concat_ws("-", F.col("line_no").cast("string"), name).alias("response_id"), F.lit("m").alias("title"), "start_ms", "end_ms")
    children = turns.limit(0).select("session_id", F.lit("x").alias("child_id"), "title", "turn_index", "start_ms", "end_ms")
    none = turns.limit(0).select("session_id", "turn_index", F.lit(0).cast("long").alias("remainder_ms"))
    return trace.assemble_trace(top, turns, items, children, responses, none, TOOL_WIDTH_MS).select("session_id", "node_id", "parent_id", "type", "duration_ms", "position")


SPAWN_SQL = """calls AS (SELECT o_custkey AS session_id, o_orderkey AS event_index, epoch_ms(o_orderdate) AS ts_ms, 'agent' || (o_orderkey // 3) % 40 AS named FROM orders WHERE o_orderkey % 3 <> 2),
 kids AS (SELECT DISTINCT session_id, named AS child_id FROM calls WHERE event_index % 2 = 0)"""


SPAWN_ALL_SQL = SPAWN_SQL.replace(" WHERE o_orderkey % 3 <> 2", "")
LAST_SQL = "SELECT k.session_id, k.child_id, max(event_index) AS event_index FROM kids k JOIN calls c ON c.session_id = k.session_id AND c.named = k.child_id GROUP BY ALL"


@query("d7_spawn_matches_all", with_ctes(SPAWN_ALL_SQL, LAST_SQL))
def d7_all(spark, sf):
    """Every order is a call, none is left out."""
    return _spawn_case(table(spark, sf, "orders"))


@query("d7_spawn_matches", with_ctes(SPAWN_ALL_SQL, "x AS (SELECT *, substr(named, 6) AS no, event_index % 4 AS way FROM calls)", """
  SELECT k.session_id, k.child_id, coalesce(max(event_index) FILTER (way = 0), min(event_index)) AS event_index, coalesce(bool_or(way = 0), false) AS explicit
  FROM kids k JOIN x ON x.session_id = k.session_id AND x.named = k.child_id GROUP BY 1, 2"""))
def d7(spark, sf):
    """A quarter of the calls name their child by id; the others tell its nickname, role or title in their message."""
    key = F.col("o_orderkey")
    number = (F.floor(key / 3) % 40).cast("string")
    way = key % 4
    told = F.concat(F.lit("please ask <"), F.when(way == 1, "nick").when(way == 2, "role").otherwise("a title that is longer than a gram "), number, F.lit("> to go on"))
    calls = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), key.alias("event_index"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.lit("spawn_agent").alias("name"),
        F.when(way == 0, F.to_json(F.struct(F.concat(F.lit("agent"), number).alias("agent_id")))).when(way == 1, F.to_json(F.struct(told.alias("prompt")))).otherwise(F.to_json(F.struct(told.alias("message")))).alias("arguments"),
        number.alias("number"))
    name = lambda kind: F.concat(F.lit(f"<{kind}"), "number", F.lit(">"))
    kids = calls.filter("event_index % 2 = 0").select("session_id", "number").distinct().select(
        "session_id", F.concat(F.lit("agent"), "number").alias("child_id"), F.col("number").cast("int").alias("child_order"), name("nick").alias("nickname"), name("role").alias("role"),
        name("a title that is longer than a gram ").alias("title"))
    return trace.spawn_matches(calls, kids).select("session_id", "child_id", "event_index", "explicit")


def _spawn_case(orders):
    """Calls that name their child by id; the last one counts."""
    key = F.col("o_orderkey")
    named = F.concat(F.lit("agent"), (F.floor(key / 3) % 40).cast("string"))
    calls = orders.select(
        F.col("o_custkey").alias("session_id"), key.alias("event_index"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.lit("spawn_agent").alias("name"),
        F.to_json(F.struct(named.alias("agent_id"))).alias("arguments"), named.alias("named"))
    kids = calls.filter(F.col("event_index") % 2 == 0).select("session_id", F.col("named").alias("child_id")).distinct().select(
        "session_id", "child_id", F.lit(0).alias("child_order"), F.lit(None).cast("string").alias("nickname"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("title"))
    return trace.spawn_matches(calls, kids).select("session_id", "child_id", "event_index")


@query("d8_notification_matches", with_ctes(SPAWN_ALL_SQL, LAST_SQL.replace("k.child_id, max", "'<' || k.child_id || '>' AS child_id, max").replace("GROUP BY ALL", "GROUP BY k.session_id, k.child_id")))
def d8(spark, sf):
    """One log of both kinds: a child is told by a field of the notification or only inside its record's text."""
    key = F.col("o_orderkey")
    named = F.concat(F.lit("<agent"), (F.floor(key / 3) % 40).cast("string"), F.lit(">"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), key.alias("event_index"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), named.alias("named"))
    kids = rows.filter("event_index % 2 = 0").select("session_id", F.col("named").alias("child_id")).distinct()
    fielded = F.col("event_index") % 4 < 2
    events = rows.select(
        "session_id", "event_index", "ts_ms", F.when(fielded, F.to_json(F.struct(F.col("named").alias("agent_path")))).otherwise("see below").alias("text"),
        F.when(fielded, "x").otherwise(F.concat(F.lit("subagent_notification about "), "named")).alias("record"))
    return trace.notification_matches(events, kids).select("session_id", "child_id", "event_index")


@query("d8_notification_matches_all", with_ctes(SPAWN_ALL_SQL, LAST_SQL))
def d8_all(spark, sf):
    return _notification_case(table(spark, sf, "orders"))


def _notification_case(orders):
    """Half of the notifications carry the id as a field, half only inside their text."""
    key = F.col("o_orderkey")
    named = F.concat(F.lit("agent"), (F.floor(key / 3) % 40).cast("string"))
    rows = orders.select(F.col("o_custkey").alias("session_id"), key.alias("event_index"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), named.alias("named"))
    kids = rows.filter(F.col("event_index") % 2 == 0).select("session_id", F.col("named").alias("child_id")).distinct()
    fielded = F.to_json(F.struct(F.col("named").alias("agent_path")))
    events = rows.select("session_id", "event_index", "ts_ms", F.when(F.col("event_index") % 4 < 2, fielded).otherwise("see below").alias("text"),
                         F.concat(F.lit("subagent_notification about <"), "named", F.lit(">")).alias("record"))
    exact = kids.withColumn("child_id", F.col("child_id"))
    # Ids are wrapped in the text so that agent1 is not found inside agent12.
    by_text = trace.notification_matches(events.withColumn("text", F.lit("x")), exact.select("session_id", F.concat(F.lit("<"), "child_id", F.lit(">")).alias("child_id")))
    by_id = trace.notification_matches(events.withColumn("record", F.lit("x")), exact)
    plain = by_text.withColumn("child_id", F.regexp_replace("child_id", "[<>]", ""))
    return by_id.unionByName(plain).groupBy("session_id", "child_id").agg(F.max("event_index").alias("event_index"))


def _compaction_case(spark, sf):
    """Every conversation compacted once: its entries are the conversation's own messages, by id, by text or by role."""
    conv = table(spark, sf, "conversations").filter("role <> 'system'")
    items = conv.select(
        F.col("conv_id").alias("session_id"), F.lit(0).cast("long").alias("turn_index"), F.col("turn").alias("item_index"), F.when(F.col("role") == "user", "user-message").otherwise("assistant-message").alias("type"),
        "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("string").alias("output"),
        F.concat(F.lit("id"), F.col("turn").cast("string")).alias("message_id"), F.lit(0).cast("long").alias("ts_ms"))
    entries = conv.select(
        F.col("conv_id").alias("session_id"), F.lit(0).cast("long").alias("compact_turn"), F.lit(99).cast("long").alias("compact_event"), F.lit(0).cast("long").alias("compact_ms"), F.lit(None).cast("double").alias("window_number"),
        F.col("turn").alias("entry_index"), F.lit("message").alias("type"), "role", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("call_id"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("id"), F.col("turn").cast("string"))).alias("message_id"), F.lit("turn-1").alias("turn_id"), F.lit(None).cast("string").alias("timestamp"),
        F.array().cast("array<string>").alias("content_kinds"), F.col("text").alias("preview"), F.length("text").alias("text_length"))
    turns = conv.select(F.col("conv_id").alias("session_id")).distinct().select("session_id", F.lit(0).cast("long").alias("turn_index"), F.lit("turn-1").alias("turn_id"), F.lit("waiting").alias("status"))
    return items, entries, turns


TARGET_SQL = """c AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat, lower(text || ' id' || turn) AS hay FROM conversations WHERE role <> 'system'),
 n AS (SELECT conv_id, role, count(*) AS k, min(turn) AS lo, max(turn) AS hi FROM c GROUP BY ALL),
 t AS (SELECT e.conv_id AS session_id, e.turn AS entry_index, CASE WHEN e.turn % 2 = 0 THEN e.turn ELSE coalesce(
   (SELECT min(i.turn) FROM c i WHERE i.conv_id = e.conv_id AND i.role = e.role AND e.flat <> '' AND (contains(i.hay, e.flat) OR contains(e.flat, substr(i.hay, 1, 80)))),
   CASE WHEN n.k = 1 THEN n.lo WHEN e.role = 'assistant' THEN n.hi ELSE n.lo END) END AS item_index FROM c e JOIN n ON n.conv_id = e.conv_id AND n.role = e.role)"""


@query("d14_replacement_targets", with_ctes(TARGET_SQL, "SELECT session_id, entry_index, item_index FROM t"))
def d14(spark, sf):
    items, entries, turns = _compaction_case(spark, sf)
    return rd.entry_targets(rd.entry_turns(entries, turns), items).select("session_id", "entry_index", "item_index")


@query("d15_compression_references", with_ctes(TARGET_SQL, "SELECT session_id, item_index AS owner_index, entry_index FROM t"))
def d15(spark, sf):
    items, entries, turns = _compaction_case(spark, sf)
    targets = rd.entry_targets(rd.entry_turns(entries, turns), items)
    return rd.compression_references(targets, rd.owners(items)).select("session_id", "owner_index", "entry_index")


@query("d16_entry_turns", "SELECT conv_id AS session_id, turn AS entry_index, 1 AS turn_number, 'waiting' AS turn_status FROM conversations WHERE role <> 'system'")
def d16(spark, sf):
    _, entries, turns = _compaction_case(spark, sf)
    return rd.entry_turns(entries, turns).select("session_id", "entry_index", "turn_number", "turn_status")


@query("g3_child_nodes", with_ctes(SPAWN_ALL_SQL, """a AS (SELECT session_id, named AS child_id, max(ts_ms) FILTER (event_index % 4 = 1) AS spawn_ms, max(ts_ms) FILTER (event_index % 4 = 3) AS notice_ms FROM calls GROUP BY 1, 2)""",
  """SELECT session_id, v.p || child_id AS node_id, CASE v.kind WHEN 'lazy-child' THEN 'child:' || child_id END AS parent_id, v.kind AS type, coalesce(spawn_ms, notice_ms) AS anchor_ms
  FROM kids LEFT JOIN a USING (session_id, child_id), (VALUES ('child:', 'subagent'), ('lazy:', 'lazy-child')) v(p, kind)"""))
def g3(spark, sf):
    """Children with a spawn call, with a notification only, and with neither."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.concat(F.lit("agent"), (F.floor(key / 3) % 40).cast("string")).alias("child_id"), key.alias("event_index"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    kids = rows.filter("event_index % 2 = 0").select("session_id", "child_id", F.lit("t").alias("title")).distinct()
    latest = lambda n: rows.filter(f"event_index % 4 = {n}").groupBy("session_id", "child_id").agg(F.max_by("event_index", "ts_ms").alias("event_index"), F.max("ts_ms").alias("ts_ms"))
    return trace.child_nodes(kids, latest(1), latest(3)).select("session_id", "node_id", "parent_id", "type", "anchor_ms")
