"""Execution trace as an adjacency table: thread, turns, tools, children, responses, gaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seslog.functions.js import text_at
from seslog.functions.ordered import DAY_MS, ordered_scan, running_sum, time_block
from seslog.functions.staging import stage
from seslog.functions.text import first_line, nonempty, trim_space
from seslog.operators.contains import contained_names

HANDOFF_TOOLS = ("spawn_agent", "wait_agent", "handoff")
# Node types shown without a filter.
DEFAULT_ITEM_TYPES = ("tool", "handoff", "subagent", "embedded-subagent", "lazy-child", "skill")
NODE_COLUMNS = ("session_id", "node_id", "parent_id", "type", "title", "start_ms", "end_ms", "duration_ms", "status")


def item_nodes(items: DataFrame, default_only: bool = True) -> DataFrame:
    """One node per item, with its type, title and duration; by default only the types shown unfiltered."""
    type_, name, text = F.col("type"), F.col("name"), F.coalesce("text", F.lit(""))
    hand = F.coalesce(name.isin(*HANDOFF_TOOLS), F.lit(False))
    batch = F.coalesce(name == "subagent", F.lit(False))
    node = (
        F.when(type_.isin("user-message", "assistant-message"), "message")
        .when(type_ == "tool-call", F.when(batch, "embedded-subagent").when(hand, "handoff").otherwise("tool"))
        .when(type_ == "reasoning", "reasoning").when(type_ == "token-count", "metric").when(type_.isin("event", "response-item"), "event"))
    title = (
        F.when(type_ == "user-message", F.coalesce(nonempty(first_line(text)), F.lit("用户消息")))
        .when(type_ == "assistant-message", F.coalesce(nonempty(first_line(text)), F.lit("助手消息")))
        .when(type_ == "tool-call", F.coalesce(nonempty(name), "call_id", F.lit("未知工具")))
        .when(type_ == "reasoning", F.coalesce(nonempty(first_line(text)), F.lit("无明文摘要")))
        .when(type_ == "token-count", "上下文占用统计").otherwise(type_))
    start, end = F.col("ts_ms"), F.col("completed_ms")
    rows = items.select(
        "session_id",
        F.concat_ws(":", F.lit("item"), F.col("turn_index").cast("string"), F.col("item_index").cast("string"), F.coalesce("call_id", "type")).alias("node_id"),
        F.concat(F.lit("turn:"), F.col("turn_index").cast("string")).alias("parent_id"), node.alias("type"), title.alias("title"),
        start.alias("start_ms"), end.alias("end_ms"), F.when(end >= start, end - start).alias("duration_ms"), "status",
    ).filter("type IS NOT NULL")
    return rows.filter(F.col("type").isin(*DEFAULT_ITEM_TYPES)) if default_only else rows


def _nodes(df: DataFrame, kind: str, node_id: Column, parent: Column, title: Column, start: str, end: str, status=None) -> DataFrame:
    s, e = F.col(start), F.col(end)
    return df.select(
        "session_id", node_id.alias("node_id"), parent.alias("parent_id"), F.lit(kind).alias("type"), title.alias("title"),
        s.alias("start_ms"), e.alias("end_ms"), F.when(e >= s, e - s).alias("duration_ms"), (F.lit(None) if status is None else status).cast("string").alias("status"))


def assemble_trace(
    threads: DataFrame, turns: DataFrame, items: DataFrame, children: DataFrame, responses: DataFrame, remainders: DataFrame, width_ms: int = DAY_MS
) -> DataFrame:
    """All nodes with their parent and their place among its children by start time.

    threads: session_id, title, start_ms, end_ms. turns: turn_index, title, start_ms, end_ms, status. children:
    child_id, title, turn_index (NULL: below the thread), start_ms, end_ms. responses: turn_index, response_id, title,
    start_ms, end_ms. remainders: turn_index, remainder_ms.
    """
    root = F.concat(F.lit("thread:"), F.col("session_id").cast("string"))
    turn = F.concat(F.lit("turn:"), F.col("turn_index").cast("string"))
    none = F.lit(None).cast("string")
    tables = [
        _nodes(threads, "thread", root, none, F.col("title"), "start_ms", "end_ms"),
        _nodes(turns, "turn", turn, root, F.col("title"), "start_ms", "end_ms", F.col("status")),
        item_nodes(items).select(*NODE_COLUMNS),
        _nodes(children, "subagent", F.concat(F.lit("child:"), F.col("child_id").cast("string")), F.when(F.col("turn_index").isNull(), root).otherwise(turn),
               F.col("title"), "start_ms", "end_ms"),
        _nodes(responses, "response", F.concat(F.lit("response:"), F.col("turn_index").cast("string"), F.lit(":"), F.col("response_id").cast("string")), turn,
               F.col("title"), "start_ms", "end_ms"),
        remainders.select(
            "session_id", F.concat(F.lit("gap:"), F.col("turn_index").cast("string")).alias("node_id"), turn.alias("parent_id"), F.lit("gap").alias("type"),
            F.lit("gap").alias("title"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
            F.col("remainder_ms").alias("duration_ms"), none.alias("status")),
    ]
    nodes = tables[0]
    for other in tables[1:]:
        nodes = nodes.unionByName(other)
    return with_sibling_order(nodes, width_ms)


def with_sibling_order(nodes: DataFrame, width_ms: int = DAY_MS) -> DataFrame:
    """Position among the children of the same parent by start time, unknown times last, then by id."""
    keyed = nodes.withColumns({"__parent": F.coalesce("parent_id", F.lit("")), "__start": F.coalesce("start_ms", F.lit(2**61))})
    return ordered_scan(
        keyed, ["session_id", "__parent"], time_block("__start", width_ms), ["__start", "node_id"], position=running_sum(F.lit(1).cast("long"), before=True)
    ).drop("__parent", "__start")


# --- children: spawn calls and notifications ----------------------------------------------------------------------------
def _named_ids(arguments: Column) -> Column:
    return F.coalesce(*[nonempty(F.get_json_object(arguments, f"$.{k}")) for k in ("agent_id", "thread_id", "target")])


def spawn_matches(calls: DataFrame, children: DataFrame) -> DataFrame:
    """The spawn call of each child.

    A call that names the child's id wins (the last such call). Else the first call, in event order, whose message
    contains the child's nickname, role or title; a call without a known id serves one child at most, the first in
    child order that no earlier call has taken. ``calls``: session_id, event_index, ts_ms, name, arguments;
    ``children``: session_id, child_id, child_order, nickname, role, title.
    """
    named_id = _named_ids(F.col("arguments"))
    message = F.coalesce(nonempty(F.get_json_object("arguments", "$.message")), F.get_json_object("arguments", "$.prompt"), F.lit(""))
    known = children.select("session_id", F.col("child_id").alias("__named"), F.lit(True).alias("__known")).distinct()
    spawns = calls.filter("name = 'spawn_agent'").select("session_id", "event_index", "ts_ms", named_id.alias("__named"), message.alias("__message"))
    # read by several branches: arguments are parsed once
    tagged = stage(spawns.join(known, ["session_id", "__named"], "left"))
    explicit = tagged.filter("__known").groupBy("session_id", F.col("__named").alias("child_id")).agg(
        F.max("event_index").alias("event_index"), F.max_by("ts_ms", "event_index").alias("ts_ms"))
    loose = tagged.filter("__known IS NULL").select("session_id", "event_index", "ts_ms", "__message")
    named = children.select("session_id", "child_id", "child_order", F.explode(F.array_distinct(F.array_compact(F.array("nickname", "role", "title")))).alias("name")).filter("name <> ''")
    told = contained_names(loose.filter("__message <> ''"), named, "session_id", ["event_index"], "__message")
    guessed = _one_child_per_call(told.join(loose.drop("__message"), ["session_id", "event_index"]), named, explicit_early(tagged))
    rest = guessed.join(explicit.select("session_id", "child_id"), ["session_id", "child_id"], "left_anti")
    return explicit.withColumn("explicit", F.lit(True)).unionByName(rest.withColumn("explicit", F.lit(False)))


def explicit_early(tagged: DataFrame) -> DataFrame:
    """When each child was first named by id; later guesses leave it alone."""
    return tagged.filter("__known").groupBy("session_id", F.col("__named").alias("child_id")).agg(F.min("event_index").alias("__taken"))


def _one_child_per_call(told: DataFrame, named: DataFrame, taken: DataFrame) -> DataFrame:
    """Greedy assignment in call order: each call takes its first child not taken before.

    told: session_id, event_index, ts_ms, name (a name that the call's text holds); named: session_id, child_id,
    child_order, name. Which child is free depends on all earlier calls, so a session is folded in order, but over names,
    not over pairs: a name keeps its children in a queue whose taken ones are passed for good, so the fold takes as many
    steps as there are rows, also where every call and every child share a name. Sorted rows of many sessions come in one
    batch, as a call into Python for each session would cost more than its rows.
    """
    queues = named.join(taken, ["session_id", "child_id"], "left").select("session_id", F.lit(0).alias("side"), "name", F.col("child_order").cast("long").alias("child_order"), "child_id", "__taken")
    lines = told.select("session_id", F.lit(1).alias("side"), "name", "event_index", "ts_ms").unionByName(queues, allowMissingColumns=True)
    last = F.asc_nulls_last
    ordered = lines.repartition("session_id").sortWithinPartitions("session_id", "side", "event_index", last("child_order"), last("child_id")).select(
        "session_id", "name", "event_index", "ts_ms", "child_order", "child_id", "__taken")
    fields = lines.schema
    schema = StructType([fields[c] for c in ("session_id", "child_id", "event_index", "ts_ms")])

    def fold(batches):
        """Sessions one after another: the queues of a session, then its calls."""
        session, queue, at, used, event, best, ts = None, {}, {}, set(), None, None, None
        out = []
        for batch in batches:
            for key, name, index, time, order, child, taken in zip(*[column.to_pylist() for column in batch.columns]):
                if best is not None and (key != session or index != event):
                    used.add(best[1])
                    out.append((session, best[1], event, ts))
                    best = None
                if key != session:
                    session, queue, at, used, event = key, {}, {}, set(), None
                if index is None:
                    queue.setdefault(name, []).append(((order is None, order or 0, child is None, 0 if child is None else child), child, taken))
                    continue
                if index != event:
                    event, ts = index, time
                waiting, n = queue.get(name, ()), at.get(name, 0)
                while n < len(waiting) and (waiting[n][1] in used or (waiting[n][2] is not None and waiting[n][2] < event)):
                    n += 1
                at[name] = n
                if n < len(waiting) and (best is None or waiting[n][0] < best[0]):
                    best = waiting[n]
            types = [(c, batch.schema.field(c).type) for c in schema.names]
            if out:
                yield _record_batch(out, types)
                out = []
        if best is not None:
            yield _record_batch([(session, best[1], event, ts)], types)

    return ordered.mapInArrow(fold, schema)


def _record_batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), types)], names=[name for name, _ in types])


# The keys under which a notification names its agent.
NOTICE_KEYS = ("agent_path", "agentPath", "agent_id", "agentId", "thread_id", "threadId")


def notification_payload(text: Column) -> Column:
    """The notification object of a text: bare JSON or inside its tag; NULL for other texts."""
    trimmed = trim_space(F.coalesce(text, F.lit("")))
    wrapped = trim_space(F.regexp_extract(trimmed, r"(?is)<subagent_notification>\s*(.*?)\s*</subagent_notification>", 1))
    parsed = F.transform(F.array(trimmed, wrapped), lambda t: F.struct(t.alias("text"), F.try_parse_json(F.when(t.startswith("{"), t)).alias("doc")))

    def usable(doc: Column) -> Column:
        named = F.coalesce(*[nonempty(text_at(doc, k)) for k in NOTICE_KEYS]).isNotNull()
        return F.coalesce(doc.isNotNull() & (named | (text_at(doc, "type") == "subagent_notification")), F.lit(False))

    return F.get(F.filter(parsed, lambda x: usable(x["doc"])), 0)["text"]


def notification_matches(events: DataFrame, children: DataFrame) -> DataFrame:
    """The last notification of each child: by an id in the notification, else by the child id inside the record's text.

    ``events``: session_id, event_index, ts_ms, text, record (preview and payload as text).
    """
    payload = F.coalesce(notification_payload(F.col("text")), notification_payload(F.col("record")))
    ids = F.array_distinct(F.array_compact(F.array(*[nonempty(trim_space(text_at(F.col("__doc"), k))) for k in NOTICE_KEYS])))
    told = F.when(F.col("record").rlike("(?i)subagent_notification|agent_path"), F.col("record"))
    # Read by several branches, which would each repeat the large expressions: records are parsed once.
    rows = stage(events.select("session_id", "event_index", "ts_ms", "record", F.try_parse_json(payload).alias("__doc")).select(
        "session_id", "event_index", "ts_ms", told.alias("__told"), F.coalesce(ids, F.array().cast("array<string>")).alias("__ids")))
    by_id = stage(rows.select("session_id", "event_index", "ts_ms", F.explode("__ids").alias("child_id")).join(
        children.select("session_id", "child_id"), ["session_id", "child_id"]))
    loose = rows.filter("__told IS NOT NULL").join(by_id.select("session_id", "event_index").distinct(), ["session_id", "event_index"], "left_anti")
    found = contained_names(loose, children, "session_id", ["event_index"], "__told", "child_id")
    by_text = found.join(loose.select("session_id", "event_index", "ts_ms"), ["session_id", "event_index"]).select("session_id", "event_index", "ts_ms", "child_id")
    return by_id.select("session_id", "event_index", "ts_ms", "child_id").unionByName(by_text).groupBy("session_id", "child_id").agg(
        F.max("event_index").alias("event_index"), F.max_by("ts_ms", "event_index").alias("ts_ms"))


def notification_summary(payload: Column) -> Column:
    """State and first body text of a notification object (JSON text)."""
    # Fixed values below: the words that tell a state, and the places of a body, in order.
    doc = F.try_parse_json(payload)
    own = lambda k: F.try_variant_get(doc, f"$.{k}", "variant")
    nested = lambda k: F.try_variant_get(doc, f"$.status.{k}", "variant")
    present = lambda v: v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))
    scalar = lambda path: F.when(~F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant")).rlike("^(OBJECT|ARRAY)"), text_at(doc, path))
    words = F.concat_ws(" ", *[scalar(p) for p in ("status", "state", "phase", "status.state", "status.status", "status.phase")])
    state = (
        F.when(present(nested("completed")) | present(own("completed")) | words.rlike("(?i)completed|done|success|succeeded|完成|成功"), "completed")
        .when(present(nested("failed")) | present(nested("error")) | present(own("failed")) | present(own("error"))
              | words.rlike("(?i)failed|failure|error|cancelled|canceled|aborted|失败|错误|取消|中断"), "failed")
        .when(words.rlike("(?i)running|pending|started|in[-_ ]?progress|waiting|运行|等待|处理中"), "running").otherwise("unknown"))
    places = [f"status.{k}" for k in ("completed", "failed", "error", "message", "summary")] + [
        "completed", "failed", "error", "message", "summary", "output", "result"]
    text = lambda p: F.when(text_at(doc, p) != "false", nonempty(trim_space(text_at(doc, p))))
    body = F.coalesce(*[text(p) for p in places], F.lit(""))
    agent = F.coalesce(*[nonempty(trim_space(text_at(doc, k))) for k in NOTICE_KEYS])
    return F.struct(state.alias("state"), agent.alias("agent_id"), body.alias("body"), F.length(body).alias("body_length"))


def child_nodes(children: DataFrame, spawns: DataFrame, notices: DataFrame) -> DataFrame:
    """Each child thread with its anchor (spawn call before notification) and a placeholder for its own content."""
    s = spawns.select("session_id", "child_id", F.col("event_index").alias("spawn_event"), F.col("ts_ms").alias("spawn_ms"))
    n = notices.select("session_id", "child_id", F.col("event_index").alias("notice_event"), F.col("ts_ms").alias("notice_ms"))
    joined = children.join(s, ["session_id", "child_id"], "left").join(n, ["session_id", "child_id"], "left")
    child = F.concat(F.lit("child:"), F.col("child_id"))
    anchor = F.coalesce("spawn_ms", "notice_ms")
    nodes = F.array(
        F.struct(child.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("subagent").alias("type")),
        F.struct(F.concat(F.lit("lazy:"), F.col("child_id")).alias("node_id"), child.alias("parent_id"), F.lit("lazy-child").alias("type")))
    return joined.select("session_id", "child_id", "title", anchor.alias("anchor_ms"), "spawn_ms", "notice_ms", F.inline(nodes))


# --- embedded sub-agents and skills -----------------------------------------------------------------------------------------
def _stripped(value: Column) -> Column:
    return nonempty(trim_space(value))


def embedded_requests(calls: DataFrame) -> DataFrame:
    """Requested tasks of sub-agent calls: the tasks array, or the call itself as its only task."""
    doc = F.try_parse_json("arguments")
    tasks = F.try_variant_get(doc, "$.tasks", "array<variant>")
    listed = F.when(F.size(tasks) > 0, tasks).otherwise(F.array(doc))
    rows = calls.filter("name = 'subagent'").select("session_id", "call_id", F.posexplode(listed).alias("task_index", "__t"))
    agent, task = _stripped(text_at(F.col("__t"), "agent")), _stripped(text_at(F.col("__t"), "task"))
    return rows.select("session_id", "call_id", "task_index", agent.alias("__a"), task.alias("task")).filter("__a IS NOT NULL OR task IS NOT NULL").select(
        "session_id", "call_id", "task_index", F.coalesce("__a", F.lit("未指定代理")).alias("agent"), "task")


def _message_error(m: Column) -> Column:
    error = F.try_variant_get(m, "$.error", "variant")
    plain = F.when(F.schema_of_variant(error) == "STRING", text_at(m, "error"))
    return F.coalesce(_stripped(text_at(m, "errorMessage")), _stripped(text_at(m, "error.message")), _stripped(plain))


def embedded_results(calls: DataFrame) -> DataFrame:
    """Results of sub-agent calls with a status each: rate_limited, failed, succeeded, invalid_request or unknown."""
    doc = F.try_parse_json("details")
    results = F.try_variant_get(doc, "$.results", "array<variant>")
    rows = calls.filter("name = 'subagent' AND output IS NOT NULL").withColumn("__rs", F.coalesce(results, F.array().cast("array<variant>")))
    r = F.col("__r")
    some = rows.filter(F.size("__rs") > 0).select("session_id", "call_id", F.posexplode("__rs").alias("task_index", "__r"))
    messages = F.reverse(F.coalesce(F.try_variant_get(r, "$.messages", "array<variant>"), F.array().cast("array<variant>")))
    failure = F.coalesce(_message_error(r), F.get(F.array_compact(F.transform(messages, _message_error)), 0))
    code = text_at(r, "exitCode").try_cast("double")
    stop = _stripped(text_at(r, "stopReason"))
    status = (
        F.when(failure.isNotNull(), F.when(failure.rlike(r"(?i)(?:^|\D)429(?:\D|$)|rate.?limit"), "rate_limited").otherwise("failed"))
        .when((stop == "error") | (code != 0), "failed").when((code == 0) | (stop == "stop"), "succeeded").otherwise("unknown"))
    said = F.transform(
        F.filter(messages, lambda m: text_at(m, "role") == "assistant"),
        lambda m: F.get(F.array_compact(F.transform(
            F.filter(F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda p: text_at(p, "type") == "text"),
            lambda p: _stripped(text_at(p, "text")))), 0))
    given = some.select(
        "session_id", "call_id", "task_index", F.coalesce(_stripped(text_at(r, "agent")), F.lit("未指定代理")).alias("agent"), status.alias("status"),
        F.coalesce(failure, F.get(F.array_compact(said), 0), F.lit("")).alias("summary"))
    text = trim_space(F.col("output"))
    invalid = text.rlike(r"(?i)^Invalid parameters\.")
    none = rows.filter((F.size("__rs") == 0) & (invalid | (F.col("status") == "failed"))).select(
        "session_id", "call_id", F.lit(0).alias("task_index"), F.lit("未指定代理").alias("agent"),
        F.when(invalid, "invalid_request").otherwise("failed").alias("status"), text.alias("summary"))
    return given.unionByName(none)


def embedded_batches(results: DataFrame) -> DataFrame:
    """Batch status: the common status of its results, or 'partial'."""
    return results.groupBy("session_id", "call_id").agg(
        F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("partial").alias("status"), F.count(F.lit(1)).alias("results"))


def request_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests and results of a batch side by side by their index."""
    q = requests.select("session_id", "call_id", "task_index", F.col("agent").alias("requested_agent"), "task")
    r = results.select("session_id", "call_id", "task_index", F.col("agent").alias("result_agent"), "status", "summary")
    return q.join(r, ["session_id", "call_id", "task_index"], "full_outer").withColumn("status", F.coalesce("status", F.lit("pending")))


def skill_declaration(text: Column) -> Column:
    """Name, location, instruction and user text of a message that opens with a skill block."""
    pattern = r"(?s)^\s*<skill\s+([^>]+)>(.*?)</skill>(.*)$"
    attributes = F.regexp_extract(text, pattern, 1)
    attribute = lambda n: _stripped(F.regexp_extract(attributes, rf'(?:^|\s){n}="([^"]+)"(?:\s|$)', 1))
    found = text.rlike(pattern) & attribute("name").isNotNull() & attribute("location").isNotNull()
    return F.when(found, F.struct(
        attribute("name").alias("name"), F.regexp_replace(F.replace(attribute("location"), F.lit("\\"), F.lit("/")), "/+$", "").alias("location"),
        trim_space(F.regexp_extract(text, pattern, 2)).alias("instruction"), trim_space(F.regexp_extract(text, pattern, 3)).alias("user_text")))


def skill_read(name: Column, arguments: Column) -> Column:
    """Skill name hint and path where a read call opens a SKILL.md."""
    path = F.regexp_replace(F.replace(trim_space(F.coalesce(F.get_json_object(arguments, "$.path"), F.lit(""))), F.lit("\\"), F.lit("/")), "/+$", "")
    parts = F.split(path, "/")
    is_skill = (name == "read") & (F.lower(F.element_at(parts, -1)) == "skill.md")
    return F.when(F.coalesce(is_skill, F.lit(False)), F.struct(nonempty(F.get(parts, F.size(parts) - 2)).alias("skill"), path.alias("location")))


def skill_read_state(output: Column, status: Column) -> Column:
    return F.when(output.isNull(), "attempted").when(status == "failed", "failed").otherwise("confirmed")


