"""raw_events -> events: one flat, stable row per log record, whatever dialect wrote it.

Everything here is a narrow projection. Candidate values under drifting key names are put into arrays in order of
preference and the first usable one is taken, which keeps the generated code small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import (
    as_array, field, first_number, is_array, is_object, kind_of, nonempty_text, number, raw_field, scalar_text, string_only,
    text_at, text_of, time_millis,
)
from seslog.functions.memo import build_once
from seslog.functions.redact import (
    clean_user_text, data_bytes, data_media, is_data_uri, redact_data_uris, redact_json,
)
from seslog.functions.text import first_line, joined_text, nonempty, trim_space

# Record and payload type names of the logs.
TOOL_CALL_KINDS = ("function_call", "tool_search_call", "custom_tool_call")
TOOL_RESULT_KINDS = (
    "function_call_output", "tool_search_output", "custom_tool_call_output", "mcp_tool_call_end", "patch_apply_end",
)
IMPORTANT_KINDS = (
    "session_meta", "user_message", "agent_message", "message", "function_call", "function_call_output", "custom_tool_call",
    "custom_tool_call_output", "mcp_tool_call_end", "patch_apply_end", "tool_search_call", "tool_search_output",
    "task_started", "task_complete", "task_failed", "turn_aborted", "compacted", "context_compacted", "compaction",
    "jsonl_parse_error",
)
KIND_TITLES = {
    "meta": "会话元信息", "session_meta": "会话元信息", "turn_context": "轮次上下文", "user_message": "用户消息",
    "agent_message": "助手消息", "message": "消息", "token_count": "上下文占用统计", "task_started": "任务开始",
    "task_complete": "任务完成", "task_failed": "任务失败", "turn_aborted": "轮次已中断",
    "subagent_notification": "子代理回执", "compacted": "上下文已压缩", "context_compacted": "上下文压缩完成",
    "compaction": "Pi 上下文压缩", "jsonl_parse_error": "事件解析失败",
}
ROLE_TITLES = {"user": "用户消息", "assistant": "助手消息", "system": "系统消息", "tool": "工具消息"}
USAGE_PLACES = (
    ("payload", "last_token_usage"), ("payload", "lastTokenUsage"), ("payload", "usage"),
    ("payload", "info.last_token_usage"), ("payload", "info.lastTokenUsage"), ("raw", "usage"), ("raw", "message.usage"),
)
USAGE_KEYS = {
    "output": ("output_tokens", "outputTokens", "completion_tokens", "completionTokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoningOutputTokens", "reasoning_tokens", "reasoningTokens", "reasoning"),
    "input": ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "input"),
    "total": ("total_tokens", "totalTokens"),
    "cache_read": ("cache_read_tokens", "cacheReadTokens", "cacheRead"),
    "cache_write": ("cache_write_tokens", "cacheWriteTokens", "cacheWrite"),
    "cost": ("cost", "costUsd", "cost_usd"),
}
IMAGE_KEYS = ("image_url", "image_file", "images", "local_images", "attachments")


def _no_variants() -> Column:
    return F.array().cast("array<variant>")


def elements(value: Column) -> Column:
    """The elements of a JSON array; an empty array for anything else."""
    return F.coalesce(as_array(value), _no_variants())


def _first(*values: Column) -> Column:
    """First value that is not null (an empty text stops the search)."""
    return F.coalesce(*values)


def _lookup(value: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def classify_kind(raw_type: Column, payload_type: Column, role: Column) -> Column:
    """Stable kind from the record type, the payload type and the role."""
    enveloped = raw_type.isin("event_msg", "response_item")
    source = F.when(F.coalesce(enveloped, F.lit(False)), payload_type).otherwise(F.coalesce(payload_type, raw_type))
    renamed = _lookup(source, {
        "function_result": "function_call_output", "tool_result": "function_call_output", "tool_call": "function_call",
        "system": "meta", "user": "user_message", "assistant": "agent_message",
    })
    by_role = _lookup(role, {
        "user": "user_message", "assistant": "agent_message", "system": "meta", "developer": "meta",
    })
    return (
        F.when(raw_type == "session_meta", "meta").when(raw_type == "turn_context", "context")
        .when(raw_type == "jsonl_parse_error", "jsonl_parse_error")
        .when(source.isNotNull(), F.coalesce(renamed, source))
        .otherwise(F.coalesce(by_role, F.lit("unknown")))
    )


def classify_semantic(kind: Column, role: Column) -> Column:
    system = F.coalesce(role.isin("system", "developer"), F.lit(False))
    spoken = F.coalesce(role.isin("user", "assistant"), F.lit(False))
    return (
        F.when(kind == "jsonl_parse_error", "diagnostic").when(kind.isin(*TOOL_CALL_KINDS), "tool_call")
        .when(kind.isin(*TOOL_RESULT_KINDS), "tool_result").when(kind == "reasoning", "reasoning")
        .when(system | (kind == "meta"), "meta")
        .when(kind.isin("user_message", "agent_message", "message") | spoken, "message").otherwise("event")
    )


def is_important(kind: Column) -> Column:
    return kind.isin(*IMPORTANT_KINDS)


def normalize_role(role: Column) -> Column:
    text = nonempty(role)
    return F.when(text == "toolResult", "tool").otherwise(text)


def content_text(content: Column, keys: tuple[str, ...]) -> Column:
    """Texts of content parts (or of one bare part), joined by blank lines."""
    parts = F.when(is_array(content), as_array(content)).otherwise(F.array(content))
    texts = F.transform(
        F.array_compact(parts),
        lambda p: F.when(is_object(p), _first(*[scalar_text(field(p, k)) for k in keys])).otherwise(string_only(p)),
    )
    return F.array_join(F.filter(F.array_compact(texts), lambda t: t != ""), "\n\n")


def _argument_text(value: Column) -> Column:
    """Arguments as text: a string as it is, anything else as JSON, inline data and encrypted content redacted."""
    return F.when(F.schema_of_variant(value) == "STRING", redact_data_uris(text_of(value))).otherwise(
        redact_json(F.to_json(value))
    )


# --- layers -----------------------------------------------------------------------------------------------------------
def _dialect(df: DataFrame) -> DataFrame:
    """Dialect, payload and the values a dialect puts over its payload."""
    raw = F.col("raw")
    df = df.withColumns({
        "raw_type": nonempty(text_at(raw, "type")),
        "__message": F.when(is_object(field(raw, "message")), field(raw, "message")),
    })
    has_message = F.col("__message").isNotNull()
    claude = (
        F.col("raw_type").isin("user", "assistant") & has_message
        & (F.schema_of_variant(field(raw, "uuid")) == "STRING") & (F.schema_of_variant(field(raw, "sessionId")) == "STRING")
        & raw_field(raw, "parentUuid").isNotNull()
    )
    fmt = F.when((F.col("raw_type") == "message") & has_message, "pi-agent").when(claude, "claude-code").otherwise("generic")
    nested = field(raw, "payload")
    df = df.withColumn("format", F.coalesce(fmt, F.lit("generic")))
    payload = F.when(F.col("format") != "generic", F.col("__message")).when(is_object(nested), nested).otherwise(raw)
    return df.withColumns({
        "payload": payload,
        "__nested": (F.col("format") != "generic") | F.coalesce(is_object(nested), F.lit(False)),
        "__content": F.when(F.col("format") != "generic", field(F.col("__message"), "content")).otherwise(field(payload, "content")),
    })


def _overlay(df: DataFrame) -> DataFrame:
    raw, payload, message = F.col("raw"), F.col("payload"), F.col("__message")
    pi, claude = F.col("format") == "pi-agent", F.col("format") == "claude-code"
    results = F.filter(elements(F.col("__content")), lambda p: text_at(p, "type") == "tool_result")
    said = F.lower(F.coalesce(text_at(message, "role"), F.lit("")))
    pi_role = F.when(said.isin("toolresult", "tool"), "tool").otherwise(nonempty(said))
    df = df.withColumns({
        "tool_results": F.when(claude, F.transform(results, _tool_result)).otherwise(F.array().cast(TOOL_RESULT_TYPE)),
        "__pi_role": F.when(pi, pi_role),
    })
    only_results = claude & (F.size("tool_results") > 0) & (F.size("tool_results") == F.size(elements(F.col("__content"))))
    df = df.withColumn("__tool_record", (pi & F.coalesce(F.col("__pi_role") == "tool", F.lit(False))) | only_results)
    tool = F.col("__tool_record")
    generic_role = _first(text_at(payload, "role"), text_at(raw, "role"), text_at(raw, "message.role"))
    role = (
        F.when(claude & tool, "tool").when(claude, _first(string_only(field(message, "role")), F.col("raw_type")))
        .when(pi, _first(F.col("__pi_role"), text_at(raw, "role"), text_at(message, "role"))).otherwise(generic_role)
    )
    first_result = F.get("tool_results", 0)
    return df.withColumns({
        "payload_type": F.when(F.col("format") == "generic", nonempty(text_at(payload, "type")))
        .when(tool, "function_call_output").otherwise("message"),
        "role": normalize_role(role),
        "__call_id": F.when(pi & tool, _first(*[text_at(message, k) for k in ("toolCallId", "call_id", "callId")]))
        .when(claude & tool, first_result["call_id"]).otherwise(text_at(payload, "call_id")),
        "__id": F.when(pi, _first(text_at(message, "id"), text_at(raw, "id"))).otherwise(text_at(payload, "id")),
        "__success": F.when(pi & tool, field(message, "isError").cast("boolean") == False)  # noqa: E712
        .when(claude & tool, first_result["success"]).otherwise(F.try_variant_get(payload, "$.success", "boolean")),
        "__output": F.when(pi & tool, content_text(field(message, "content"), ("text", "value", "output")))
        .when(claude & tool, first_result["output"]),
        "__name": F.when(pi & tool, _first(text_at(message, "toolName"), text_at(message, "name"))),
    })


TOOL_RESULT_TYPE = "array<struct<call_id:string,output:string,success:boolean>>"
TOOL_CALL_TYPE = "array<struct<call_id:string,name:string,arguments:string>>"


def _tool_result(part: Column) -> Column:
    content = field(part, "content")
    output = F.when(is_array(content) | (F.schema_of_variant(content) == "STRING"), content_text(content, ("text", "value")))
    failed = (text_at(part, "is_error") == "true") | (text_at(part, "isError") == "true")
    return F.struct(
        nonempty(string_only(_first(field(part, "tool_use_id"), field(part, "toolUseId")))).alias("call_id"),
        nonempty(F.coalesce(output, F.to_json(content), F.lit(""))).alias("output"),
        (~F.coalesce(failed, F.lit(False))).alias("success"),
    )


def _tool_call(part: Column) -> Column:
    used = text_at(part, "type") == "tool_use"
    names = lambda *keys: nonempty_text(_first(*[field(part, k) for k in keys]))
    own = _first(field(part, "arguments"), field(part, "input"), field(part, "args"))
    return F.struct(
        F.when(used, nonempty(string_only(field(part, "id")))).otherwise(names("id", "call_id", "callId")).alias("call_id"),
        F.when(used, nonempty(string_only(field(part, "name")))).otherwise(names("name", "toolName", "tool")).alias("name"),
        _argument_text(F.when(used, field(part, "input")).otherwise(own)).alias("arguments"),
    )


@build_once
def tool_calls() -> Column:
    """Tool calls inside the content of a message."""
    kind = lambda p: text_at(p, "type")
    wanted = lambda p: (kind(p) == "toolCall") | ((kind(p) == "tool_use") & (F.col("format") == "claude-code"))
    return F.transform(F.filter(elements(F.col("__content")), wanted), _tool_call)


@build_once
def record_time() -> Column:
    return time_millis(F.col("raw"))


def _identity(df: DataFrame) -> DataFrame:
    raw, payload = F.col("raw"), F.col("payload")
    pi, claude = F.col("format") == "pi-agent", F.col("format") == "claude-code"
    tool = F.col("__tool_record")
    get = lambda value, key: text_at(value, key)
    adapted = F.when(
        pi, F.when(tool, _first(get(payload, "message_id"), F.col("__id")))
        .otherwise(_first(get(payload, "message_id"), get(raw, "id"), F.col("__id")))
    ).when(claude, get(raw, "uuid"))
    adapted_parent = F.when(pi, _first(get(payload, "parent_id"), get(raw, "parent_id"), get(raw, "parentId"))).when(
        claude, get(raw, "parentUuid")
    )
    delta_index = _first(field(raw, "delta_index"), field(payload, "delta_index"))
    flag = _first(field(raw, "delta"), field(raw, "chunk"), field(payload, "delta"), field(payload, "chunk"))
    truthy = F.when(flag.isNull(), delta_index.isNotNull()).otherwise(~text_of(flag).isin("", "0", "false"))
    return df.withColumns({
        "message_id": nonempty(_first(adapted, get(raw, "message_id"), get(raw, "id"), get(payload, "message_id"), F.col("__id"))),
        "parent_id": nonempty(_first(
            adapted_parent, get(raw, "parent_id"), get(raw, "parentId"), get(payload, "parent_id"), get(payload, "parentId"))),
        "call_id": nonempty(_first(F.col("__call_id"), get(raw, "call_id"), F.col("__id"), get(raw, "id"))),
        "turn_id": nonempty(get(payload, "turn_id")),
        "is_delta": truthy,
        "delta_index": number(delta_index),
        "kind": classify_kind(F.col("raw_type"), F.col("payload_type"), F.col("role")),
        "ts_ms": record_time(),
    }).withColumn("semantic_kind", classify_semantic(F.col("kind"), F.col("role")))


@build_once
def text_parts() -> Column:
    """Texts of a record in source order: content parts, then the payload's and the record's own text fields."""
    raw, payload, content = F.col("raw"), F.col("payload"), F.col("__content")
    summary = F.transform(elements(field(payload, "summary")), _part_text)
    listed = F.transform(elements(content), _part_text)
    single = F.array(F.when(~is_array(content), scalar_text(content)))
    own = F.array(*[scalar_text(field(payload, k)) for k in ("text", "message", "value", "last_agent_message")])
    outer = F.when(
        F.col("__nested"), F.array(*[scalar_text(field(raw, k)) for k in ("text", "message", "value")])
    ).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("payload_type") == "reasoning", summary).otherwise(F.concat(listed, single, own, outer))
    return F.filter(F.transform(F.array_compact(found), redact_data_uris), lambda t: t != "")


def _part_text(part: Column) -> Column:
    return F.when(is_object(part), scalar_text(_first(field(part, "text"), field(part, "value")))).otherwise(string_only(part))


@build_once
def token_usage() -> Column:
    """First place with usable output tokens; counts are rounded, generated = output + reasoning."""
    places = F.array(*[field(F.col(base), path) for base, path in USAGE_PLACES])
    rounded = lambda s, key: F.floor(first_number(s, USAGE_KEYS[key]) + 0.5).cast("bigint")
    usages = F.transform(
        F.filter(F.array_compact(places), is_object),
        lambda s: F.struct(
            rounded(s, "output").alias("output_tokens"),
            F.coalesce(rounded(s, "reasoning"), F.lit(0).cast("bigint")).alias("reasoning_tokens"),
            rounded(s, "input").alias("input_tokens"), rounded(s, "total").alias("total_tokens"),
            rounded(s, "cache_read").alias("cache_read_tokens"), rounded(s, "cache_write").alias("cache_write_tokens"),
            F.coalesce(first_number(s, USAGE_KEYS["cost"]), first_number(s, ("cost.total",))).alias("cost"),
        ),
    )
    best = F.get(F.filter(usages, lambda u: u["output_tokens"].isNotNull()), 0)
    return F.when(
        best.isNotNull(), best.withField("generated_tokens", best["output_tokens"] + best["reasoning_tokens"])
    )


@build_once
def attachments() -> Column:
    """Images and files a record carries: from content parts, then five keys of the payload, then of the record."""
    raw, payload = F.col("raw"), F.col("payload")
    entry = lambda value, source: F.struct(value.alias("v"), F.lit(source).alias("s"))
    from_parts = F.flatten(F.transform(
        F.filter(elements(F.col("__content")), is_object),
        lambda p: F.array(
            entry(field(p, "image_url"), "content.image_url"), entry(field(p, "image_file"), "content.image_file"),
            entry(F.when(text_at(p, "type") == "input_image", field(p, "url")), "content.url"),
        ),
    ))

    def listed(base: Column, name: str, key: str) -> Column:
        value = field(base, key)
        return F.transform(F.coalesce(as_array(value), F.array(value)), lambda v: entry(v, f"{name}.{key}"))

    values = [from_parts] + [listed(payload, "payload", k) for k in IMAGE_KEYS]
    outer = F.concat(*[listed(raw, "raw", k) for k in IMAGE_KEYS])
    everything = F.concat(*values, F.when(F.col("__nested"), outer).otherwise(F.array().cast("array<struct<v:variant,s:string>>")))
    references = F.filter(F.transform(everything, _image_reference), lambda r: r.isNotNull())
    return references


def _image_reference(e: Column) -> Column:
    value, source = e["v"], e["s"]
    url = F.when(F.schema_of_variant(value) == "STRING", text_of(value)).otherwise(nonempty(text_at(value, "url")))
    file_id = _first(nonempty(text_at(value, "file_id")), nonempty(text_at(value, "id")))
    path = nonempty(text_at(value, "path"))
    last = lambda p: F.coalesce(nonempty(F.element_at(F.split(p, r"[\\/]"), -1)), F.lit("file"))

    def row(kind: str, label: Column, media=None, size=None, link=None, fid=None, place=None, redacted=False) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), source.alias("source"), (none if media is None else media).alias("media_type"),
            (F.lit(None) if size is None else size).cast("bigint").alias("byte_length"),
            (none if link is None else link).alias("url"), (none if fid is None else fid).alias("file_id"),
            (none if place is None else place).alias("path"), label.alias("label"), F.lit(redacted).alias("redacted"),
        )

    size = data_bytes(url)
    inline_label = F.concat(
        F.lit("inline "), data_media(url), F.when(size > 0, F.concat(F.lit(" "), size.cast("string"), F.lit(" bytes"))).otherwise("")
    )
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("url"))
    return (
        F.when(value.isNull() | (url == ""), None)
        .when(is_data_uri(url), row("inline", inline_label, media=data_media(url), size=size, redacted=True))
        .when(url.rlike("(?i)^https?://"), row("url", F.concat(F.lit("remote image "), host), link=url))
        .when(url.isNotNull(), row("file", F.concat(F.lit("local image "), last(url)), place=url))
        .when(~is_object(value), None)
        .when(file_id.isNotNull(), row("file", F.concat(F.lit("file image "), F.substring(file_id, 1, 24)), fid=file_id))
        .when(path.isNotNull(), row("file", F.concat(F.lit("local image "), last(path)), place=path))
        .otherwise(row("unknown", F.lit("image attachment")))
    )


@build_once
def reasoning() -> Column:
    """Summary of a reasoning record and whether (and how long) its content is encrypted."""
    raw, payload = F.col("raw"), F.col("payload")
    thinking = F.get(
        F.filter(elements(field(raw, "message.content")), lambda p: text_at(p, "type") == "thinking"), 0
    )
    source = F.when(F.col("payload_type") == "reasoning", payload).when(
        is_object(field(raw, "reasoning")), field(raw, "reasoning")
    ).otherwise(thinking)
    encrypted = text_of(_first(
        field(source, "encrypted_content"), field(payload, "encrypted_content"), field(raw, "encrypted_content"),
        field(source, "thinkingSignature"),
    ))
    lines = F.filter(F.array_compact(F.transform(elements(field(source, "summary")), _part_text)), lambda t: t != "")
    summary = F.coalesce(string_only(field(source, "thinking")), F.array_join(lines, "\n"), F.lit(""))
    return F.when(
        source.isNotNull() | (F.col("semantic_kind") == "reasoning"),
        F.struct(
            encrypted.isNotNull().alias("encrypted"), F.coalesce(F.length(encrypted), F.lit(0)).alias("encrypted_length"),
            summary.alias("summary"),
        ),
    )


# Fixed value: how deep the reference walks a history value; what lies deeper gives no text.
HISTORY_DEPTH = 4


def _entry_text(value: Column, depth: int = 0) -> Column:
    """Readable text of one history value: texts of parts, images and encrypted content as markers.

    Elements of arrays are joined as they are, fields of objects without repeats.
    """
    hidden = F.when(field(value, "encrypted_content").isNotNull(), "[encrypted_content redacted]").when(
        nonempty_text(_first(field(value, "image_url"), field(value, "image_file"))).isNotNull()
        | (text_at(value, "type") == "input_image"), "[image]",
    )
    scalar = scalar_text(value)
    if depth == HISTORY_DEPTH:
        return F.when(value.isNull(), "").otherwise(F.coalesce(scalar, F.when(is_object(value), hidden), F.lit("")))
    # The keys under which a history value carries text, in order.
    keys = ("text", "value", "message", "content", "summary", "output", "input", "arguments")
    inside = F.when(is_array(value), elements(value)).otherwise(F.array_compact(F.array(*[field(value, k) for k in keys])))
    # one branch for both kinds, so that the expression grows with the depth and does not double at each level
    numbered = F.transform(inside, lambda v, i: F.struct(F.when(is_array(value), i).otherwise(-1).alias("i"), _entry_text(v, depth + 1).alias("t")))
    inner = F.array_join(F.transform(F.array_distinct(F.filter(numbered, lambda x: x["t"] != "")), lambda x: x["t"]), "\n")
    return F.when(value.isNull(), "").otherwise(F.coalesce(scalar, F.when(is_object(value), hidden), inner, F.lit("")))


# The same of a history entry.
HISTORY_KEYS = ("content", "message", "text", "value", "output", "arguments")


def _history_entry(entry: Column, index: Column) -> Column:
    meta = field(entry, "internal_chat_message_metadata_passthrough")
    pick = lambda *keys: nonempty_text(_first(*[field(entry, k) for k in keys]))
    texts = F.transform(
        F.array_compact(F.array(*[field(entry, k) for k in HISTORY_KEYS])), lambda v: _entry_text(v)
    )
    whole = F.when(is_object(entry), F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")).otherwise(_entry_text(entry))
    preview = trim_space(redact_data_uris(F.coalesce(whole, F.lit(""))))
    content = field(entry, "content")
    kinds = F.transform(elements(content), lambda p: F.when(is_object(p), nonempty(text_at(p, "type"))).otherwise(kind_of(p)))
    return F.struct(
        (index + 1).alias("index"), F.coalesce(pick("type"), kind_of(entry)).alias("type"), pick("role").alias("role"),
        pick("name").alias("name"), pick("call_id", "callId").alias("call_id"),
        pick("message_id", "messageId", "id").alias("message_id"),
        nonempty_text(_first(field(entry, "turn_id"), field(entry, "turnId"), field(meta, "turn_id"), field(meta, "turnId"))).alias("turn_id"),
        nonempty_text(_first(
            field(entry, "timestamp"), field(entry, "created_at"), field(entry, "createdAt"), field(meta, "timestamp")
        )).alias("timestamp"),
        F.array_distinct(F.array_compact(kinds)).alias("content_kinds"),
        F.when(is_array(content), F.size(as_array(content))).alias("content_parts"),
        preview.alias("preview"), F.length(preview).alias("text_length"),
    )


@build_once
def compaction() -> Column:
    """Context-compaction record of either dialect, with a preview of every replaced history entry."""
    raw, payload = F.col("raw"), F.col("payload")
    both = lambda *keys: _first(*[field(base, k) for base in (payload, raw) for k in keys])
    is_pi = F.col("raw_type") == "compaction"
    is_generic = F.col("kind").isin("compacted", "context_compacted")
    history = F.coalesce(as_array(field(payload, "replacement_history")), as_array(field(raw, "replacement_history")), _no_variants())
    message = F.when(is_pi, nonempty(text_at(raw, "summary"))).otherwise(nonempty_text(both("message")))
    generic = F.when(~is_pi, F.lit(True))
    tail = F.when(is_pi, F.size(elements(field(raw, "retainedTail"))))
    return F.when(
        is_pi | is_generic,
        F.struct(
            F.when(is_pi, "pi_compaction").otherwise(F.col("kind")).alias("kind"),
            F.when(~is_pi & (F.col("kind") == "context_compacted"), "completed").otherwise("summary").alias("phase"),
            message.alias("message"), F.coalesce(F.length(message), F.lit(0)).alias("message_length"),
            F.when(generic, F.size(history)).alias("history_count"),
            F.when(generic, F.transform(history, _history_entry)).alias("history"),
            F.when(generic, number(both("window_number", "windowNumber"))).alias("window_number"),
            F.when(generic, nonempty_text(both("first_window_id", "firstWindowId"))).alias("first_window_id"),
            F.when(generic, nonempty_text(both("previous_window_id", "previousWindowId"))).alias("previous_window_id"),
            F.when(generic, nonempty_text(both("window_id", "windowId"))).alias("window_id"),
            F.when(is_pi, number(field(raw, "tokensBefore"))).alias("tokens_before"), tail.alias("retained_tail_count"),
            F.when(is_pi, nonempty(text_at(raw, "firstKeptEntryId"))).alias("first_kept_entry_id"),
            F.when(is_pi, F.coalesce(text_at(raw, "fromHook") == "true", F.lit(False))).alias("from_hook"),
        ),
    )


@build_once
def tool_name() -> Column:
    payload = F.col("payload")
    truthy = lambda path: nonempty(text_at(payload, path))
    invocation = nonempty(F.concat_ws(".", truthy("invocation.server"), truthy("invocation.tool")))
    return F.coalesce(
        truthy("tool"), nonempty(F.col("__name")), truthy("name"), truthy("function.name"), truthy("execution"), invocation,
        F.when(F.col("payload_type") == "patch_apply_end", "apply_patch"), F.col("payload_type"), F.lit("tool"),
    )


@build_once
def tool_input() -> Column:
    payload = F.col("payload")
    value = _first(*[field(payload, k) for k in ("arguments", "function.arguments", "arguments_json", "input", "invocation.arguments")])
    changes = field(payload, "changes")
    return F.coalesce(
        _argument_text(value), F.when(changes.isNotNull(), F.concat(F.lit('{"changes":'), redact_json(F.to_json(changes)), F.lit("}")))
    )


@build_once
def tool_output() -> Column:
    payload = F.col("payload")
    streams = joined_text(text_at(payload, "stdout"), text_at(payload, "stderr"))
    result = field(payload, "result")
    ok = as_array(field(result, "Ok.content"))
    parts = F.array_join(
        F.filter(F.transform(ok, lambda p: F.coalesce(text_at(p, "text"), F.to_json(p))), lambda t: t != ""), "\n\n"
    )
    rendered = F.when(ok.isNotNull(), parts).otherwise(F.to_json(_first(field(result, "Err"), result)))
    verdict = F.when(F.col("__success"), "Success").when(~F.col("__success"), "Failed")
    own = F.coalesce(F.col("__output"), _argument_text(field(payload, "output")))
    return redact_data_uris(F.coalesce(nonempty(streams), F.when(result.isNotNull(), rendered), own, verdict))


@build_once
def search_text() -> Column:
    user = (F.col("role") == "user") | (F.col("kind") == "user_message")
    said = F.when(F.coalesce(user, F.lit(False)), clean_user_text(F.col("text"))).otherwise(F.col("text"))
    compact = F.col("compact")
    hint = F.coalesce(
        nonempty(F.col("reasoning.summary")), F.when(F.col("reasoning.encrypted"), "encrypted reasoning present"), F.lit("")
    )
    calls = F.flatten(F.transform("tool_calls", lambda c: F.array(c["name"], c["arguments"])))
    window = F.when(compact["window_number"] != 0, F.regexp_replace(compact["window_number"].cast("string"), r"\.0$", ""))
    history = F.flatten(F.transform(
        compact["history"],
        lambda e: F.array(e["type"], e["role"], e["name"], e["turn_id"], e["message_id"], e["preview"]),
    ))
    head = F.array(
        F.col("kind"), F.col("semantic_kind"), F.col("role"), F.col("raw_type"), F.col("payload_type"), said,
        F.col("tool_name"), F.col("tool_input"), F.col("tool_output"),
    )
    tail = F.array(
        F.array_join(F.transform("attachments", lambda a: a["label"]), "\n"), hint, compact["kind"], compact["phase"],
        compact["message"], window, compact["window_id"], compact["previous_window_id"], compact["first_window_id"],
    )
    none = F.array().cast("array<string>")
    pieces = F.concat(head, F.coalesce(calls, none), tail, F.coalesce(history, none))
    return redact_data_uris(F.array_join(F.filter(F.array_compact(pieces), lambda t: t != ""), "\n"))


def with_detail(title: str, detail: Column) -> Column:
    text = nonempty(trim_space(F.coalesce(detail, F.lit(""))))
    return F.when(text.isNull(), title).otherwise(F.concat(F.lit(f"{title}："), text))


@build_once
def event_title() -> Column:
    kind, semantic, raw_type, ptype = (F.col(c) for c in ("kind", "semantic_kind", "raw_type", "payload_type"))
    known = _lookup(kind, KIND_TITLES)
    enveloped = F.coalesce(raw_type.isin("event_msg", "response_item"), F.lit(False))
    role_title = F.coalesce(_lookup(F.col("role"), ROLE_TITLES), F.lit("消息"))
    compact = _lookup(F.col("compact.kind"), {
        "compacted": "上下文已压缩", "context_compacted": "上下文压缩完成", "pi_compaction": "Pi 上下文压缩",
    })
    return (
        F.when(semantic == "diagnostic", "事件解析失败").when(compact.isNotNull(), compact)
        .when(semantic == "tool_call", with_detail("调用工具", F.coalesce(nonempty(F.col("tool_name")), F.lit("未知工具"))))
        .when(semantic == "tool_result",
              with_detail("工具输出", F.coalesce(nonempty(F.col("tool_name")), F.col("call_id"), F.lit("未知工具"))))
        .when(~enveloped & known.isNotNull(), known)
        .when(raw_type == "session_meta", "会话元信息").when(raw_type == "turn_context", with_detail("轮次上下文", F.col("turn_id")))
        .when(raw_type == "event_msg", F.coalesce(_lookup(ptype, KIND_TITLES), with_detail("事件", ptype)))
        .when((raw_type == "response_item") & (ptype == "message"), role_title)
        .when((raw_type == "response_item") & (ptype == "reasoning"), "推理项")
        .when(raw_type == "response_item", with_detail("响应项", ptype)).otherwise(with_detail("事件", raw_type))
    )


@build_once
def event_preview() -> Column:
    compact = F.col("compact")
    window = F.regexp_replace(compact["window_number"].cast("string"), r"\.0$", "")
    prefix = F.concat_ws(
        " · ", F.lit("压缩摘要"), F.concat(F.lit("窗口 "), window),
        F.when(compact["history_count"] > 0, F.concat(compact["history_count"].cast("string"), F.lit(" 条替换历史"))),
    )
    before = F.regexp_replace(compact["tokens_before"].cast("string"), r"\.0$", "")
    pi_prefix = F.coalesce(F.concat(F.lit("压缩前 "), before, F.lit(" tokens")), F.lit("Pi 上下文压缩"))
    labels = nonempty(F.array_join(F.transform("attachments", lambda a: a["label"]), ", "))
    user = F.coalesce((F.col("role") == "user") | (F.col("kind") == "user_message"), F.lit(False))
    hidden = F.when(F.col("reasoning.encrypted"), F.concat(
        F.lit("加密推理内容（"), F.col("reasoning.encrypted_length").cast("string"), F.lit(" 字符）")))
    last = nonempty(redact_data_uris(text_at(F.col("payload"), "stdout")))
    other = F.coalesce(
        nonempty(F.col("text")), nonempty(F.col("tool_input")), nonempty(F.col("tool_output")), labels, hidden,
        nonempty(F.col("diagnostic.preview")), last, F.lit(""),
    )
    return first_line(
        F.when(compact["kind"] == "compacted", F.concat_ws("：", prefix, nonempty(compact["message"])))
        .when(compact["kind"] == "context_compacted", "上下文压缩完成，后续轮次将使用已压缩事件写入的替换摘要。")
        .when(compact["kind"] == "pi_compaction", F.concat_ws("：", pi_prefix, nonempty(compact["message"])))
        .when(user, F.coalesce(nonempty(clean_user_text(F.col("text"))), labels, F.lit(""))).otherwise(other)
    )


EVENT_COLUMNS = (
    "format", "raw", "payload", "raw_type", "payload_type", "kind", "semantic_kind", "role", "ts_ms", "message_id",
    "parent_id", "call_id", "turn_id", "is_delta", "delta_index", "text", "text_parts", "tool_name", "tool_input",
    "tool_output", "success", "tool_calls", "tool_results", "attachments", "reasoning", "token_usage", "compact", "encrypted",
    "payload_size", "raw_size", "diagnostic", "search_text", "important", "title", "preview",
)


def normalize(raw_events: DataFrame) -> DataFrame:
    """events from raw_events (columns line_number, raw, is_valid, preview and any keys, which are kept)."""
    keys = [c for c in raw_events.columns if c not in ("raw", "is_valid", "error_code", "preview", "line")]
    empty = F.try_parse_json(F.lit("{}"))
    bad = F.parse_json(F.lit('{"type":"jsonl_parse_error","payload":{"type":"jsonl_parse_error"}}'))
    df = raw_events.withColumn("__preview", F.col("preview")).withColumn(
        "raw", F.when(~F.col("is_valid"), bad).when(is_object(F.col("raw")), F.col("raw")).otherwise(empty)
    )
    df = _identity(_overlay(_dialect(df)))
    semantic = F.col("semantic_kind")
    diagnostic = semantic == "diagnostic"
    preview = redact_data_uris(F.coalesce("__preview", F.lit("")))
    df = df.withColumns({
        "text_parts": F.when(diagnostic, F.filter(F.array(preview), lambda t: t != "")).otherwise(text_parts()),
        "tool_name": F.when(semantic.isin("tool_call", "tool_result"), tool_name()),
        "tool_input": F.when(semantic == "tool_call", tool_input()),
        "tool_output": F.when(semantic == "tool_result", tool_output()),
        "success": F.col("__success"),
        "tool_calls": tool_calls(),
        "attachments": attachments(),
        "reasoning": reasoning(),
        "token_usage": token_usage(),
        "compact": compaction(),
        "payload_size": F.coalesce(F.length(F.to_json(field(F.col("raw"), "payload"))), F.lit(0)),
        "raw_size": F.length(F.to_json("raw")),
        "diagnostic": F.when(diagnostic, F.struct(
            F.col("line_number"), F.lit("invalid-json").alias("code"), F.lit("Invalid JSONL row").alias("message"),
            preview.alias("preview"))),
    })
    df = df.withColumns({
        "text": F.array_join("text_parts", "\n\n"),
        "encrypted": F.coalesce(F.col("reasoning.encrypted"), F.lit(False)),
        "important": is_important(F.col("kind")),
    })
    df = df.withColumns({"search_text": search_text(), "title": event_title(), "preview": event_preview()})
    return df.select(*keys, *EVENT_COLUMNS)
