"""Session rows: metadata from the log, titles, parent links, assembly from index, metadata and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import field, text_at
from seslog.functions.text import first_nonempty, nonempty, normalize_text, strip_long_path_prefix
from seslog.sources.logs import session_id_from_file, session_start_from_file

UNTITLED = "未命名会话"


def first_where(value: Column, condition: Column, order: str = "event_index") -> Column:
    """Aggregate: the value of the first row that meets the condition."""
    return F.min_by(value, F.when(condition, F.col(order)))


def last_where(value: Column, condition: Column, order: str = "event_index") -> Column:
    return F.max_by(value, F.when(condition, F.col(order)))


def session_metadata(events: DataFrame) -> DataFrame:
    """Header facts of each session: the first dialect that has any wins, in the order generic, message, uuid."""
    raw, payload, kind = F.col("raw"), F.col("payload"), F.col("raw_type")
    get = lambda v, k: text_at(v, k)
    header, claude = kind == "session_meta", F.col("format") == "claude-code"
    generic = F.struct(
        get(payload, "title").alias("title"), get(payload, "cwd").alias("cwd"), get(payload, "timestamp").alias("timestamp"),
        first_nonempty(get(payload, "model"), get(payload, "modelId"), get(payload, "model_provider")).alias("model"),
        get(payload, "model_provider").alias("model_provider"),
        first_nonempty(get(payload, "reasoning_effort"), get(payload, "reasoningEffort")).alias("reasoning_effort"),
        get(payload, "originator").alias("originator"), get(payload, "source").alias("source"),
        get(payload, "thread_source").alias("thread_source"),
        F.coalesce(get(payload, "parent_session"), get(payload, "parentSession")).alias("parent_session"),
    )
    one = events.groupBy("session_id").agg(
        first_where(generic, header).alias("g"),
        first_where(F.struct(get(raw, "cwd").alias("cwd"), get(raw, "timestamp").alias("timestamp"), get(raw, "parentSession").alias("parent")), kind == "session").alias("ps"),
        first_where(get(raw, "name"), kind == "session_info").alias("pn"),
        last_where(F.struct(F.coalesce(get(raw, "modelId"), get(raw, "model")).alias("model"), get(raw, "provider").alias("provider")), kind == "model_change").alias("pm"),
        last_where(get(raw, "thinkingLevel"), kind == "thinking_level_change").alias("pt"),
        F.max(kind.isin("session", "session_info", "model_change", "thinking_level_change")).alias("has_pi"),
        first_where(get(raw, "cwd"), claude & get(raw, "cwd").isNotNull()).alias("cc"),
        first_where(get(raw, "model"), claude & get(raw, "model").isNotNull()).alias("cm"),
        first_where(get(raw, "timestamp"), claude & get(raw, "timestamp").isNotNull()).alias("ct"),
    )
    none = F.lit(None).cast("string")
    pi = F.struct(
        F.col("pn").alias("title"), F.col("ps.cwd").alias("cwd"), F.col("ps.timestamp").alias("timestamp"), F.col("pm.model").alias("model"),
        F.col("pm.provider").alias("model_provider"), F.col("pt").alias("reasoning_effort"), F.lit("pi_agent").alias("originator"),
        F.lit("pi-agent").alias("source"), none.alias("thread_source"), F.col("ps.parent").alias("parent_session"),
    )
    uuid = F.struct(
        none.alias("title"), F.col("cc").alias("cwd"), F.col("ct").alias("timestamp"), F.col("cm").alias("model"), none.alias("model_provider"),
        none.alias("reasoning_effort"), F.lit("claude_code").alias("originator"), F.lit("claude-code").alias("source"),
        none.alias("thread_source"), none.alias("parent_session"),
    )
    chosen = F.coalesce(F.col("g"), F.when(F.col("has_pi"), pi), F.when(F.col("ct").isNotNull(), uuid))
    return one.select("session_id", chosen.alias("m")).select("session_id", "m.*")


def session_titles(events: DataFrame) -> DataFrame:
    """First explicit name, else the first useful user text; NULL where there is neither."""
    user = (F.col("kind") == "user_message") | ((F.col("semantic_kind") == "message") & (F.col("role") == "user"))
    named = (F.col("raw_type") == "session_info") & nonempty(F.col("info_name")).isNotNull()
    asked = user & nonempty(F.col("user_text")).isNotNull()
    return events.groupBy("session_id").agg(
        F.coalesce(
            first_where(normalize_text(F.col("info_name")), F.coalesce(named, F.lit(False))),
            first_where(normalize_text(F.col("user_text")), F.coalesce(asked, F.lit(False))),
        ).alias("title"))


def parent_session_id(parent_path: Column) -> Column:
    return F.when(nonempty(parent_path).isNotNull(), nonempty(session_id_from_file(parent_path)))


def assemble_sessions(files: DataFrame, metadata: DataFrame, titles: DataFrame, index: DataFrame | None, status: DataFrame) -> DataFrame:
    """One row per log file's session: index entry before metadata before what the file itself tells."""
    rows = files.join(metadata.withColumnRenamed("title", "__meta_title"), "session_id", "left").join(
        titles.withColumnRenamed("title", "__event_title"), "session_id", "left").join(status, "session_id", "left")
    if index is not None:
        named = index.select(F.col("id").alias("session_id"), F.coalesce(nonempty(F.col("name")), F.lit(UNTITLED)).alias("__name"),
                             F.unix_millis(F.col("updated_at").try_cast("timestamp")).alias("__updated"))
        rows = rows.join(named, "session_id", "left")
    else:
        rows = rows.withColumns({"__name": F.lit(None).cast("string"), "__updated": F.lit(None).cast("long")})
    stem = F.regexp_extract("file_path", r"([^/\\]+?)(?:\.jsonl)?$", 1)
    return rows.select(
        F.col("session_id").alias("id"),
        first_nonempty(F.col("__name"), F.col("__meta_title"), F.col("__event_title"), stem).alias("title"),
        nonempty(strip_long_path_prefix(F.col("cwd"))).alias("cwd"), nonempty(F.col("originator")).alias("originator"),
        nonempty(F.col("model")).alias("model"), nonempty(F.col("reasoning_effort")).alias("reasoning_effort"),
        nonempty(F.col("source")).alias("source"), nonempty(F.col("thread_source")).alias("thread_source"),
        nonempty(F.col("model_provider")).alias("model_provider"), parent_session_id(F.col("parent_session")).alias("parent_session_id"),
        "archived", "status", F.col("file_path").alias("path"),
        F.coalesce(F.unix_millis(F.col("timestamp").try_cast("timestamp")), session_start_from_file(F.col("file_path"))).alias("started_ms"),
        F.coalesce("__updated", "mtime_ms").alias("updated_ms"), F.col("file_size").alias("size_bytes"), F.col("mtime_ms").alias("file_modified_ms"),
    )


def spawn_source(source: Column) -> Column:
    """Parent thread and agent names inside a session's JSON source; NULL where it is no spawned thread."""
    doc = F.try_parse_json(source)
    spawn = F.coalesce(*[field(doc, p) for p in ("subagent.thread_spawn", "subagent.threadSpawn", "thread_spawn", "threadSpawn")])
    sub = field(doc, "subagent")
    pick = lambda v, *keys: F.coalesce(*[nonempty(text_at(v, k)) for k in keys])
    return F.when(spawn.isNotNull(), F.struct(
        pick(spawn, "parent_thread_id", "parentThreadId", "parent_id", "parentId").alias("parent_id"),
        F.coalesce(pick(spawn, "agent_nickname", "agentNickname"), pick(sub, "agent_nickname", "agentNickname")).alias("agent_nickname"),
        F.coalesce(pick(spawn, "agent_role", "agentRole"), pick(sub, "agent_role", "agentRole")).alias("agent_role"),
    ))


def all_edges(sessions: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored spawn edges and those told by the sessions' own source field."""
    own = sessions.withColumn("__s", spawn_source(F.col("source"))).filter("__s.parent_id IS NOT NULL").select(
        F.col("__s.parent_id").alias("parent_id"), F.col("id").alias("child_id"), F.lit("unknown").alias("status"))
    return stored.select("parent_id", "child_id", "status").unionByName(own)


def correct_titles(sessions: DataFrame, objectives: DataFrame, opening: str) -> DataFrame:
    """Titles and previews that are a control packet (start with ``opening``) show the session's objective instead."""
    rows = sessions.join(objectives.select("id", F.col("objective")), "id", "left")
    fixed = {
        c: F.when(F.coalesce(F.col(c).startswith(opening), F.lit(False)) & F.col("objective").isNotNull(), F.col("objective")).otherwise(F.col(c))
        for c in ("title", "preview") if c in sessions.columns
    }
    return rows.withColumns(fixed).drop("objective")


