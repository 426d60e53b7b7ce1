"""Reading projections and content filters over events, items and turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import DAY_MS, EVENTS_PER_BLOCK, event_block, last_value, next_value, ordered_scan, running_max, running_sum, time_block
from seslog.functions.staging import stage
from seslog.functions.text import contains_text, first_line, nonempty, normalize_text
from seslog.operators.contains import contained_names
from seslog.operators.stats import ERROR_WORDS
from seslog.operators.trace import skill_declaration, skill_read

TURN = ["session_id", "turn_index"]
# The item types a replaced entry may stand for, and how much of an item's text its entry has to hold.
TARGET_TYPES = ("user-message", "assistant-message", "tool-call", "reasoning")
SAME_BEGIN = 80
TURN_FILTERS = ("all", "message", "tool", "compact", "skill", "system", "error")


def _words(*columns: str) -> Column:
    return F.concat_ws(" ", *[nonempty(F.col(c)) for c in columns])


def event_filter(events: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Diagnostic event filter by type and text; ``record`` is the whole record as text."""
    compact = F.col("kind").isin("compacted", "context_compacted")
    conditions = {
        "message": F.col("kind").isin("user_message", "agent_message") | F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)),
        "tool": _words("kind", "raw_type", "payload_type").rlike("(?i)tool|call|function|mcp|patch"),
        "output": _words("kind", "raw_type", "payload_type", "title").rlike("(?i)output|result"),
        "reasoning": _words("kind", "raw_type", "payload_type").rlike("(?i)reasoning"),
        "compact": compact,
        "skill": _words("preview", "title").rlike(r"(?i)<skill[\s>]|SKILL\.md"),
        "system": F.col("kind").isin("system", "token_count", "session_meta") | compact,
        "error": F.col("record").rlike(ERROR_WORDS),
    }
    rows = events if kind not in conditions else events.filter(conditions[kind])
    return rows.filter(F.lower("record").contains(text.lower())) if text else rows


def item_filter(items: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Item filter by type and text."""
    type_ = F.col("type")
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", "text", "name", "call_id", "status", "arguments", "output")]))
    conditions = {
        "message": type_.isin("user-message", "assistant-message"), "tool": type_.isin("tool-call", "response-item"),
        "output": (type_ == "tool-call") & nonempty(F.col("output")).isNotNull(), "reasoning": type_ == "reasoning",
        "compact": type_ == "context-compact", "system": type_.isin("event", "token-count", "context-compact"),
        "error": haystack.rlike(ERROR_WORDS),
    }
    if "skill" in items.columns:
        conditions["skill"] = F.col("skill").isNotNull()
    rows = items if kind not in conditions else items.filter(conditions[kind])
    return rows.filter(haystack.contains(text.lower())) if text else rows


def query_events(
    events: DataFrame, *, important: bool | None = None, kinds: Sequence[str] = (), types: Sequence[str] = (),
    payload_types: Sequence[str] = (), roles: Sequence[str] = (), since: int | None = None, until: int | None = None, text: str | None = None,
) -> DataFrame:
    """Event query: all set conditions hold, time bounds are inclusive, text is a normalized substring."""
    rows = events
    if important is not None:
        rows = rows.filter(F.col("important") == important)
    for column, wanted in (("kind", kinds), ("raw_type", types), ("payload_type", payload_types), ("role", roles)):
        if wanted:
            rows = rows.filter(F.coalesce(column, F.lit("")).isin(*wanted))
    if since is not None:
        rows = rows.filter(F.col("ts_ms") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts_ms") <= until)
    return rows.filter(contains_text(F.col("search_text"), text)) if text else rows


def event_source(items: DataFrame, events: DataFrame) -> DataFrame:
    """Each item with its source event: by index, else by output index, else the first event that looks like it.

    The fallback compares kind and the first 80 characters of an event at the item's time.
    """
    slim = events.select("session_id", "event_index", "kind", "ts_ms", "preview", "title")
    known = slim.select("session_id", F.col("event_index").alias("source_index"), F.lit(True).alias("__hit"))
    tagged = items.join(known, ["session_id", "source_index"], "left")
    direct = tagged.filter("__hit").withColumn("event_index", F.col("source_index")).drop("__hit")
    rest = tagged.filter("__hit IS NULL").drop("__hit")
    short = lambda c: F.substring(normalize_text(c), 1, 80)
    left, right = short(F.col("e.preview")), short(F.col("i.text"))
    same = (left != "") & (right != "") & (F.contains(left, right) | F.contains(right, left))
    type_, kind = F.col("i.type"), F.col("e.kind")
    fits = (
        ((type_ == "user-message") & kind.isin("user_message", "message") & same)
        | ((type_ == "assistant-message") & kind.isin("agent_message", "message", "task_complete") & same)
        | ((type_ == "token-count") & (kind == "token_count"))
        | ((type_ == "tool-call") & kind.contains("call") & F.contains(F.coalesce("e.title", "e.preview", F.lit("")), F.col("i.name")))
    )
    matched = rest.alias("i").join(slim.alias("e"), (F.col("i.session_id") == F.col("e.session_id")) & (F.col("i.ts_ms") == F.col("e.ts_ms")) & fits)
    best = matched.groupBy("i.session_id", "i.turn_index", "i.item_index").agg(F.min("e.event_index").alias("event_index"))
    return direct.unionByName(rest.join(best, ["session_id", "turn_index", "item_index"], "left"))


def turn_metrics(items: DataFrame) -> DataFrame:
    """Per turn: context usage at its end and tokens generated (NULL if none)."""
    usage = F.max_by("context_usage", F.when((F.col("type") == "token-count") & F.col("context_usage").isNotNull(), F.col("item_index")))
    return items.groupBy(*TURN).agg(
        usage.alias("ending_usage"), F.nullif(F.sum("token_usage.generated_tokens"), F.lit(0)).alias("generated_tokens"))


def item_rows(items: DataFrame) -> DataFrame:
    """Item reading rows with lengths."""
    size = lambda c: F.length(c)
    return items.select(
        *TURN, "item_index", "type", "source_index", "ts_ms", "text", size("text").alias("text_length"),
        size("arguments").alias("arguments_length"), size("output").alias("output_length"))


def turn_rows(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn reading rows: how many user and assistant messages, the last answer, context events."""
    said = lambda kind: (F.col("type") == kind) & (normalize_text(F.col("text")) != "")
    facts = items.groupBy(*TURN).agg(
        F.count_if(said("user-message")).alias("user_messages"), F.count_if(said("assistant-message")).alias("assistant_messages"),
        F.max_by("text", F.when(said("assistant-message"), F.col("item_index"))).alias("last_answer"),
        F.count_if(F.col("type") == "context-compact").alias("compactions"))
    return turns.join(facts, TURN, "left").fillna(0, ["user_messages", "assistant_messages", "compactions"])


def turn_messages(items: DataFrame) -> DataFrame:
    """Messages of each turn in order, one row each (a turn may hold very many)."""
    kept = items.filter(F.col("type").isin("user-message", "assistant-message") & (normalize_text(F.col("text")) != ""))
    return kept.select(*TURN, "item_index", "type", "text", F.length("text").alias("text_length"))


def turn_titles(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Title of each turn and where it comes from: user text, hand-off, tool names, answer or status."""
    title = clean_turn_title(F.col("text"))
    index = F.col("item_index")
    useful = (title != "") & ~title.rlike(r"(?i)^(#?\s*AGENTS\.md instructions|In app browser:|Files mentioned by the user:)")
    notice = F.regexp_extract(F.coalesce("text", F.lit("")), r'"agent_path"\s*:\s*"([^"]+)"', 1)
    user, answer = F.col("type") == "user-message", F.col("type") == "assistant-message"
    hand = (F.col("type") == "tool-call") & F.col("name").isin("spawn_agent", "wait_agent", "handoff")
    target = F.coalesce(*[nonempty(F.get_json_object("arguments", f"$.{k}")) for k in ("agent_id", "thread_id", "target")], F.col("name"))
    hand_text = F.concat(F.when(F.col("name") == "wait_agent", "等待子代理：").otherwise("委派子代理："), target)
    # Distinct names with their first place: bounded by the number of tools, not of calls.
    names = items.filter((F.col("type") == "tool-call") & nonempty(F.col("name")).isNotNull()).groupBy(*TURN, "name").agg(F.min("item_index").alias("first"))
    listed = names.groupBy(*TURN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ", ").alias("__tools"))
    facts = items.groupBy(*TURN).agg(
        F.min_by(notice, F.when(user & (notice != ""), index)).alias("__notice"), F.min_by(title, F.when(user & useful, index)).alias("__user"),
        F.min_by(hand_text, F.when(hand, index)).alias("__hand"), F.min_by(title, F.when(answer & useful, index)).alias("__answer"))
    rows = turns.join(facts, TURN, "left").join(listed, TURN, "left")
    noted, asked, handed = F.col("__notice").isNotNull(), F.col("__user").isNotNull(), F.col("__hand").isNotNull()
    tools, said = F.col("__tools").isNotNull(), F.col("__answer").isNotNull()
    return rows.select(
        *TURN,
        first_line(F.when(noted, F.concat(F.lit("子代理回执："), F.col("__notice"))).when(asked, F.col("__user")).when(handed, F.col("__hand"))
                   .when(tools, F.concat(F.lit("工具执行："), F.col("__tools"))).when(said, F.col("__answer"))
                   .otherwise(F.coalesce("status", F.lit("turn")))).alias("title"),
        F.when(noted, "subagent-notification").when(asked, "user-message").when(handed, "handoff").when(tools, "tool-call")
        .when(said, "assistant-message").otherwise("fallback").alias("source"))


def clean_turn_title(text: Column) -> Column:
    raw = F.coalesce(text, F.lit(""))
    request = nonempty(F.regexp_extract(raw, r"(?is)## My request for Codex:\s*(.*)$", 1))
    value = F.coalesce(request, raw)
    for pattern, target in (
        (r"(?is)#\s*AGENTS\.md instructions.*?(?:</environment_context>|$)", ""),
        (r"(?is)^# In app browser:.*?## My request for Codex:\s*", ""), (r"(?is)^# Files mentioned by the user:.*?## My request for Codex:\s*", ""),
        (r"<[^>]+>", " "), (r"\[[^\]]+\]\([^)]+\)", ""),
    ):
        value = F.regexp_replace(value, pattern, target)
    return F.coalesce(nonempty(normalize_text(value)), first_line(raw))


def turn_content_filter(turns: DataFrame, items: DataFrame, kind: str = "all", text: str = "", children: DataFrame | None = None) -> DataFrame:
    """Turns by content: all, message, tool (has children), compact, skill, system (any context event), error; with an optional text.

    A text matches when the turn's id or status, or one of its messages or context events, contains it. Context events are
    compactions, declared skills and reads of a skill's file.
    """
    if kind not in TURN_FILTERS:
        raise ValueError(f"turn filter {kind!r} is none of {TURN_FILTERS}")
    type_ = F.col("type")
    message = type_.isin("user-message", "assistant-message") & (normalize_text(F.col("text")) != "")
    declared = (type_ == "user-message") & skill_declaration(F.col("text")).isNotNull()
    read = (type_ == "tool-call") & skill_read(F.col("name"), F.col("arguments")).isNotNull()
    skill = F.coalesce(declared | read, F.lit(False))
    compact = type_ == "context-compact"
    event = compact | skill
    needle = text.lower()
    shown = F.lower(F.coalesce("text", F.lit("")))
    flags = items.filter(message | event).groupBy(*TURN).agg(
        F.max(message).alias("__message"), F.max(event).alias("__event"), F.max(compact).alias("__compact"), F.max(skill).alias("__skill"),
        F.max(shown.contains(needle)).alias("__hit"), F.max(shown.rlike(ERROR_WORDS)).alias("__error"))
    head = F.lower(F.concat_ws(" ", "turn_id", "status"))
    rows = turns.join(flags, TURN, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.lit(True) if not text else (yes("__hit") | head.contains(needle))
    rule = {
        "all": found, "message": yes("__message") & found, "compact": yes("__compact") & found, "skill": yes("__skill") & found, "system": yes("__event") & found,
        "error": (yes("__error") | head.rlike(ERROR_WORDS)) & found,
    }
    if kind == "tool":
        kept = rows.join(children.select(*TURN).distinct(), TURN, "left_semi")
    else:
        kept = rows.filter(rule[kind])
        if children is not None:
            kept = kept.unionByName(rows.join(children.select(*TURN).distinct(), TURN, "left_semi")).dropDuplicates(TURN)
    return kept.select(*turns.columns)


def compaction_roles(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replaced history entries by role (or type)."""
    role = F.coalesce(nonempty(F.col("role")), nonempty(F.col("type")), F.lit("item"))
    return entries.groupBy(*keys, role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def covered_turns(entries: DataFrame, keys: Sequence[str], block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Ranges of consecutive turn numbers that the replaced entries come from."""
    numbers = entries.filter("turn_number IS NOT NULL").select(*keys, "turn_number").distinct()
    marked = ordered_scan(numbers, keys, event_block("turn_number", block_size), ["turn_number"],
                          n=running_sum(F.lit(1).cast("long")))
    island = F.col("turn_number") - F.col("n")
    return marked.groupBy(*keys, island.alias("__i")).agg(F.min("turn_number").alias("from_turn"), F.max("turn_number").alias("to_turn")).drop("__i")


def longest_entry(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest replaced entry, the first one on a tie."""
    return entries.groupBy(*keys).agg(F.max_by(F.struct("entry_index", "text_length"), F.struct(F.col("text_length"), -F.col("entry_index"))).alias("e")).select(
        *keys, F.col("e.entry_index").alias("entry_index"), F.col("e.text_length").alias("text_length"))


def compaction_entries(items: DataFrame) -> DataFrame:
    """One row per replaced history entry of each compaction item."""
    return items.filter("type = 'context-compact' AND compact.history IS NOT NULL").select(
        "session_id", F.col("turn_index").alias("compact_turn"), F.col("source_index").alias("compact_event"), F.col("ts_ms").alias("compact_ms"),
        F.col("compact.window_number").alias("window_number"), F.explode("compact.history").alias("e")).select(
        "session_id", "compact_turn", "compact_event", "compact_ms", "window_number", F.col("e.index").alias("entry_index"), "e.type", "e.role", "e.name",
        "e.call_id", "e.message_id", "e.turn_id", "e.timestamp", "e.content_kinds", "e.preview", "e.text_length")


def entry_turns(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """Entries with the turn they were taken from (the first of that id)."""
    named = turns.groupBy("session_id", "turn_id").agg(F.min_by(F.struct("turn_index", "status"), "turn_index").alias("t"))
    return entries.join(named, ["session_id", "turn_id"], "left").select(
        *entries.columns, F.col("t.turn_index").alias("target_turn"), (F.col("t.turn_index") + 1).alias("turn_number"), F.col("t.status").alias("turn_status"))


def entry_targets(entries: DataFrame, items: DataFrame) -> DataFrame:
    """The item each replaced entry stands for.

    In order of preference: same message id, same call id, then among items of the fitting type the first whose text
    holds the preview (or whose first 80 characters the preview holds), the only one, the last one not later than the
    entry, and finally the last (assistant) or first one.
    """
    key = ["session_id", "compact_event", "entry_index"]
    role, kind = F.lower(F.coalesce("role", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    toolish = kind.rlike("function|tool|call") | F.exists(F.coalesce("content_kinds", F.array().cast("array<string>")), lambda k: F.lower(k).rlike("tool|function|call"))
    wanted = (
        F.when(role == "user", "user-message").when(role == "assistant", "assistant-message").when((role == "tool") | toolish, "tool-call")
        .when(kind.rlike("reasoning"), "reasoning"))
    # Entries, items and the matches by id are read by several branches, which would each repeat their expressions.
    base = stage(entries.filter("target_turn IS NOT NULL").select(
        *key, F.col("target_turn").alias("turn_index"), role.alias("__role"), wanted.alias("__wanted"), F.col("message_id").alias("__mid"), F.col("call_id").alias("__cid"),
        F.lower(normalize_text(F.col("preview"))).alias("__preview"), F.unix_millis(F.col("timestamp").try_cast("timestamp")).alias("__ts")))
    text = F.lower(F.concat_ws(" ", *[nonempty(F.col(c)) for c in ("text", "arguments", "output", "name", "call_id", "message_id")]))
    slim = stage(items.select(*TURN, "item_index", F.col("type").alias("item_type"), "message_id", "call_id", "ts_ms", text.alias("__text")))
    own_id = F.concat(F.lit("item-"), F.col("item_index").cast("string"))
    by_id = lambda column, wanted_id, rank: base.join(
        slim.withColumn("__key", F.coalesce(column, own_id)).groupBy(*TURN, "__key").agg(F.min("item_index").alias("item_index")).withColumnRenamed("__key", wanted_id),
        [*TURN, wanted_id]).select(*key, "turn_index", "item_index", F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("pos"))
    first = stage(by_id(F.col("message_id"), "__mid", 0).unionByName(by_id(F.col("call_id"), "__cid", 1)))
    open_entries = base.join(first.select(*key).distinct(), key, "left_anti")
    second = _fitting_items(open_entries, slim.filter(F.col("item_type").isin(*TARGET_TYPES)), key)
    best = first.groupBy(*key, "turn_index").agg(F.min_by("item_index", "rank").alias("item_index"))
    return best.unionByName(second)


def _fitting_items(entries: DataFrame, items: DataFrame, key: list[str], width_ms: int = DAY_MS) -> DataFrame:
    """The item of each entry among those of its turn and type, found without pairing entries with items.

    Texts are matched by the name index in both directions, once for every distinct preview; the last item not later
    than an entry comes from one time line of both. Entries without a type look among all items: these are counted as
    items of the type `any`, too. Items are staged by the caller.
    """
    group = F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn_index").cast("string"))
    texts = items.withColumn("__group", group)
    typed = texts.withColumn("__type", F.explode(F.array("item_type", F.lit("any"))))
    asked = stage(entries.withColumns({"__group": group, "__type": F.coalesce("__wanted", F.lit("any"))}))
    previews = asked.select("__group", "__preview").filter("__preview <> ''").distinct()
    inside = contained_names(texts, previews, "__group", ["item_index"], "__text", "__preview")
    heads = stage(typed.select("__group", F.substring("__text", 1, SAME_BEGIN).alias("__head"), "__type", "item_index").groupBy("__group", "__head", "__type").agg(F.min("item_index").alias("item_index")))
    around = contained_names(previews.withColumn("__p", F.col("__preview")), heads, "__group", ["__p"], "__preview", "__head").withColumnRenamed("__p", "__preview")
    # an item without any text is held by every preview
    blank = heads.filter("__head = ''").join(previews, "__group").select("__group", "__preview", "__type", "item_index")
    held = stage(
        inside.join(typed.select("__group", "item_index", "__type"), ["__group", "item_index"]).select("__group", "__preview", "__type", "item_index")
        .unionByName(around.join(heads, ["__group", "__head"]).select("__group", "__preview", "__type", "item_index")).unionByName(blank)
        .groupBy("__group", "__preview", "__type").agg(F.min("item_index").alias("held")))
    ends = typed.groupBy("__group", "__type").agg(F.count("*").alias("n"), F.min("item_index").alias("lo"), F.max("item_index").alias("hi"))
    line = typed.filter("ts_ms IS NOT NULL").select("__group", "__type", F.col("ts_ms").alias("__t"), F.lit(0).alias("__side"), "item_index").unionByName(
        asked.filter("__ts IS NOT NULL").select("__group", "__type", F.col("__ts").alias("__t"), F.lit(1).alias("__side"), F.struct(*key).alias("__key")), allowMissingColumns=True)
    scanned = ordered_scan(line, ["__group", "__type"], time_block("__t", width_ms), ["__t", "__side"], before=running_max(F.col("item_index")))
    before = scanned.filter("__side = 1").select("__key.*", "before")
    rows = asked.join(ends, ["__group", "__type"]).join(held, ["__group", "__preview", "__type"], "left").join(before, key, "left")
    chosen = F.coalesce("held", F.when(F.col("n") == 1, F.col("lo")), "before", F.when(F.col("__role") == "assistant", F.col("hi")).otherwise(F.col("lo")))
    return rows.select(*key, "turn_index", chosen.alias("item_index"))


def owners(items: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """The message each item belongs to: itself, the previous answer, else the next one."""
    spoken = (F.col("type") == "assistant-message") & (normalize_text(F.col("text")) != "")
    rows = ordered_scan(
        items.select(*TURN, "item_index", "type", F.when(spoken, F.col("item_index")).alias("__at")), TURN, event_block("item_index", block_size), ["item_index"],
        __prev=last_value(F.col("__at")), __next=next_value(F.col("__at")))
    own = F.when(F.col("type").isin("user-message", "assistant-message"), F.col("item_index"))
    return rows.select(*TURN, "item_index", F.coalesce(own, "__prev", "__next").alias("owner_index"))


def compression_references(targets: DataFrame, owner_rows: DataFrame) -> DataFrame:
    """Per message the compaction entries that replaced it or its items."""
    return targets.join(owner_rows, [*TURN, "item_index"]).filter("owner_index IS NOT NULL").dropDuplicates(
        [*TURN, "owner_index", "compact_event", "entry_index"])


