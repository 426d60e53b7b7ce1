"""Session catalog: filters, sort, pages, scopes, de-duplication, display rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.text import contains_text, joined_text, normalize_text, nonempty

HOUR_MS = 3_600_000
LIST_TYPES = {"error": "(?i)error|failed|失败|错误", "tool": "(?i)tool|mcp|command|shell|工具|命令"}
SEARCH_FIELDS = (
    "id", "title", "preview", "cwd", "relative_path", "model", "reasoning_effort", "source", "thread_source",
    "model_provider", "agent_nickname", "agent_role", "status",
)
DISPLAY_FIELDS = ("id", "title", "preview", "cwd", "relative_path", "model", "agent_nickname")
CONTAINS_FIELDS = {
    "title": ("title",), "cwd": ("cwd",), "path": ("relative_path", "path"), "model": ("model",), "source": ("source",),
    "thread_source": ("thread_source",), "model_provider": ("model_provider",), "agent_nickname": ("agent_nickname",),
    "agent_role": ("agent_role",),
}


def changed_at(updated: Column, modified: Column, started: Column) -> Column:
    return F.coalesce(updated, modified, started)


def matches_list_type(kind: str, *fields: Column) -> Column:
    pattern = LIST_TYPES.get(kind)
    return F.lit(True) if pattern is None else joined_text(*fields).rlike(pattern)


def children_of(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions that are children of an edge."""
    ids = edges.select(F.col("child_id").alias("id")).filter("id IS NOT NULL")
    return sessions.join(ids, "id", "left_semi")


def roots_only(sessions: DataFrame, edges: DataFrame, child_flag: Column | None = None) -> DataFrame:
    """Sessions that are a child neither by an edge nor by their own metadata."""
    rows = sessions if child_flag is None else sessions.filter(~F.coalesce(child_flag, F.lit(False)))
    return rows.join(edges.select(F.col("child_id").alias("id")), "id", "left_anti")


def with_relations(sessions: DataFrame, edges: DataFrame, is_child: bool | None = None, has_children: bool | None = None):
    """Tri-state filters: None leaves the relation open."""
    for wanted, column in ((is_child, "child_id"), (has_children, "parent_id")):
        if wanted is not None:
            ids = edges.select(F.col(column).alias("id")).filter("id IS NOT NULL")
            sessions = sessions.join(ids, "id", "left_semi" if wanted else "left_anti")
    return sessions


def filter_sessions(
    sessions: DataFrame, *, ids: Sequence | None = None, text: str | None = None, list_type: str = "all",
    archived: bool | None = None, changed_after: int | None = None, changed_before: int | None = None,
    started_after: int | None = None, started_before: int | None = None, **contains: str,
) -> DataFrame:
    """All set conditions hold; the four time bounds are strict; text matching is a normalized substring test."""
    have = set(sessions.columns)
    rows = sessions
    if ids:
        rows = rows.filter(F.col("id").isin(list(ids)))
    if archived is not None:
        rows = rows.filter(F.coalesce(F.col("archived"), F.lit(False)) == archived)
    for column, low, high in (("changed_ms", changed_after, changed_before), ("started_ms", started_after, started_before)):
        if low is not None:
            rows = rows.filter(F.col(column) > low)
        if high is not None:
            rows = rows.filter(F.col(column) < high)
    if list_type in LIST_TYPES:
        rows = rows.filter(matches_list_type(list_type, *_fields(have, ("title", "cwd", "relative_path"))))
    for name, expected in contains.items():
        for field in CONTAINS_FIELDS[name]:
            if expected and field in have:
                rows = rows.filter(contains_text(F.col(field).cast("string"), expected))
    if text:
        rows = rows.filter(contains_text(joined_text(*_fields(have, SEARCH_FIELDS)), text))
    return rows


def _fields(have: set[str], names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("string") for n in names if n in have]


def sort_keys(sort: str = "changed_ms", ascending: bool = False) -> list[Column]:
    """Sort by one of changed_ms, updated_ms, started_ms, size_bytes (missing = 0), title or id, then by id.

    Texts compare in binary order, not in a locale's order.
    """
    if sort == "title":
        value = normalize_text(F.col("title"))
    elif sort == "id":
        value = F.coalesce(F.col("id").cast("string"), F.lit(""))
    else:
        value = F.coalesce(F.col(sort), F.lit(0))
    tie = F.col("id").cast("string")
    return [value.asc(), tie.asc()] if ascending else [value.desc(), tie.desc()]


def page(rows: DataFrame, keys: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page with the total and the next offset (NULL on the last page). Deep pages are cheaper by `keyset_page`."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("__page", F.lit(1))
    cut = rows.orderBy(*keys).offset(offset).limit(limit).withColumn("__page", F.lit(1))
    following = F.lit(offset + limit)
    return (
        cut.join(F.broadcast(total), "__page")  # one row
        .drop("__page")
        .withColumn("next_offset", F.when(following < F.col("total"), following))
    )


def keyset_page(rows: DataFrame, order: str, after: tuple | None, limit: int) -> DataFrame:
    """The rows after (value, id) in the order value descending, id ascending."""
    value = F.coalesce(F.col(order), F.lit(0)) if order != "path" else F.col(order)
    if after is not None:
        last, last_id = after
        rows = rows.filter((value < last) | ((value == last) & (F.col("id") > last_id)))
    return rows.orderBy(value.desc(), F.col("id").asc()).limit(limit)


def newest(rows: DataFrame, limit: int, column: str = "changed_ms") -> DataFrame:
    return rows.orderBy(F.col(column).desc_nulls_last(), F.col("id").asc()).limit(limit)


def root_threads(threads: DataFrame, edges: DataFrame, since: int | None, before: int | None):
    """Threads that are no child: since inclusive, before exclusive or unknown time."""
    rows = roots_only(threads, edges)
    if since is not None:
        rows = rows.filter(F.col("changed_ms") >= since)
    if before is not None:
        rows = rows.filter((F.col("changed_ms") < before) | F.col("changed_ms").isNull())
    return rows


def scope_flags(changed: Column, now_ms: int) -> dict[str, Column]:
    """Membership in each catalog scope; lower bounds are inclusive, upper ones exclusive, unknown times are old."""
    day, live = now_ms - 24 * HOUR_MS, now_ms - 3 * HOUR_MS
    known = changed.isNotNull()
    old = F.coalesce(changed < day, F.lit(True))
    return {
        "realtime": known & (changed >= live), "day": known & (changed >= day) & (changed < live), "earlier": old,
        "recent24h": known & (changed >= day), "history": old, "all": F.lit(True),
    }


def age_bucket(changed: Column, now_ms: int) -> Column:
    """The one bucket a session is listed under by its age."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - changed)
    return (
        F.when(changed.isNull(), "earlier").when(age < 3 * HOUR_MS, "realtime").when(age < 24 * HOUR_MS, "day")
        .otherwise("earlier")
    )


def dedupe_files(files: DataFrame, key: str = "id") -> DataFrame:
    """One record per session id: live before archived, then the newer file, then the smaller path.

    An aggregate, not a window: copies of one id combine map-side, however many there are.
    """
    rest = [c for c in files.columns if c != key]
    live = F.when(F.col("archived"), 0).otherwise(1)
    # max picks the larger path, so the smaller path is reached with a second min over the winners' rank.
    best = files.groupBy(key).agg(F.max(F.struct(live.alias("live"), F.coalesce("mtime_ms", F.lit(0)).alias("mtime"))).alias("__b"))
    ranked = files.join(best, key).filter((live == F.col("__b.live")) & (F.coalesce("mtime_ms", F.lit(0)) == F.col("__b.mtime")))
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("path")).alias("__r")).select(key, "__r.*")


def display_rows(sessions: DataFrame, text: str = "", list_type: str = "all", limit: int = 400) -> DataFrame:
    """List rows; titles are shortened unless the list is filtered."""
    have = set(sessions.columns)
    rows = sessions
    if list_type in LIST_TYPES:
        rows = rows.filter(matches_list_type(list_type, *_fields(have, ("title", "cwd", "relative_path"))))
    if text:
        rows = rows.filter(F.lower(joined_text(*_fields(have, DISPLAY_FIELDS))).contains(text.strip().lower()))
    full = bool(text) or list_type in LIST_TYPES
    title = F.coalesce(nonempty(normalize_text(F.col("title"))), F.lit("未命名会话"))
    cut = F.lit(False) if full else F.length(title) > limit
    shown = F.when(cut, F.concat(F.substring(title, 1, limit - 1), F.lit("…"))).otherwise(title)
    return rows.withColumns({"display_title": shown, "title_truncated": cut})


def pick_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The id (or event index) and the asked fields that exist."""
    fixed = [c for c in ("id", "event_index") if c in rows.columns]
    return rows.select(*fixed, *[f for f in fields if f in rows.columns and f not in fixed]) if fields else rows


def watermark(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("changed_ms").alias("watermark_ms"))


def enrich_titles(sessions: DataFrame, threads: DataFrame) -> DataFrame:
    """The thread's title where it has a non-empty one, else the session's own."""
    named = threads.select("id", nonempty(F.col("title")).alias("__title"))
    return sessions.join(named, "id", "left").withColumn("title", F.coalesce("__title", "title")).drop("__title")


def threads_else_files(threads: DataFrame, files: DataFrame) -> DataFrame:
    """Thread rows whose file exists, plus file sessions without such a thread row."""
    backed = threads.join(files.select("path").distinct(), "path", "left_semi")
    missing = files.join(backed.select("id"), "id", "left_anti")
    return backed.unionByName(missing, allowMissingColumns=True)
