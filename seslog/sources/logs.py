"""Reading session logs: JSON-lines files under live and archived roots.

Files are read as splittable text, so one very large log is spread over many tasks. Line numbers, event indexes and
byte offsets come from a running count over the file's input splits (see functions/ordered.py).
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.js import field, text_of
from seslog.functions.ordered import ordered_scan, running_sum
from seslog.functions.staging import stage
from seslog.functions.text import SPACE, first_line, nonempty, slashes, strip_long_path_prefix

TAIL_BYTES = 96 * 1024
# Fixed value: the id at the end of a log's file name.
UUID_TAIL = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"


# --- names and paths ------------------------------------------------------------------------------------------------
def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(slashes(path), "/"), -1), r"\.jsonl$", "")


def session_id_from_file(path: Column) -> Column:
    stem = file_stem(path)
    return F.coalesce(nonempty(F.regexp_extract(stem, UUID_TAIL, 1)), stem)


def session_start_from_file(path: Column) -> Column:
    """Start time (epoch ms) of either file-name format, NULL for other names."""
    stem = file_stem(path)
    first = F.regexp_extract(stem, r"^rollout-(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})-", 1)
    second = F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-\d{3})Z_", 1)
    return F.coalesce(
        F.unix_millis(F.try_to_timestamp(nonempty(first), F.lit("yyyy-MM-dd'T'HH-mm-ss"))),
        F.unix_millis(F.try_to_timestamp(nonempty(second), F.lit("yyyy-MM-dd'T'HH-mm-ss-SSS"))),
    )


def legacy_session_id(value: Column) -> Column:
    """The id of an earlier ``prefix:id`` scheme, only in its safe shape (no path separators, no leading dot)."""
    legacy = F.regexp_extract(value, r"(?i)^[a-z0-9][a-z0-9-]{0,127}:([^/.\\][^/\\]*)$", 1)
    return F.coalesce(nonempty(legacy), value)


def map_home_path(path: Column, home: str, original_home: str | None = None) -> Column:
    """The path re-rooted under ``home`` where it lies inside ``original_home``; else unchanged."""
    clean = strip_long_path_prefix(path)
    root = slashes(F.lit((original_home or home).rstrip("/\\")))
    flat = slashes(clean)
    inside = flat.startswith(F.concat(root, F.lit("/")))
    tail = F.substr(flat, F.length(root) + 1)
    return F.when(inside, F.concat(F.lit(home.rstrip("/\\")), tail)).otherwise(clean)


def relative_path(path: Column, home: str) -> Column:
    flat = slashes(strip_long_path_prefix(path))
    root = home.replace("\\", "/").rstrip("/") + "/"
    return F.when(flat.startswith(root), F.substr(flat, F.lit(len(root) + 1))).otherwise(flat)


# --- lines and records ----------------------------------------------------------------------------------------------
def read_lines(
    spark: SparkSession, paths: str | Sequence[str], archived: bool = False, since_ms: int | None = None,
    before_ms: int | None = None, days: tuple[str, str] | None = None,
) -> DataFrame:
    """Every line of the ``*.jsonl`` files under the roots, with line number, event index and byte offset.

    ``*`` in a root stands for one directory level, and does not stand for a directory that starts with a dot; dot
    directories that the root names are read. ``since_ms`` is inclusive, ``before_ms`` exclusive, both on the file's
    modification time. ``days`` (first and last, both inclusive) reads only the YYYY/MM/DD folders of those days; days
    without a folder are passed over.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    dated = None if days is None else _present(spark, [p for root in roots for p in dated_paths(root, *days)])
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n")
    if since_ms is not None:  # coarse file pruning before the exact filter
        reader = reader.option("modifiedAfter", _iso(since_ms - 1000))
    if before_ms is not None:
        reader = reader.option("modifiedBefore", _iso(before_ms + 1000))
    rows = (reader.text(dated) if dated else reader.text(roots) if dated is None else _no_lines(spark)).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("read_order"),
        F.col("value").alias("line"),
    )
    hidden = [p for root in roots for p in _dot_at_star(root)]
    if hidden:
        rows = rows.filter(~F.col("file_path").rlike("|".join(hidden)))
    if since_ms is not None:
        rows = rows.filter(F.col("mtime_ms") >= since_ms)
    if before_ms is not None:
        rows = rows.filter(F.col("mtime_ms") < before_ms)
    blank = F.col("line").rlike(f"^{SPACE}*$")
    counted = ordered_scan(
        rows, ["file_path"], F.col("split_start"), ["split_start", "read_order"],
        line_number=running_sum(F.lit(1)),
        event_index=running_sum(F.when(blank, 0).otherwise(1), before=True),
        byte_start=running_sum(F.octet_length("line").cast("long") + 1, before=True),
    )
    return counted.select(
        session_id_from_file(F.col("file_path")).alias("session_id"), "file_path", "mtime_ms", "file_size",
        F.lit(archived).alias("archived"), "line_number", F.col("event_index").cast("long").alias("event_index"), "byte_start",
        (F.col("byte_start") + F.octet_length("line") + 1 <= F.col("file_size")).alias("committed"),
        F.regexp_replace("line", "\r$", "").alias("line"), blank.alias("blank"),
    )


def _dot_at_star(root: str) -> list[str]:
    """For each level of a root that is a star: the pattern of files whose directory there starts with a dot."""
    levels = [x for x in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", os.path.abspath(root) if ":" not in root else root).split("/") if x]
    begin = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/"
    return [begin + "/".join([*["[^/]+"] * i, r"\.[^/]*"]) + "/" for i, level in enumerate(levels) if level == "*"]


def _iso(ms: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S")


def parse_records(lines: DataFrame) -> DataFrame:
    """raw_events: one row per non-blank line; a line that is no JSON keeps its place as a diagnostic."""
    raw = F.try_parse_json("line")
    rows = lines.filter(~F.col("blank")).drop("blank").withColumn("raw", raw)
    bad = F.col("raw").isNull()
    return rows.withColumns({
        "is_valid": ~bad,
        "error_code": F.when(bad, "invalid-json"),
        "preview": F.when(bad, F.substring(first_line(F.col("line")), 1, 220)),
    })


def read_session_logs(
    spark: SparkSession, live: str | Sequence[str], archived: str | Sequence[str] | None = None,
    since_ms: int | None = None, before_ms: int | None = None, days: tuple[str, str] | None = None,
) -> DataFrame:
    """raw_events of the live roots (those of the given days only) and, where given, of the archived ones."""
    lines = read_lines(spark, live, False, since_ms, before_ms, days)
    if archived is not None:
        lines = lines.unionByName(read_lines(spark, archived, True, since_ms, before_ms))
    return parse_records(lines)


def dated_paths(root: str, since: str, until: str) -> list[str]:
    """Globs of the YYYY/MM/DD directories from one day to another (both inclusive), for pruning before listing."""
    from datetime import date, timedelta

    day, last = date.fromisoformat(since), date.fromisoformat(until)
    out = []
    while day <= last:
        out.append(f"{root.rstrip('/')}/{day:%Y/%m/%d}")
        day += timedelta(days=1)
    return out


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths, or globs, that match a folder."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(hadoop).globStatus(place):
            found.append(path)
    return found


def _no_lines(spark: SparkSession) -> DataFrame:
    """What the text reader gives where there is no file."""
    metadata = "struct<file_path:string, file_modification_time:timestamp, file_size:long, file_block_start:long>"
    return spark.createDataFrame([], f"value string, _metadata {metadata}")


def tolerant_records(records: DataFrame) -> DataFrame:
    """Only usable records: bad lines and falsy scalars are dropped."""
    text = text_of(F.col("raw"))
    falsy = F.is_variant_null("raw") | text.isin("", "0", "false")
    return records.filter(F.col("is_valid") & ~falsy)


def committed_tail(lines: DataFrame, window: int = TAIL_BYTES) -> DataFrame:
    """Newline-terminated lines of each file's last ``window`` bytes, without a first line that may be cut."""
    start = F.greatest(F.col("file_size") - window, F.lit(0))
    return lines.filter(F.col("committed") & ((start == 0) | (F.col("byte_start") > start)))


def tag_source(rows: DataFrame, source_id: str, label: str, kind: str) -> DataFrame:
    return rows.withColumns({"source_id": F.lit(source_id), "source_label": F.lit(label), "source_kind": F.lit(kind)})


def union_sources(*sources: DataFrame) -> DataFrame:
    """The same session id in two sources stays two sessions: the key is (source_id, session_id)."""
    result = sources[0]
    for other in sources[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


# --- point and range reads ------------------------------------------------------------------------------------------
def event_at(events: DataFrame, session_id, index: int) -> DataFrame:
    """One event by its index, however long the session is."""
    return events.filter((F.col("session_id") == session_id) & (F.col("event_index") == index))


def range_scan(
    events: DataFrame, start: int, limit: int, max_scan: int, predicate: Column, include_invalid: bool = False,
    keys: Sequence[str] = ("session_id",),
) -> tuple[DataFrame, DataFrame]:
    """Per key the first ``limit`` matches at or after ``start`` within ``max_scan`` rows, and the page facts.

    Facts: rows scanned, the next cursor (last scanned + 1) and whether the key is exhausted. Invalid rows are
    scanned; they are returned only when asked for.
    """
    valid = F.col("is_valid") if "is_valid" in events.columns else F.lit(True)
    hit = F.coalesce(F.when(valid, predicate).otherwise(F.lit(include_invalid)), F.lit(False))
    window = events.filter((F.col("event_index") >= start) & (F.col("event_index") < start + max_scan))
    counted = ordered_scan(
        window, keys, F.floor(F.col("event_index") / 65_536), ["event_index"],
        __hits=running_sum(hit.cast("int"), before=True),
    )
    scanned = counted.filter(F.col("__hits") < limit).withColumn("matched", hit)
    sizes = events.groupBy(*keys).agg((F.max("event_index") + 1).alias("__size"))
    facts = (
        scanned.groupBy(*keys).agg((F.max("event_index") + 1).alias("next_cursor"), F.count(F.lit(1)).alias("scanned"))
        .join(sizes, list(keys))
        .withColumn("exhausted", F.col("next_cursor") >= F.col("__size"))
        .drop("__size")
    )
    return scanned.filter("matched").drop("matched", "__hits"), facts


# --- side files -----------------------------------------------------------------------------------------------------
def session_index(spark: SparkSession, path: str) -> DataFrame:
    """id, name and update time of the index file; the last row per id counts."""
    rows = parse_records(read_lines(spark, path)).select("line_number", "raw").filter(F.col("raw").isNotNull())
    picked = rows.select(
        text_of(field(F.col("raw"), "id")).alias("id"), "line_number",
        F.coalesce(text_of(field(F.col("raw"), "thread_name")), text_of(field(F.col("raw"), "name"))).alias("name"),
        F.coalesce(text_of(field(F.col("raw"), "updated_at")), text_of(field(F.col("raw"), "updatedAt"))).alias("updated_at"),
    ).filter("id IS NOT NULL AND id <> ''")
    best = picked.groupBy("id").agg(F.max_by(F.struct("name", "updated_at"), F.col("line_number")).alias("v"))
    return best.select("id", "v.name", "v.updated_at")


def model_windows(documents: DataFrame) -> DataFrame:
    """Context window per model id: every object with an id and a finite window, at any level; the later one counts.

    Goes down level by level until one has no values.

    ``documents`` has one VARIANT column ``doc``.
    """
    level = documents.select(F.col("doc").alias("node"), F.array().cast("array<int>").alias("path"))
    found = None
    while found is None or not level.isEmpty():
        hits = level.select(
            text_of(field(F.col("node"), "id")).alias("model"),
            F.try_variant_get("node", "$.contextWindow", "double").alias("context_window"), "path",
        ).filter("model IS NOT NULL AND context_window IS NOT NULL")
        found = hits if found is None else found.unionByName(hits)
        level = stage(_explode_variants(level))
    return found.groupBy("model").agg(F.max_by("context_window", "path").alias("context_window"))


def _explode_variants(level: DataFrame) -> DataFrame:
    level.createOrReplaceTempView("__seslog_variant_level")
    return level.sparkSession.sql(
        "SELECT e.value AS node, concat(path, array(e.pos)) AS path FROM __seslog_variant_level, LATERAL variant_explode(node) e"
    )
