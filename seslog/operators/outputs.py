"""Tables read out of tool arguments and outputs: patches, git status, search hits, verification results.

Texts are split into lines, one row each; what depends on earlier lines (the file or section a line belongs to) is a
running value over the lines of the call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import EVENTS_PER_BLOCK, event_block, last_value, next_value, ordered_scan, running_sum
from seslog.functions.text import nonempty, one_decimal, rtrim_space, trim_space
from seslog.operators.rules import SEPARATOR, strip_shell_wrapper

NEWLINE = r"\r?\n"


def clean_patch_path(path: Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(path, r"""^["']|["']$""", ""), r"^(?:a|b)/", ""))


def lines_of(rows: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    return rows.select(*keys, F.posexplode(F.split(text, NEWLINE)).alias("pos", "line"))


# --- patches --------------------------------------------------------------------------------------------------------------------
HEADER = r"^\*\*\* (Add|Delete|Update) File:\s+(.+)$"
MOVE = r"^\*\*\* Move to:\s+(.+)$"


def _patch_lines(calls: DataFrame, keys: Sequence[str], block_size: int) -> DataFrame:
    """Patch lines with the number of the file they belong to (0: before the first header)."""
    line = F.col("line")
    rows = lines_of(calls, keys, F.coalesce("arguments", F.lit(""))).withColumn("header", line.rlike(HEADER))
    return ordered_scan(rows, keys, event_block("pos", block_size), ["pos"], file_no=running_sum(F.col("header").cast("int")))


def _line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(HEADER), "header").when(line.rlike(MOVE), "move").when(line.startswith("@@"), "hunk")
        .when(line.rlike(r"^\+(?!\+\+)"), "added").when(line.rlike(r"^-(?!--)"), "removed").when(line.startswith("***"), "marker").otherwise("context"))


def file_changes(calls: DataFrame, keys: Sequence[str], block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Changed files of each call: path, old path, status, added and removed lines, hunks.

    From the patch text and from A/M/D lines of the output; a file named by both keeps the larger counts.
    """
    keys = list(keys)
    line, pos = F.col("line"), F.col("pos")
    parsed = _patch_lines(calls, keys, block_size).filter("file_no > 0").withColumn("kind", _line_kind(line))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    moved = F.max_by(F.regexp_extract(line, MOVE, 1), F.when(F.col("kind") == "move", pos))
    files = parsed.groupBy(*keys, "file_no").agg(
        F.min_by(F.regexp_extract(line, HEADER, 1), F.when(F.col("header"), pos)).alias("verb"), F.min_by(F.regexp_extract(line, HEADER, 2), F.when(F.col("header"), pos)).alias("named"),
        moved.alias("moved"), count("added").alias("additions"), count("removed").alias("deletions"), count("hunk").alias("hunks"))
    status = F.when(F.col("moved").isNotNull(), "renamed").when(F.col("verb") == "Add", "added").when(F.col("verb") == "Delete", "deleted").otherwise("modified")
    from_patch = files.select(
        *keys, F.col("file_no").cast("long").alias("ord"), clean_patch_path(F.coalesce("moved", "named")).alias("path"),
        F.when(F.col("moved").isNotNull(), clean_patch_path(F.col("named"))).otherwise("").alias("old_path"), status.alias("status"), "additions", "deletions", "hunks")
    short = r"^\s*([AMD])\s+(.+?)\s*$"
    zero = F.lit(0).cast("long")
    listed = lines_of(calls, keys, F.coalesce("output", F.lit(""))).filter(line.rlike(short))
    code = F.regexp_extract(line, short, 1)
    from_output = listed.select(
        *keys, (F.col("pos") + 2**40).cast("long").alias("ord"), clean_patch_path(F.regexp_extract(line, short, 2)).alias("path"), F.lit("").alias("old_path"),
        F.when(code == "A", "added").when(code == "D", "deleted").otherwise("modified").alias("status"), zero.alias("additions"), zero.alias("deletions"), zero.alias("hunks"))
    return from_patch.unionByName(from_output).filter("path <> ''").groupBy(*keys, "path", "old_path").agg(
        F.min("ord").alias("ord"), F.min_by("status", "ord").alias("status"), F.max("additions").alias("additions"), F.max("deletions").alias("deletions"), F.max("hunks").alias("hunks"))


def patch_summaries(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One line per call: number of files, added and removed lines, the first three files."""
    shown = F.when((F.col("old_path") != "") & (F.col("old_path") != F.col("path")), F.concat("old_path", F.lit(" -> "), "path")).otherwise(F.col("path"))
    ranked = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("additions").alias("a"), F.sum("deletions").alias("d"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", shown.alias("s")))), 1, 3), lambda x: x["s"]).alias("top"))
    more = F.when(F.col("n") > 3, F.concat(F.lit("+"), (F.col("n") - 3).cast("string")))
    counts = F.when((F.col("a") > 0) | (F.col("d") > 0), F.concat(F.lit("+"), F.col("a").cast("string"), F.lit(" -"), F.col("d").cast("string")))
    names = F.concat_ws(", ", F.array_join("top", ", "), more)
    return ranked.select(*keys, F.concat_ws(" · ", F.concat(F.col("n").cast("string"), F.lit(" 个文件")), counts, nonempty(names)).alias("patch_summary"))


def patch_lines(calls: DataFrame, keys: Sequence[str], block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Lines of the patch body per file: hunk, added, removed or context."""
    keys = list(keys)
    line = F.col("line")
    body = lines_of(calls, keys, trim_space(F.coalesce("arguments", F.lit(""))))
    bounds = body.groupBy(*keys).agg(
        F.min(F.when(trim_space(line) == "*** Begin Patch", F.col("pos"))).alias("begin"), F.min(F.when(line.rlike(HEADER), F.col("pos"))).alias("first"))
    inside = body.join(bounds.filter("begin IS NOT NULL OR first IS NOT NULL"), keys).filter(F.col("pos") > F.coalesce("begin", F.col("first") - 1))
    ends = inside.filter(trim_space(line) == "*** End Patch").groupBy(*keys).agg(F.min("pos").alias("end"))
    scoped = inside.join(ends, keys, "left").filter("end IS NULL OR pos < end").withColumn("header", line.rlike(HEADER))
    numbered = ordered_scan(scoped, keys, event_block("pos", block_size), ["pos"], file_no=running_sum(F.col("header").cast("int")),
                            path=last_value(F.when(F.col("header"), clean_patch_path(F.regexp_extract(line, HEADER, 2)))),
                            moved=next_value(F.when(F.col("header") | line.rlike(MOVE), F.regexp_extract(line, MOVE, 1))))
    kind = _line_kind(line)
    text = F.when(kind.isin("added", "removed") | line.startswith(" "), F.substr(line, F.lit(2))).otherwise(line)
    return numbered.filter("file_no > 0").withColumns({"kind": kind, "text": text}).filter(F.col("kind").isin("hunk", "added", "removed", "context")).select(
        *keys, "file_no", "path", "pos", "kind", "text")


# --- command outputs --------------------------------------------------------------------------------------------------------------
# Lines and words of command outputs that are known by their form.
SCAFFOLD = r"(?i)^(?:(?:Chunk ID|Wall time|Original token count):.*|Process exited with code\s+-?\d+.*|Output:\s*)$"
EXIT_CODE = r"(?i)(?:Process exited with code|exit code|exitCode)\s*[:=]?\s*(-?\d+)"
VERIFY_COMMAND = (
    r"(?i)^(?:npm|pnpm|yarn)\s+(?:run\s+)?(?:test|check|lint|build|typecheck)\b|^node\s+--test\b|^(?:npx\s+)?(?:pytest|vitest|jest)\b"
    r"|^(?:npx\s+)?playwright\s+test\b|^(?:npx\s+)?tsc\b|^go\s+test\b|^cargo\s+test\b|^mvn\s+test\b|^gradle\s+test\b")
VERIFY_OUTPUT = r"(?i)\bTAP version\b|#\s*tests\s+\d+|#\s*pass\s+\d+|\bTest Files\b|\bTests?\b[\s\S]{0,80}\b(?:passed|failed)\b|\b(?:PASS|FAIL)\b"
GIT_OUTPUT = r"(?i)\b(?:working tree clean|nothing to commit|Changes to be committed|Changes not staged|Untracked files)\b"
HIT = r"^(.+?)(?::|-)(\d+)(?::(\d+))?[:-](.*)$"
# What counts as a failing or a passing line, and how counts are written.
GOOD_START = r"(?i)^(?:✔|✓|ok\s+\d+\s+-|\s*PASS\b)"
ZERO_FAILED = r"(?i)\b(?:0\s+failed|failed\s+0|fail\s+0|0\s+errors?|errors?\s+0)\b"
BAD_LINE = (
    r"(?i)\b(?:not ok|FAIL\b|failed|failures?\s*[:=]?\s*[1-9]\d*|[1-9]\d*\s+failures?|errors?\s*[:=]?\s*[1-9]\d*|[1-9]\d*\s+errors?"
    r"|error:|exception|ERR!|ELIFECYCLE)\b|失败|错误")
GOOD_LINE = r"(?i)\b(?:ok\b|PASS|passed|success|succeeded)\b|通过|成功"
COUNT_PATTERNS = {
    "total": (r"(?i)#\s*tests\s+(\d+)", r"(?i)\btests?\s+(\d+)", r"(?i)\bTests?\s*[:=]\s*(\d+)", r"(?i)\b(\d+)\s+tests?\b"),
    "pass": (r"(?i)#\s*pass\s+(\d+)", r"(?i)\b(\d+)\s+passed\b", r"(?i)\bpass(?:ed)?\s+(\d+)"),
    "fail": (r"(?i)#\s*fail\s+(\d+)", r"(?i)\b(\d+)\s+failed\b", r"(?i)\bfail(?:ed)?\s+(\d+)"),
    "error": (r"(?i)#\s*errors?\s+(\d+)", r"(?i)\b(\d+)\s+errors?\b", r"(?i)\berrors?\s+(\d+)"),
}
# Fixed value: the lines of a test run that are shown.
KEY_LINE = r"(?i)#\s*(?:tests|pass|fail|duration_ms)\b|Test Files|Tests\b|Duration|Time:"


def is_failure_line(line: Column) -> Column:
    value = trim_space(line)
    return (value != "") & ~value.rlike(GOOD_START) & ~value.rlike(ZERO_FAILED) & value.rlike(BAD_LINE)


def is_success_line(line: Column) -> Column:
    return line.rlike(GOOD_LINE)


def command_lines(output: Column) -> Column:
    """All non-blank lines."""
    lines = F.transform(F.split(F.coalesce(output, F.lit("")), NEWLINE), lambda x: rtrim_space(x))
    return F.filter(lines, lambda x: trim_space(x) != "")


def command_sources(calls: DataFrame) -> DataFrame:
    """Adds the cleaned output, the exit code, the primary command and which table an output belongs to.

    ``calls`` has command, output and optionally status. The first fitting category counts: git status, search,
    verification.
    """
    given = trim_space(F.coalesce("output", F.lit("")))
    kept = F.filter(F.split(given, NEWLINE), lambda x: ~x.rlike(SCAFFOLD))
    status = F.coalesce("status", F.lit("")) if "status" in calls.columns else F.lit("")
    primary = trim_space(strip_shell_wrapper(trim_space(F.get(F.split(F.coalesce("command", F.lit("")), SEPARATOR), 0))))
    rows = calls.withColumns({
        "clean_output": trim_space(F.array_join(kept, "\n")), "exit_code": nonempty(F.regexp_extract(F.concat_ws("\n", status, given), EXIT_CODE, 1)).cast("int"),
        "primary_command": primary,
    })
    out = F.col("clean_output")
    git_command = F.col("primary_command").rlike(r"(?i)^git\s+status\b")
    git = git_command | (out.rlike(GIT_OUTPUT) & out.rlike(r"(?im)^(?:\s*(?:nothing to commit|working tree clean)|[ MADRCU?!]{1,2}\s+\S|\s*(?:modified|new file|deleted|renamed|copied|both modified):)"))
    search = (F.col("primary_command").rlike(r"(?i)^(?:rg|grep|findstr)\b") & ~F.col("primary_command").rlike(r"(?i)\s--files\b")) | F.exists(
        F.split(out, NEWLINE), lambda x: x.rlike(HIT))
    verify = F.col("primary_command").rlike(VERIFY_COMMAND) | out.rlike(VERIFY_OUTPUT)
    empty = (F.coalesce("command", F.lit("")) == "") & (out == "")
    return rows.withColumn("category", F.when(empty, None).when(git, "git_status").when(search, "search").when(verify, "verification"))


# Headings and line forms of a status listing.
SECTIONS = {"Changes to be committed:": "staged", "Changes not staged for commit:": "unstaged", "Untracked files:": "untracked", "Unmerged paths:": "conflict"}
LONG_FORM = r"(?i)^(modified|new file|deleted|renamed|copied|both modified|both deleted|added by us|deleted by them):\s+(.+)$"
SHORT_FORM = r"^([ MADRCU?!]{1,2})\s+(.+)$"


def git_status_lines(sources: DataFrame, keys: Sequence[str], block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Lines of git-status outputs with what they say: branch, clean, a section heading or a file with its status."""
    keys = list(keys)
    rows = lines_of(sources.filter("category = 'git_status'"), keys, F.col("clean_output"))
    line = F.regexp_replace("line", r"\s+$", "")
    trimmed = trim_space(F.col("line"))
    heading = None
    for text, name in SECTIONS.items():
        hit = F.lower(trimmed).startswith(text.lower())
        heading = F.when(hit, name) if heading is None else heading.when(hit, name)
    branch = nonempty(F.regexp_extract(trimmed, r"(?i)^On branch\s+(.+)$", 1))
    clean = trimmed.rlike("(?i)^(?:nothing to commit|working tree clean)")
    rows = rows.filter(trimmed != "").withColumns({"branch": branch, "clean": F.when(branch.isNull(), clean).otherwise(False), "heading": F.when(branch.isNull() & ~clean, heading)})
    rows = ordered_scan(rows, keys, event_block("pos", block_size), ["pos"], section=last_value(F.col("heading")))
    code = F.regexp_extract(line, SHORT_FORM, 1)
    short = line.rlike(SHORT_FORM) & code.rlike("[MADRCU?!]")
    long = trimmed.rlike(LONG_FORM)
    word = F.lower(F.regexp_extract(trimmed, LONG_FORM, 1))
    loose = (F.col("section") == "untracked") & ~trimmed.rlike(r"(?i)^\(use\s")
    by_code = (
        F.when(code.contains("U"), "conflict").when(code.contains("?"), "untracked").when(code.contains("R"), "renamed").when(code.contains("C"), "copied")
        .when(code.contains("A"), "added").when(code.contains("D"), "deleted").when(code.contains("M"), "modified").otherwise("changed"))
    by_word = (
        F.when((F.col("section") == "conflict") | word.rlike("^both| by "), "conflict").when(word == "new file", "added").when(word.contains("deleted"), "deleted")
        .when(word == "renamed", "renamed").when(word == "copied", "copied").when(word.contains("modified"), "modified").otherwise("changed"))
    entry = F.col("branch").isNull() & ~F.col("clean") & F.col("heading").isNull()
    scope = F.when(code.contains("?"), "未跟踪").otherwise(F.concat_ws(
        " + ", F.when(F.substring(code, 1, 1) != " ", "暂存"), F.when((F.length(code) > 1) & (F.substring(code, 2, 1) != " "), "工作区")))
    status = F.when(entry & short, by_code).when(entry & long, by_word).when(entry & F.coalesce(loose, F.lit(False)), "untracked")
    path = F.when(short, F.regexp_extract(line, SHORT_FORM, 2)).when(long, F.regexp_extract(trimmed, LONG_FORM, 2)).otherwise(trimmed)
    return rows.withColumns({
        "status": status, "path": F.when(status.isNotNull(), clean_patch_path(path)), "scope": F.when(entry & short, scope).when(status.isNotNull(), F.col("section"))})


def git_status(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per output: branch, whether clean, number of changed files by status, and the outcome."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    grouped = lines.groupBy(*keys).agg(
        F.max_by("branch", F.when(F.col("branch").isNotNull(), F.col("pos"))).alias("branch"), F.max("clean").alias("clean"), F.count("status").alias("files"),
        *[count(s) for s in ("modified", "added", "deleted", "untracked", "conflict")])
    return grouped.withColumn("outcome", F.when(F.col("conflict") > 0, "failed").when(F.col("files") > 0, "changed").otherwise("passed"))


def search_hits(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits of search outputs: path, line, column, text."""
    rows = lines_of(sources.filter("category = 'search'"), list(keys), F.col("clean_output")).filter(F.col("line").rlike(HIT))
    got = lambda n: F.regexp_extract("line", HIT, n)
    return rows.select(*keys, "pos", clean_patch_path(got(1)).alias("path"), got(2).cast("long").alias("line_no"), nonempty(got(3)).cast("long").alias("column_no"), trim_space(got(4)).alias("text"))


def search_outcomes(sources: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per search: hits, distinct files and found / empty / failed."""
    keys = list(keys)
    totals = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("path").alias("files"))
    rows = sources.filter("category = 'search'").join(totals, keys, "left")
    none = F.col("hits").isNull()
    bad = F.exists(command_lines(F.col("clean_output")), is_failure_line)
    failed = F.coalesce(F.col("exit_code") > 1, F.lit(False)) | ((F.col("clean_output") != "") & none & F.coalesce(F.col("exit_code") != 1, F.lit(True)) & bad)
    return rows.select(
        *keys, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("files", F.lit(0)).alias("files"),
        F.when(failed, "failed").when(none, "empty").otherwise("found").alias("outcome"))


def verification(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per test or check run: counts, duration, outcome and its key lines (all failing ones, else the telling ones or the last eight)."""
    out = F.col("clean_output")
    rows = sources.filter("category = 'verification'")
    for name, patterns in COUNT_PATTERNS.items():
        rows = rows.withColumn(f"n_{name}", F.coalesce(*[nonempty(F.regexp_extract(out, p, 1)) for p in patterns]).cast("double"))
    ms = nonempty(F.regexp_extract(out, r"(?i)#\s*duration_ms\s+([\d.]+)", 1)).try_cast("double")
    told = F.regexp_replace(F.regexp_extract(out, r"(?i)\b(?:Time|Duration)\s*[:=]?\s*([\d.]+\s*(?:ms|s|m))", 1), r"\s+", "")
    seconds = F.when(ms < 10_000, one_decimal(ms / 1000)).otherwise(F.floor(ms / 1000 + 0.5).cast("string"))
    duration = F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(ms.isNotNull(), F.concat(seconds, F.lit("s"))).otherwise(told)
    lines = command_lines(out)
    bad = F.filter(lines, is_failure_line)
    status = F.coalesce("status", F.lit("")) if "status" in sources.columns else F.lit("")
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    rows = rows.withColumns({"__lines": lines, "__bad": bad, "duration": duration})
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False)) | positive("n_fail") | positive("n_error") | (F.size("__bad") > 0)
    passed = F.coalesce(F.col("exit_code") == 0, F.lit(False)) | positive("n_pass") | out.rlike(r"(?i)\b(?:all tests? passed|tests? passed|passed)\b|验证通过|检查通过") | status.rlike("(?i)completed|success|succeeded")
    rows = rows.withColumn("outcome", F.when(failed, "failed").when(passed, "passed").otherwise("info"))
    good = F.filter("__lines", lambda x: is_success_line(x) | x.rlike(KEY_LINE))
    picked = F.when(F.col("outcome") == "failed", F.col("__bad")).otherwise(good)
    last8 = F.slice("__lines", F.greatest(F.size("__lines") - 7, F.lit(1)), 8)
    key_lines = F.when(F.size(picked) > 0, picked).otherwise(last8)
    whole = lambda c, unit: F.concat(F.col(c).cast("long").cast("string"), F.lit(unit))
    head = F.when(F.col("outcome") == "failed", "验证失败").when(F.col("outcome") == "passed", "验证通过").otherwise("验证输出")
    summary = F.concat_ws(" · ", head, whole("n_total", " tests"), whole("n_pass", " passed"), whole("n_fail", " failed"))
    return rows.select(*keys, *[F.col(f"n_{n}").cast("long").alias(n) for n in COUNT_PATTERNS], "duration", "outcome", summary.alias("summary"), key_lines.alias("key_lines"))


