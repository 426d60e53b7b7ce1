"""Tool-call summary rules: what a call does, from its tool, command and arguments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import field, text_at
from seslog.functions.text import clean_filled, fill_template, first_line, first_nonempty, joined_text, nonempty, trim_space


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    tool: str
    pattern: str
    title: str
    summary: str = ""
    enabled: bool = True


# The default rules, tried in this order.
DEFAULT_RULES = (
    Rule("pi-read-file", "Pi 读取文件", "read", r"[\s\S]*", "读取文件内容", "{path}"),
    Rule("pi-write-file", "Pi 写入文件", "write", r"[\s\S]*", "写入文件", "{path}"),
    Rule("pi-bash-rg-files", "Pi rg 列出文件", "bash", r"(?:^|\s(?:&&|\|\||[|;])\s*)rg\s+--files\b", "列出文件", "{path}"),
    Rule("pi-bash-rg-search", "Pi rg 搜索文本", "bash", r"(?:^|\s(?:&&|\|\||[|;])\s*)rg\b", "搜索文本", "{query} {path}"),
    Rule("exec-read-file-pwsh-raw-utf8", "PowerShell UTF-8 读取文件", "exec_command",
         r"\bGet-Content\b(?=[\s\S]*\b-Raw\b)(?=[\s\S]*\b-Encoding\s+UTF8\b)", "读取文件内容", "{path}"),
    Rule("exec-read-file", "读取文件", "exec_command", r"^(?:Get-Content|gc|cat|type|sed\s+-n)\b", "读取文件内容", "{path}"),
    Rule("exec-rg-files", "列出项目文件", "exec_command", r"^rg\s+--files\b", "列出文件", "{path}"),
    Rule("exec-search-text", "搜索文本", "exec_command", r"^(?:rg|grep|findstr)\b", "搜索文本", "{query} {path}"),
    Rule("exec-list-dir", "列出目录", "exec_command", r"^(?:Get-ChildItem|gci|ls|dir)\b", "列出目录", "{path}"),
    Rule("exec-verification", "运行测试或检查", "exec_command",
         r"^(?:npm|pnpm|yarn)\s+(?:run\s+)?(?:test|check|lint|typecheck)\b|^node\s+--test\b|^(?:npx\s+)?(?:pytest|vitest|jest)\b|^(?:npx\s+)?playwright\s+test\b",
         "运行验证", "{cmd}"),
    Rule("exec-build", "构建或类型检查", "exec_command",
         r"^(?:npm|pnpm|yarn)\s+(?:run\s+)?build\b|^(?:npx\s+)?tsc\b|^cargo\s+build\b|^go\s+test\b|^mvn\s+test\b|^gradle\s+test\b",
         "构建 / 类型检查", "{cmd}"),
    Rule("exec-git-status", "查看 Git 状态", "exec_command", r"^git\s+status\b", "查看 Git 状态", "{cmd}"),
    Rule("exec-git-diff", "查看 Git 差异", "exec_command", r"^git\s+(?:diff|show)\b", "查看 Git 差异", "{cmd}"),
    Rule("apply-patch", "应用补丁", "apply_patch", r"[\s\S]*", "修改文件", "{patchSummary}"),
    Rule("tool-search", "搜索可用工具", "tool_search_tool", r"[\s\S]*", "搜索可用工具", "{query}"),
)


def active_rules(custom: Iterable[Rule] = ()) -> list[Rule]:
    """Custom rules before the defaults; rules without pattern or title and disabled ones are left out."""
    usable = [r for r in custom if r.pattern.strip() and r.title.strip()]
    return [r for r in [*usable, *DEFAULT_RULES] if r.enabled]


def _compiled(pattern: str, flags: str) -> str | None:
    """Java pattern text; a /pattern/flags form brings its own flags. NULL where it does not compile."""
    slash = re.match(r"^/([\s\S]+)/([a-zA-Z]*)$", pattern)
    body, given = (slash.group(1), "i" + "".join(f for f in slash.group(2) if f in "ms")) if slash else (pattern, flags)
    try:
        re.compile(re.sub(r"\(\?<([a-zA-Z])", r"(?P<\1", body))
    except re.error:
        return None
    return f"(?{''.join(sorted(set(given)))}){body}"


def _tool_matches(rule: Rule, tool: Column) -> Column:
    wanted = rule.tool.strip()
    if wanted in ("", "*"):
        return F.lit(True)
    if re.match(r"^/[\s\S]+/[a-zA-Z]*$", wanted):
        pattern = _compiled(wanted, "i")
        return F.lit(False) if pattern is None else tool.rlike(pattern)
    return F.lower(tool) == wanted.lower()


# --- command, path and query --------------------------------------------------------------------------------------------------
SEPARATOR = r"\s(?:&&|\|\||[|;])\s?"
TOKEN = r"""(?:[^\s'"]+|'[^']*(?:'|$)|"[^"]*(?:"|$))+"""
WRAPPER = r"(?i)^(?:cmd(?:\.exe)?\s+/[cs]\s+|powershell(?:\.exe)?\s+(?:-[\w-]+\s+)*|pwsh(?:\.exe)?\s+(?:-[\w-]+\s+)*)"
SEARCH_OPTIONS = ("-g", "--glob", "-t", "--type", "-e", "--regexp", "-m", "--max-count", "-A", "-B", "-C")
POWERSHELL_OPTIONS = ("-encoding", "-filter", "-include", "-exclude", "-totalcount", "-tail")


def strip_outer_quotes(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^["'](.+)["']$""", "$1")


def strip_shell_wrapper(command: Column) -> Column:
    return trim_space(strip_outer_quotes(F.regexp_replace(trim_space(command), WRAPPER, "")))


def shell_tokens(command: Column) -> Column:
    """Blank-separated tokens; quotes group and disappear, an unclosed quote runs to the end."""
    found = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"""'([^']*)(?:'|$)|"([^"]*)(?:"|$)""", "$1$2"))
    return F.filter(bare, lambda t: t != "")


def non_option_tokens(tokens: Column, value_options: Sequence[str]) -> Column:
    """Tokens that are neither options nor the value of an option that takes one (compared in lower case)."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def add(acc: Column, token: Column) -> Column:
        option = token.startswith("-")
        keep = ~acc["skip"] & ~option & ~token.isin("|", "&&", ";")
        return F.struct(
            F.when(keep, F.concat(acc["kept"], F.array(strip_outer_quotes(token)))).otherwise(acc["kept"]).alias("kept"),
            (~acc["skip"] & option & F.lower(token).isin(*value_options)).alias("skip"))

    return F.aggregate(tokens, start, add, lambda acc: acc["kept"])


def with_call_context(calls: DataFrame) -> DataFrame:
    """Adds command, path and query of each call (columns name, arguments, optional summary)."""
    args, tool = F.coalesce("arguments", F.lit("")), trim_space(F.coalesce("name", F.lit("")))
    doc = F.try_parse_json(F.when(trim_space(args).rlike(r"^[{\[]"), trim_space(args)))
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    summary = F.coalesce("summary", F.lit("")) if "summary" in calls.columns else F.lit("")

    def scalar(key: str) -> Column:
        value = field(doc, key)
        return F.when(is_object & ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), text_at(doc, key))

    given = F.coalesce(*[trim_space(scalar(k)) for k in ("cmd", "command", "script", "shellCommand", "code", "query")])
    command = F.coalesce(given, F.when(tool.rlike("(?i)apply_patch"), first_line(args, 260)).otherwise(trim_space(args)))
    own_path = F.coalesce(*[nonempty(trim_space(F.when(is_object & (F.schema_of_variant(field(doc, k)) == "STRING"), text_at(doc, k))))
                            for k in ("path", "filePath", "filepath", "targetPath", "outputPath")])
    own_query = F.coalesce(*[nonempty(scalar(k)) for k in ("query", "q", "pattern", "search")])
    rows = calls.withColumns({
        "command": command, "__own_path": strip_outer_quotes(own_path), "__own_query": own_query,
        "workdir": F.coalesce(nonempty(scalar("workdir")), nonempty(scalar("cwd")), F.lit("")), "__summary": summary,
    })
    pieces = F.filter(F.transform(F.split("command", SEPARATOR), lambda p: trim_space(p)), lambda p: p != "")
    searched = F.get(F.filter(pieces, lambda p: strip_shell_wrapper(p).rlike(r"(?i)^rg\b")), 0)
    chosen = F.coalesce(F.when(F.lower(tool) == "bash", searched), F.get(pieces, 0), F.lit(""))
    rows = rows.withColumn("__tokens", shell_tokens(strip_shell_wrapper(chosen)))
    rest = F.slice("__tokens", 2, 2**30)
    base = F.lower(F.element_at(F.split(F.coalesce(F.get("__tokens", 0), F.lit("")), r"[\\/]+"), -1))
    rows = rows.withColumns({
        "__base": base, "__plain": non_option_tokens(rest, ()), "__found": non_option_tokens(rest, [o.lower() for o in SEARCH_OPTIONS if o == o.lower()]),
        "__shell": non_option_tokens(rest, POWERSHELL_OPTIONS), "__rest": rest,
        "__flag": F.get(F.filter(F.transform(rest, lambda t, i: F.when(F.lower(t).isin("-literalpath", "-path"), F.get(rest, i + 1))), lambda t: nonempty(t).isNotNull()), 0),
    })
    last = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1))
    found = F.col("__found")
    search_path = F.when(
        (F.col("__base") == "rg") & F.array_contains("__rest", "--files"), F.coalesce(last(found), F.lit("."))
    ).when(F.size(found) > 1, F.array_join(F.slice(found, 2, 2**30), " "))
    command_path = (
        F.when(F.col("__base").isin("get-content", "gc", "cat", "type"), F.coalesce(strip_outer_quotes(F.col("__flag")), last(F.col("__shell"))))
        .when(F.col("__base").isin("get-childitem", "gci", "ls", "dir"), F.coalesce(last(F.col("__plain")), F.lit(".")))
        .when(F.col("__base").isin("rg", "grep", "findstr"), search_path).when(F.col("__base") == "sed", last(F.col("__plain"))))
    needle = F.get(F.filter(found, lambda t: t != "--files"), 0)
    query = F.coalesce(
        F.col("__own_query"), F.when(F.col("__base").isin("rg", "grep", "findstr"), F.coalesce(needle, F.lit(""))), F.col("__summary"))
    temporary = [c for c in rows.columns if c.startswith("__")]
    return rows.withColumns({
        "path": F.coalesce(nonempty(F.col("__own_path")), nonempty(command_path), F.lit("")), "query": first_line(query, 120),
    }).drop(*temporary)


def classify(calls: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """First matching rule of each call with its filled title and summary; unmatched calls keep a fallback summary.

    ``calls`` comes from with_call_context and may carry title, summary, output and patch_summary. The rules are few
    and known when the plan is made, so they become one ordered chain of conditions that stays in the scan stage.
    ``rule_summary`` is for display, at most 220 characters; ``target`` is whole, so calls that differ late stay apart.
    """
    have = set(calls.columns)
    opt = lambda c: F.coalesce(c, F.lit("")) if c in have else F.lit("")
    tool = trim_space(F.coalesce("name", F.lit("")))
    text = joined_text(F.col("command"), F.coalesce("arguments", F.lit("")), opt("summary"), opt("title"))
    rows = calls.withColumns({"__text": text, "__tool": tool})
    number, usable = None, []
    for rule in active_rules() if rules is None else rules:
        pattern = _compiled(rule.pattern, "is")
        if pattern is None:
            continue
        condition = _tool_matches(rule, F.col("__tool"))
        if rule.pattern != r"[\s\S]*":
            condition = condition & F.col("__text").rlike(pattern)
        number = F.when(condition, len(usable)) if number is None else number.when(condition, len(usable))
        usable.append((rule, pattern))
    # Higher-level picks by number keep the regular expressions evaluated once.
    rows = rows.withColumn("__rule", number)
    pick = lambda attribute: F.get(F.array(*[F.lit(getattr(r, attribute)) for r, _ in usable]), F.col("__rule"))
    output = opt("output")
    values = {
        "tool": F.col("__tool"), "toolName": F.col("__tool"), "cmd": F.col("command"), "command": F.col("command"), "path": F.col("path"),
        "basename": F.element_at(F.split("path", r"[\\/]+"), -1), "query": F.col("query"), "workdir": opt("workdir"), "patchSummary": opt("patch_summary"),
        "outputChars": F.when(output != "", F.length(output).cast("string")), "outputLines": F.when(output != "", F.size(F.split(output, r"\r?\n")).cast("string")),
    }
    for index in sorted({int(i or 0) for r, _ in usable for i in re.findall(r"\{match(\d?)\}", r.title + r.summary)}):
        chain = None
        for n, (_, pattern) in enumerate(usable):
            got = F.regexp_extract("__text", pattern, index) if re.compile(re.sub(r"\(\?<([a-zA-Z])", r"(?P<\1", pattern)).groups >= index else F.lit("")
            chain = F.when(F.col("__rule") == n, got) if chain is None else chain.when(F.col("__rule") == n, got)
        values[f"match{index}"] = chain
        if index == 0:
            values["match"] = chain
    templates = " ".join(r.title + r.summary for r, _ in usable)
    values = {k: v for k, v in values.items() if "{" + k + "}" in templates}
    rows = rows.withColumn("rule_title", clean_filled(fill_template(pick("title"), values)))
    fallback = first_line(first_nonempty(F.col("command"), F.coalesce("arguments", F.lit("")), opt("summary")))
    filled = clean_filled(fill_template(pick("summary"), {**values, "title": F.col("rule_title")}))
    matched = F.col("__rule").isNotNull()
    return rows.withColumns({
        "matched": matched, "rule_id": pick("id"), "rule_label": pick("label"),
        "rule_title": F.when(matched, F.coalesce(nonempty(F.col("rule_title")), nonempty(F.col("__tool")), F.lit("工具调用"))),
        "__whole": first_line(
            F.when(matched, F.coalesce(nonempty(filled), nonempty(F.col("path")), nonempty(F.col("query")), fallback))
            .otherwise(first_nonempty(F.col("command"), F.coalesce("arguments", F.lit("")), opt("summary"), output))),
    }).withColumn("rule_summary", first_line(F.col("__whole"), 220)).withColumn("target", F.coalesce(nonempty(F.col("__whole")), nonempty(F.col("path")), nonempty(F.col("command")), nonempty(F.col("__tool")), F.lit("工具调用"))).drop(
        "__text", "__tool", "__rule", "__whole")
