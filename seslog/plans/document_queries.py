"""Queries over documents and pages: redaction, text helpers, tool-call rules and tables read from tool texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seslog.functions import redact
from seslog.functions import text as tx
from seslog.functions.ordered import positions
from seslog.functions.staging import stage
from seslog.operators import outputs as op
from seslog.operators import rules as rl
from seslog.operators import stats
from seslog.plans.registry import query
from seslog.plans.views import table, with_ctes

# One tool call per document, its kind by doc_id; the document is the call's output.
PATCH_SQL = """'*** Begin Patch' || chr(10) || '*** Update File: src/f' || doc_id % 50 || '.py' || chr(10) || '@@ x' || chr(10) || ' keep' || chr(10) || '-old' || chr(10)
  || '+new' || chr(10) || '+more' || chr(10) || '*** Add File: b/new' || doc_id || '.md' || chr(10) || '+one' || chr(10) || '*** Update File: old.txt' || chr(10) || '*** Move to: kept.txt' || chr(10) || '*** End Patch'"""
CALLS_SQL = f"""doc_calls AS (
  SELECT doc_id, source AS session_id, text AS output, lang, CASE doc_id % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'bash' WHEN 4 THEN 'apply_patch' ELSE 'exec_command' END AS name,
    CASE doc_id % 6 WHEN 0 THEN '{{"path":"' || source || '/' || doc_id % 40 || '.txt"}}' WHEN 1 THEN '{{"command":"cd x && rg -n -g *.py ''a b'' src/' || source || '"}}'
      WHEN 2 THEN '{{"cmd":"git status --short"}}' WHEN 3 THEN '{{"cmd":"npm run test"}}' WHEN 4 THEN {PATCH_SQL} ELSE '{{"cmd":"cat ''my dir/' || source || '.txt''"}}' END AS arguments
  FROM documents)"""


def doc_calls(spark, sf):
    n, doc, source = F.col("doc_id") % 6, F.col("doc_id").cast("string"), F.col("source")
    patch = F.concat(
        F.lit("*** Begin Patch\n*** Update File: src/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".py\n@@ x\n keep\n-old\n+new\n+more\n*** Add File: b/new"), doc,
        F.lit(".md\n+one\n*** Update File: old.txt\n*** Move to: kept.txt\n*** End Patch"))
    arguments = (
        F.when(n == 0, F.concat(F.lit('{"path":"'), source, F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit('.txt"}')))
        .when(n == 1, F.concat(F.lit("{\"command\":\"cd x && rg -n -g *.py 'a b' src/"), source, F.lit('"}'))).when(n == 2, '{"cmd":"git status --short"}')
        .when(n == 3, '{"cmd":"npm run test"}').when(n == 4, patch).otherwise(F.concat(F.lit("{\"cmd\":\"cat 'my dir/"), source, F.lit(".txt'\"}"))))
    return table(spark, sf, "documents").select(
        "doc_id", source.alias("session_id"), F.col("text").alias("output"), "lang",
        F.when(n == 0, "read").when(n == 1, "bash").when(n == 4, "apply_patch").otherwise("exec_command").alias("name"), arguments.alias("arguments"))


def classified(spark, sf, rules=None):
    calls = doc_calls(spark, sf)
    summaries = op.patch_summaries(op.file_changes(calls.filter("name = 'apply_patch'").withColumn("output", F.lit("")), ["doc_id"]), ["doc_id"])
    return rl.classify(rl.with_call_context(calls).join(summaries, "doc_id", "left"), rules)


MATCH_SQL = """m AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'pi-read-file' WHEN 1 THEN 'pi-bash-rg-search' WHEN 2 THEN 'exec-git-status' WHEN 3 THEN 'exec-verification' WHEN 4 THEN 'apply-patch' ELSE 'exec-read-file' END AS rule_id,
    CASE doc_id % 6 WHEN 0 THEN '读取文件内容' WHEN 1 THEN '搜索文本' WHEN 2 THEN '查看 Git 状态' WHEN 3 THEN '运行验证' WHEN 4 THEN '修改文件' ELSE '读取文件内容' END AS rule_title,
    CASE doc_id % 6 WHEN 0 THEN session_id || '/' || doc_id % 40 || '.txt' WHEN 1 THEN 'a b src/' || session_id WHEN 2 THEN 'git status --short' WHEN 3 THEN 'npm run test'
      WHEN 4 THEN '3 个文件 · +3 -1 · src/f' || doc_id % 50 || '.py, new' || doc_id || '.md, old.txt -> kept.txt' ELSE 'my dir/' || session_id || '.txt' END AS target FROM doc_calls)"""


@query("k1_rule_classification", with_ctes(CALLS_SQL, MATCH_SQL, "SELECT doc_id, rule_id, rule_title, target FROM m"))
def k1(spark, sf):
    return classified(spark, sf).select("doc_id", "rule_id", "rule_title", "target")


CUSTOM = (
    rl.Rule("own-tests", "Own", "/exec.*/", r"npm run (\w+)", "Ran {match1}", "{cmd} {nothing} :"),
    rl.Rule("broken", "Broken", "*", "(", "never"), rl.Rule("no-title", "x", "*", ".*", " "), rl.Rule("off", "x", "*", ".*", "off", enabled=False),
)


@query("k2_custom_rules", with_ctes(CALLS_SQL, MATCH_SQL, """SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'own-tests' ELSE rule_id END AS rule_id,
  CASE WHEN doc_id % 6 = 3 THEN 'Ran test' ELSE rule_title END AS rule_title, target FROM m"""))
def k2(spark, sf):
    return classified(spark, sf, rl.active_rules(CUSTOM)).select("doc_id", "rule_id", "rule_title", "target")


@query("k4_command_path_query", with_ctes(CALLS_SQL, """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN arguments WHEN 1 THEN 'cd x && rg -n -g *.py ''a b'' src/' || session_id WHEN 2 THEN 'git status --short' WHEN 3 THEN 'npm run test'
   WHEN 4 THEN trim(regexp_replace(arguments, '\\s+', ' ', 'g')) WHEN 5 THEN 'cat ''my dir/' || session_id || '.txt''' END AS command, CASE doc_id % 6 WHEN 0 THEN session_id || '/' || doc_id % 40 || '.txt' WHEN 1 THEN 'src/' || session_id WHEN 5 THEN 'my dir/' || session_id || '.txt' ELSE '' END AS path,
   CASE doc_id % 6 WHEN 1 THEN 'a b' ELSE '' END AS "query" FROM doc_calls"""))
def k4(spark, sf):
    return rl.with_call_context(doc_calls(spark, sf)).select("doc_id", "command", "path", "query")


@query("k5_file_changes", with_ctes(CALLS_SQL, """p AS (SELECT doc_id FROM doc_calls WHERE name = 'apply_patch')""",
  """SELECT doc_id, 'src/f' || doc_id % 50 || '.py' AS path, '' AS old_path, 'modified' AS status, 2 AS additions, 1 AS deletions, 1 AS hunks FROM p
  UNION ALL SELECT doc_id, 'new' || doc_id || '.md', '', 'added', 1, 0, 0 FROM p UNION ALL SELECT doc_id, 'kept.txt', 'old.txt', 'renamed', 0, 0, 0 FROM p
  UNION ALL SELECT doc_id, 'extra.txt', '', 'deleted', 0, 0, 0 FROM p"""))
def k5(spark, sf):
    calls = doc_calls(spark, sf).filter("name = 'apply_patch'")
    told = calls.withColumn("output", F.concat(F.lit("Success\nM src/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".py\n D extra.txt ")))
    return op.file_changes(told, ["doc_id"]).drop("ord")


@query("k6_patch_lines", with_ctes(CALLS_SQL, """p AS (SELECT doc_id FROM doc_calls WHERE name = 'apply_patch'), l(file_no, pos, kind, text) AS (VALUES (1, 2, 'hunk', '@@ x'), (1, 3, 'context', 'keep'),
  (1, 4, 'removed', 'old'), (1, 5, 'added', 'new'), (1, 6, 'added', 'more'), (2, 8, 'added', 'one'))""", "SELECT doc_id, file_no, pos, kind, text FROM p, l"))
def k6(spark, sf):
    return op.patch_lines(doc_calls(spark, sf).filter("name = 'apply_patch'"), ["doc_id"]).drop("path")


def _git_calls(spark, sf):
    n = F.col("doc_id").cast("string")
    output = F.concat(
        F.lit("Chunk ID: 1\nOn branch main\nChanges to be committed:\n  (use \"git restore\")\n\tnew file:   a"), n, F.lit(".py\nChanges not staged for commit:\n\tmodified:   \"b.py\"\n\tdeleted:    c.py\nUntracked files:\n  (use \"git add\")\n\td"), n, F.lit("/\n"))
    clean = F.lit("On branch dev\nnothing to commit, working tree clean\nProcess exited with code 0")
    return table(spark, sf, "documents").select("doc_id", F.lit("git status").alias("command"), F.when(F.col("doc_id") % 3 == 0, clean).otherwise(output).alias("output"))


@query("k7_git_status", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'main' END AS branch, doc_id % 3 = 0 AS clean, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END AS files, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS modified,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS added, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS deleted, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS untracked, 0 AS conflict,
  CASE WHEN doc_id % 3 = 0 THEN 'passed' ELSE 'changed' END AS outcome FROM documents""")
def k7(spark, sf):
    return op.git_status(op.git_status_lines(op.command_sources(_git_calls(spark, sf)), ["doc_id"]), ["doc_id"])


@query("k7_git_status_files", """SELECT doc_id, u.status, CASE u.status WHEN 'added' THEN 'a' || doc_id || '.py' WHEN 'modified' THEN 'b.py' WHEN 'deleted' THEN 'c.py' ELSE 'd' || doc_id || '/' END AS path,
  CASE u.status WHEN 'added' THEN 'staged' WHEN 'untracked' THEN 'untracked' ELSE 'unstaged' END AS scope FROM documents, (VALUES ('added'), ('modified'), ('deleted'), ('untracked')) u(status) WHERE doc_id % 3 <> 0""")
def k7_files(spark, sf):
    return op.git_status_lines(op.command_sources(_git_calls(spark, sf)), ["doc_id"]).filter("status IS NOT NULL").select("doc_id", "status", "path", "scope")


SEARCH_SQL = """w AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 4 <> 0)"""


def _search_calls(spark, sf):
    hits = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("src/f"), ((i + 1) % 3).cast("string"), F.lit(".py:"), (i + 1).cast("string"), F.lit(":7: "), F.trim(F.regexp_replace(line, r"\s+", " ")))), "\n")
    return table(spark, sf, "documents").select(
        "doc_id", F.lit("rg -n x src").alias("command"), F.when(F.col("doc_id") % 4 == 0, "Process exited with code 1").otherwise(hits).alias("output"))


@query("k8_search_hits", with_ctes(SEARCH_SQL, """SELECT doc_id, 'src/f' || n % 3 || '.py' AS path, CAST(n AS BIGINT) AS line_no, CAST(7 AS BIGINT) AS column_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM w"""))
def k8(spark, sf):
    return op.search_hits(op.command_sources(_search_calls(spark, sf)), ["doc_id"]).drop("pos")


@query("k8_search_outcomes", with_ctes(SEARCH_SQL, """SELECT d.doc_id, count(n) AS hits, count(DISTINCT CASE WHEN n IS NOT NULL THEN n % 3 END) AS files, CASE WHEN count(n) > 0 THEN 'found' ELSE 'empty' END AS outcome
  FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1"""))
def k8_outcomes(spark, sf):
    sources = op.command_sources(_search_calls(spark, sf))
    return op.search_outcomes(sources, op.search_hits(sources, ["doc_id"]), ["doc_id"])


@query("k9_verification_outcome", """SELECT doc_id, doc_id % 50 + 3 AS total, doc_id % 50 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS pass, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END AS fail, '2.5s' AS duration,
  CASE WHEN doc_id % 2 = 0 THEN 'passed' ELSE 'failed' END AS outcome, CASE WHEN doc_id % 2 = 0 THEN '验证通过' ELSE '验证失败' END || ' · ' || (doc_id % 50 + 3) || ' tests · ' || (doc_id % 50 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END)
  || ' passed · ' || CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END || ' failed' AS summary FROM documents""")
def k9(spark, sf):
    total = (F.col("doc_id") % 50 + 3).cast("string")
    good = F.col("doc_id") % 2 == 0
    passed = (F.col("doc_id") % 50 + F.when(good, 3).otherwise(1)).cast("string")
    output = F.concat(F.lit("TAP version 13\n"), F.when(good, "ok 1 - a").otherwise("not ok 1 - a"), F.lit("\n# tests "), total, F.lit("\n# pass "), passed, F.lit("\n# fail "), F.when(good, "0").otherwise("2"), F.lit("\n# duration_ms 2480.5"))
    calls = table(spark, sf, "documents").select("doc_id", F.lit("node --test").alias("command"), output.alias("output"))
    return op.verification(op.command_sources(calls), ["doc_id"]).drop("error", "key_lines")


@query("k10_output_sources", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'git_status' WHEN 1 THEN 'search' WHEN 2 THEN 'verification' END AS category, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 END AS exit_code,
  CASE doc_id % 4 WHEN 3 THEN 'plain words' ELSE 'line one' || chr(10) || 'line two' END AS clean_output FROM documents""")
def k10(spark, sf):
    n = F.col("doc_id") % 4
    output = F.concat(F.lit("Chunk ID: 9f\nWall time: 1s\nProcess exited with code "), n.cast("string"), F.lit("\nOutput:\nline one\nline two\n"))
    calls = table(spark, sf, "documents").select(
        "doc_id", F.when(n == 0, "git status").when(n == 1, "pwsh -NoProfile grep x").when(n == 2, "npm test && echo").otherwise("echo").alias("command"),
        F.when(n == 3, "plain words").otherwise(output).alias("output"))
    return op.command_sources(calls).select("doc_id", "category", "exit_code", "clean_output")


@query("k11_readable_output", """WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, len(string_split(text, chr(10))) AS lines FROM documents),
 s AS (SELECT *, CASE WHEN length(flat) > 160 THEN substr(flat, 1, 159) || '…' ELSE flat END AS start FROM f),
 l AS (SELECT *, '工具输出 · ' || lines || ' 行 / ' || length(text) || ' 字符' || CASE WHEN start <> '' THEN ' · ' || start ELSE '' END AS line FROM s)
 SELECT doc_id, CASE WHEN text = '' THEN '工具输出 · 无输出' WHEN length(line) > 240 THEN substr(line, 1, 239) || '…' ELSE line END AS line FROM l""")
def k11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.readable_output(F.col("text"), "工具输出").alias("line"))


@query("e4_operation_breakdown", with_ctes(CALLS_SQL, MATCH_SQL, """SELECT 'function_call_output' AS kind, rule_id, count(*) AS n, CAST(sum(CASE WHEN length(output) > 0 THEN greatest(1, ceil(length(output) / 4.0)) ELSE 0 END) AS BIGINT) AS approx_tokens,
  CAST(sum(length(output)) AS BIGINT) AS approx_bytes FROM m GROUP BY rule_id"""))
def e4(spark, sf):
    rows = classified(spark, sf).select(
        F.lit("function_call_output").alias("kind"), "rule_id", tx.char_tokens(F.col("output")).alias("approx_tokens"), F.length("output").alias("approx_bytes"))
    return stats.operation_breakdown(rows)


TOOL_SQL = """SELECT rule_id, target, count(*) AS n, CAST(sum(octet_length(encode(arguments))) AS BIGINT) AS argument_bytes, CAST(sum(octet_length(encode(output))) AS BIGINT) AS output_bytes,
  CAST(sum(CASE WHEN length(arguments) > 0 THEN greatest(1, ceil(length(arguments) / 4.0)) ELSE 0 END + CASE WHEN length(output) > 0 THEN greatest(1, ceil(length(output) / 4.0)) ELSE 0 END) AS BIGINT) AS context_tokens,
  CAST(max(octet_length(encode(output))) AS BIGINT) AS max_output_bytes, arg_max(doc_id, (octet_length(encode(output)), doc_id)) AS primary_event, count(DISTINCT doc_id) AS n_events,
  round(sum(CASE WHEN length(arguments) > 0 THEN greatest(1, ceil(length(arguments) / 4.0)) ELSE 0 END + CASE WHEN length(output) > 0 THEN greatest(1, ceil(length(output) / 4.0)) ELSE 0 END) / 200000.0 * 100, 6) AS window_share FROM m GROUP BY ALL"""


def tool_statistics(spark, sf):
    rows = classified(spark, sf).withColumns({"event_index": F.col("doc_id"), "ord": F.col("doc_id")})
    return stats.tool_context_statistics(rows, F.lit(200_000))


@query("e6_tool_context", with_ctes(CALLS_SQL, MATCH_SQL, TOOL_SQL))
def e6(spark, sf):
    return tool_statistics(spark, sf).drop("max_output_tokens", "max_output_share").withColumn("window_share", F.round("window_share", 6))


E7_ORDERS = {"context-share": "window_share DESC", "max-output": "max_output_bytes DESC", "target": "target", "output-bytes": "output_bytes DESC"}


@query("e7_tool_sort_orders", with_ctes(CALLS_SQL, MATCH_SQL, f"t AS ({TOOL_SQL})", " UNION ALL ".join(
    f"SELECT '{name}' AS sort, row_number() OVER (ORDER BY {first}, context_tokens DESC, target, rule_id) - 1 AS position, rule_id, target, context_tokens FROM t" for name, first in E7_ORDERS.items())))
def e7(spark, sf):
    """All rows in each of the four orders, with their places."""
    rows = stage(tool_statistics(spark, sf))
    placed = [positions(stats.sort_tool_statistics(rows, name)).withColumn("sort", F.lit(name)) for name in E7_ORDERS]
    all_orders = placed[0]
    for other in placed[1:]:
        all_orders = all_orders.unionByName(other)
    return all_orders.select("sort", "position", "rule_id", "target", "context_tokens")


@query("b10_data_uri_redaction", """SELECT doc_id, text || ' [redacted data URI image/png ~' || (doc_id % 7 * 3 + 3) || ' bytes] [redacted data URI application/octet-stream ~' || (doc_id % 5 + 1) || ' bytes]' AS text FROM documents""")
def b10(spark, sf):
    image = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("QUJD"), (F.col("doc_id") % 7 + 1).cast("int")))
    plain = F.concat(F.lit("data:,"), F.repeat(F.lit("x"), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", redact.redact_data_uris(F.concat_ws(" ", "text", image, plain)).alias("text"))


@query("b11_redacted_json", """SELECT doc_id, '{"encrypted_content":"[encrypted_content redacted length=' || n_chars % 90 || ']","image":"[redacted data URI image/gif ~3 bytes]"}' AS record FROM documents""")
def b11(spark, sf):
    record = F.to_json(F.struct(F.repeat(F.lit("z"), (F.col("n_chars") % 90).cast("int")).alias("encrypted_content"), F.lit("data:image/gif;base64,QUJD").alias("image")))
    return table(spark, sf, "documents").select("doc_id", redact.redact_json(record).alias("record"))


@query("b24_secret_redaction", """WITH m AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS line FROM documents),
u AS (SELECT doc_id, regexp_replace('https://user:pw' || doc_id || '@host/ Authorization: Bearer abc.def token: s3cret bearer XYZ | ' || line, '([a-zA-Z0-9+.-]://)[^@/\\s]+@', '\\1[redacted]@', 'g') AS line FROM m),
h AS (SELECT doc_id, regexp_replace(regexp_replace(line, 'authorization\\s*[=:]\\s*bearer\\s+[a-z0-9._~+/=-]+', chr(1), 'gi'), 'bearer\\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi') AS line FROM u)
SELECT doc_id, trim(replace(regexp_replace(regexp_replace(line, 'token[=:]\\s*\\S+', 'token=[redacted]', 'gi'), 'authorization[=:]\\s*\\S+', 'authorization=[redacted]', 'gi'), chr(1), 'authorization=Bearer [redacted]'), chr(13) || ' ') AS message FROM h""")
def b24(spark, sf):
    """Each text behind a line of credentials of its own: the first line of the text is redacted, too."""
    message = F.concat(
        F.lit("\n https://user:pw"), F.col("doc_id").cast("string"), F.lit("@host/ Authorization: Bearer abc.def token: s3cret bearer XYZ | "),
        F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", tx.redact_secrets(message).alias("message"))


@query("s1_first_line", """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents) SELECT doc_id, flat AS normalized, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 59) || '…' ELSE flat END AS first_line FROM f""")
def s1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"), tx.first_line(F.col("text"), 60).alias("first_line"))


@query("s3_token_estimates", """SELECT doc_id, CASE WHEN text <> '' THEN CAST(greatest(1, ceil(octet_length(encode(text)) / 4.0)) AS BIGINT) END AS byte_tokens, CASE WHEN text <> '' THEN CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) ELSE 0 END AS char_tokens FROM documents""")
def s3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.byte_tokens(F.col("text")).alias("byte_tokens"), tx.char_tokens(F.col("text")).alias("char_tokens"))


@query("s7_fence_size", """SELECT doc_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0) + 1) AS fence FROM (SELECT doc_id, text || repeat('`', CAST(doc_id % 6 AS INT)) || 'x``' AS body FROM documents)""")
def s7(spark, sf):
    body = F.concat(F.col("text"), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit("x``"))
    return table(spark, sf, "documents").select("doc_id", tx.fence_size(body).alias("fence"))


PATHS_SQL = """p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', '') END AS cwd FROM pages)"""


def page_paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "").otherwise(path).alias("cwd"), (F.col("page_id") * 1000).alias("changed_ms"))


@query("e19_directory_rollup", with_ctes(PATHS_SQL, """s AS (SELECT page_id, list_filter(string_split(cwd, '/'), lambda x: x <> '') AS parts FROM p)""",
  """x AS (SELECT page_id, CASE WHEN len(parts) = 0 THEN '__projectless__' ELSE '/' || array_to_string(parts[1:k], '/') END AS path FROM s, range(1, 30) r(k) WHERE k <= greatest(len(parts), 1))""",
  "SELECT path, count(*) AS sessions, max(page_id) * 1000 AS latest_ms FROM x GROUP BY path"))
def e19(spark, sf):
    return stats.directory_tree(page_paths(spark, sf))


@query("s6_short_paths", with_ctes(PATHS_SQL, """s AS (SELECT page_id, cwd, list_filter(string_split(cwd, '/'), lambda x: x <> '') AS parts FROM p)""",
  """SELECT page_id, CASE WHEN len(parts) <= 3 THEN cwd ELSE parts[1] || '/' || parts[2] || '/…/' || parts[-1] END AS short, regexp_replace(cwd, '[<>:"/\\\\|?*]', '_', 'g') AS file_name FROM s"""))
def s6(spark, sf):
    return page_paths(spark, sf).select("page_id", tx.short_path(F.col("cwd")).alias("short"), tx.clean_file_name(F.col("cwd")).alias("file_name"))
