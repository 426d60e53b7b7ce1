"""Queries over the catalog, edge and tree views."""

from __future__ import annotations

from pyspark.sql import functions as F

from seslog.functions import text as tx
from seslog.functions.ordered import DAY_MS
from seslog.operators import catalog as cat
from seslog.operators import tree as tr
from seslog.plans.registry import query
from seslog.plans.views import (
    CATALOG_SQL, EDGES_SQL, EVT_EVENTS_SQL, TREE_SQL, catalog, edges, evt_rows, millis, table, tree, with_ctes,
)

SINCE = 820_454_400_000  # 1996-01-01
BEFORE = 883_612_800_000  # 1998-01-01
NOW = 1_704_153_600_000  # 2024-01-02, inside the timed events


def cat_sql(body: str) -> str:
    return with_ctes(CATALOG_SQL, EDGES_SQL, body)


@query("a10_root_threads", cat_sql(f"""SELECT id, title, changed_ms FROM catalog
  WHERE id NOT IN (SELECT child_id FROM edges) AND changed_ms >= {SINCE} AND (changed_ms < {BEFORE} OR changed_ms IS NULL)"""))
def a10(spark, sf):
    rows = cat.root_threads(catalog(spark, sf), edges(spark, sf), SINCE, BEFORE)
    return rows.select("id", "title", "changed_ms")


@query("a11_threads_by_id", cat_sql("""SELECT c.id, c.title, c.changed_ms FROM catalog c
  WHERE id IN (SELECT parent_id FROM edges)"""))
def a11(spark, sf):
    wanted = edges(spark, sf).select(F.col("parent_id").alias("id"))
    return catalog(spark, sf).join(wanted, "id", "left_semi").select("id", "title", "changed_ms")


@query("d1_root_sessions", cat_sql("""SELECT id, owner FROM catalog
  WHERE id NOT IN (SELECT child_id FROM edges) AND NOT (owner % 11 = 0)"""))
def d1(spark, sf):
    rows = cat.roots_only(catalog(spark, sf), edges(spark, sf), F.col("owner") % 11 == 0)
    return rows.select("id", "owner")


@query("d2_parents_that_are_not_children", cat_sql("""SELECT id FROM catalog
  WHERE id IN (SELECT parent_id FROM edges) AND id NOT IN (SELECT child_id FROM edges)"""))
def d2(spark, sf):
    return cat.with_relations(catalog(spark, sf), edges(spark, sf), is_child=False, has_children=True).select("id")


HIER_SQL = """threads AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, n_name AS title FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region),
hedges AS (SELECT CAST(n_regionkey AS BIGINT) AS parent_id, CAST(n_nationkey + 100 AS BIGINT) AS child_id FROM nation)"""


def _hier(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = (F.col("n_nationkey") + 100).cast("bigint")
    threads = nation.select(key.alias("id"), F.col("n_name").alias("title")).unionByName(
        region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("title"))
    )
    return threads, nation.select(F.col("n_regionkey").cast("bigint").alias("parent_id"), key.alias("child_id"))


@query("d4_hierarchy", with_ctes(HIER_SQL, """SELECT t.id, t.title, e.parent_id, p.title AS parent_title,
  (SELECT count(*) FROM hedges x WHERE x.parent_id = t.id) AS n_children,
  (SELECT count(*) FROM hedges x WHERE x.parent_id = e.parent_id) AS n_siblings
  FROM threads t LEFT JOIN hedges e ON e.child_id = t.id LEFT JOIN threads p ON p.id = e.parent_id"""))
def d4(spark, sf):
    return tr.hierarchy(*_hier(spark, sf))


@query("d4_siblings_of_thread", with_ctes(HIER_SQL, """SELECT e.child_id AS id, t.title, e.child_id = 107 AS active
  FROM hedges e JOIN threads t ON t.id = e.child_id WHERE e.parent_id = (SELECT min(parent_id) FROM hedges WHERE child_id = 107)"""))
def d4_siblings(spark, sf):
    return tr.siblings_of(*_hier(spark, sf), 107)


UP_SQL = TREE_SQL + """,
up AS (
  SELECT id, parent_id AS ancestor_id, 1 AS distance FROM tree WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT up.id, t.parent_id, distance + 1 FROM up JOIN tree t ON t.id = up.ancestor_id
  WHERE t.parent_id IS NOT NULL)"""


def up_sql(body: str) -> str:
    return "WITH RECURSIVE " + UP_SQL + "\n" + body


@query("d5_fork_lineage", up_sql("SELECT id, distance, ancestor_id FROM up"))
def d5(spark, sf):
    return tr.lineage(tree(spark, sf))


@query("d6_chain_order", "WITH RECURSIVE " + TREE_SQL + """,
down AS (
  SELECT id, id AS root_id, 0 AS depth, [{'a': CAST(0 AS BIGINT), 'b': CAST(id AS BIGINT)}] AS path FROM tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, root_id, depth + 1, list_append(path, {'a': CAST(t.size AS BIGINT), 'b': CAST(t.id AS BIGINT)})
  FROM down JOIN tree t ON t.parent_id = down.id AND t.id <> down.id)
SELECT id, root_id, depth, row_number() OVER (ORDER BY path) - 1 AS position FROM down""")
def d6(spark, sf):
    return tr.chain_order(tree(spark, sf).withColumn("list_pos", F.col("id")), "size", "list_pos")


@query("e22_subtree_totals", up_sql(""", closed AS (SELECT id, id AS ancestor_id FROM tree UNION ALL SELECT id, ancestor_id FROM up)
SELECT ancestor_id AS id, count(*) AS threads, CAST(sum(size) AS BIGINT) AS turns,
       CAST(sum(CASE WHEN brand = 'Brand#2' THEN 1 ELSE 0 END) AS BIGINT) AS compactions
FROM closed JOIN tree USING (id) GROUP BY ancestor_id"""))
def e22(spark, sf):
    return tr.subtree_totals(
        tree(spark, sf), {"turns": F.col("size"), "compactions": F.when(F.col("brand") == "Brand#2", 1).otherwise(0)}
    )


@query("g5_trace_filter_keeps_ancestors", up_sql("""SELECT DISTINCT t.id, t.title, t.kind FROM tree t
  WHERE t.title LIKE '%bolt%' AND t.size = 7
     OR t.id IN (SELECT ancestor_id FROM up JOIN tree h ON h.id = up.id WHERE h.title LIKE '%bolt%' AND h.size = 7)"""))
def g5(spark, sf):
    hit = F.col("title").contains("bolt") & (F.col("size") == 7)
    return tr.keep_with_ancestors(tree(spark, sf), hit).select("id", "title", "kind")


@query("g11_included_children", "WITH RECURSIVE " + TREE_SQL + """,
walk AS (
  SELECT t.id AS root_id, c.id, 1 AS depth, c.id % 7 <> 0 AS present FROM tree t JOIN tree c ON c.parent_id = t.id AND c.id <> t.id
  UNION ALL
  SELECT root_id, c.id, depth + 1, c.id % 7 <> 0 FROM walk JOIN tree c ON c.parent_id = walk.id AND c.id <> walk.id
  WHERE present AND depth < 4)
SELECT root_id, id, depth, CASE WHEN depth > 3 THEN 'max-depth' WHEN NOT present THEN 'missing-session' END AS unavailable
FROM walk""")
def g11(spark, sf):
    nodes = tree(spark, sf)
    return tr.included_children(nodes, nodes, nodes.filter(F.col("id") % 7 != 0), 3)


@query("d17_title_enrichment", cat_sql("""SELECT c.id, coalesce(nullif(u.c_mktsegment, ''), c.title) AS title
  FROM catalog c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_custkey % 3 <> 0) u ON u.c_custkey = c.id"""))
def d17(spark, sf):
    threads = table(spark, sf, "customer").filter(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("title")
    )
    return cat.enrich_titles(catalog(spark, sf).select("id", "title"), threads)


@query("d18_threads_else_files", """
WITH files AS (SELECT o_orderkey AS id, 'p' || o_orderkey AS path, 'file' AS title FROM orders WHERE o_orderkey % 4 <> 0),
threads AS (SELECT o_orderkey AS id, 'p' || o_orderkey AS path, o_orderpriority AS title FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, path, title FROM threads WHERE path IN (SELECT path FROM files)
UNION ALL SELECT id, path, title FROM files WHERE id NOT IN (SELECT id FROM threads)""")
def d18(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderpriority").alias("title"),
    )
    files = orders.filter(F.col("id") % 4 != 0).withColumn("title", F.lit("file"))
    return cat.threads_else_files(orders.filter(F.col("id") % 3 != 0), files)


@query("d19_model_window", """SELECT l_orderkey AS session_id, l_linenumber AS item, p_size * 1000 AS context_limit,
  CASE WHEN p_size > 0 THEN least(100.0, floor(l_extendedprice / (p_size * 1000) * 1000 + 0.5) / 10) END AS percent
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def d19(spark, sf):
    from seslog.operators.context import model_window_usage

    windows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("model"), (F.col("p_size") * 1000).alias("context_window")
    )
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("item"),
        F.col("l_partkey").alias("model"), F.col("l_extendedprice").alias("input_tokens"),
    )
    return model_window_usage(rows, windows, "input_tokens").select(
        "session_id", "item", F.col("context_window").alias("context_limit"), "percent"
    )


@query("e26_watermark", cat_sql("SELECT max(changed_ms) AS watermark_ms FROM catalog WHERE archived"))
def e26(spark, sf):
    return cat.watermark(cat.filter_sessions(catalog(spark, sf), archived=True))


@query("h1_session_filter", cat_sql(f"""SELECT id, title, cwd, changed_ms FROM catalog WHERE NOT archived AND changed_ms > {SINCE}
  AND changed_ms < {BEFORE} AND lower(title) LIKE '%not spec%' AND lower(cwd) LIKE '%build%'
  AND lower(concat_ws(' ', CAST(id AS VARCHAR), title, cwd)) LIKE '%1%'"""))
def h1(spark, sf):
    return cat.filter_sessions(
        catalog(spark, sf), archived=False, changed_after=SINCE, changed_before=BEFORE, title="Not  SPEC", cwd="build", text="1"
    ).select("id", "title", "cwd", "changed_ms")


@query("h2_list_type", """SELECT p_partkey AS id, p_name AS title, p_brand AS cwd FROM part
  WHERE regexp_matches(p_name || chr(10) || p_brand || chr(10) || 'x/' || CASE WHEN p_size % 9 = 0 THEN 'Shell' ELSE p_type END,
  '(?i)tool|mcp|command|shell|工具|命令')""")
def h2(spark, sf):
    kind = F.when(F.col("p_size") % 9 == 0, "Shell").otherwise(F.col("p_type"))
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("cwd"),
        F.concat(F.lit("x/"), kind).alias("relative_path"),
    )
    return cat.filter_sessions(rows, list_type="tool").select("id", "title", "cwd")


@query("h3_sorted_sessions", cat_sql("SELECT id, title, size_bytes, changed_ms FROM catalog"))
def h3(spark, sf):
    return catalog(spark, sf).select("id", "title", "size_bytes", "changed_ms").orderBy(*cat.sort_keys("title", True))


@query("h4_offset_page", cat_sql("""SELECT id, changed_ms, (SELECT count(*) FROM catalog WHERE archived) AS total,
  CASE WHEN 250 < (SELECT count(*) FROM catalog WHERE archived) THEN 250 END AS next_offset
  FROM catalog WHERE archived ORDER BY changed_ms DESC, CAST(id AS VARCHAR) DESC LIMIT 50 OFFSET 200"""))
def h4(spark, sf):
    rows = cat.filter_sessions(catalog(spark, sf), archived=True)
    return cat.page(rows, cat.sort_keys(), 200, 50).select("id", "changed_ms", "total", "next_offset")


@query("h5_keyset_page", cat_sql(f"""SELECT id, changed_ms FROM catalog
  WHERE changed_ms < {BEFORE} OR (changed_ms = {BEFORE} AND id > 100) ORDER BY changed_ms DESC, id LIMIT 120"""))
def h5(spark, sf):
    return cat.keyset_page(catalog(spark, sf), "changed_ms", (BEFORE, 100), 120).select("id", "changed_ms")


@query("h6_count_and_page", cat_sql("""SELECT id, changed_ms, (SELECT count(*) FROM catalog WHERE cwd = 'BUILDING') AS total,
  CASE WHEN 120 < (SELECT count(*) FROM catalog WHERE cwd = 'BUILDING') THEN 120 END AS next_offset
  FROM catalog WHERE cwd = 'BUILDING' ORDER BY changed_ms DESC, id LIMIT 120"""))
def h6(spark, sf):
    rows = catalog(spark, sf).filter("cwd = 'BUILDING'")
    return cat.page(rows, [F.col("changed_ms").desc(), F.col("id").asc()], 0, 120).select(
        "id", "changed_ms", "total", "next_offset"
    )


@query("h7_field_pick", cat_sql("SELECT id, cwd, size_bytes FROM catalog"))
def h7(spark, sf):
    return cat.pick_fields(catalog(spark, sf), ["size_bytes", "cwd", "no_such_field"])


SCOPE_COLUMNS = ("realtime", "day", "earlier", "recent24h", "history", "all")


@query("h9_scope_buckets", with_ctes(EVT_EVENTS_SQL, f"""sessions AS (SELECT session_id AS id, event_id,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts_ms END AS changed_ms FROM evt_events)""", f"""
SELECT id, event_id, coalesce(changed_ms >= {NOW - 3 * 3_600_000}, false) AS realtime,
  coalesce(changed_ms >= {NOW - DAY_MS} AND changed_ms < {NOW - 3 * 3_600_000}, false) AS day,
  changed_ms IS NULL OR changed_ms < {NOW - DAY_MS} AS earlier, coalesce(changed_ms >= {NOW - DAY_MS}, false) AS recent24h,
  changed_ms IS NULL OR changed_ms < {NOW - DAY_MS} AS history, true AS "all",
  CASE WHEN changed_ms IS NULL THEN 'earlier' WHEN greatest(0, {NOW} - changed_ms) < {3 * 3_600_000} THEN 'realtime'
       WHEN greatest(0, {NOW} - changed_ms) < {DAY_MS} THEN 'day' ELSE 'earlier' END AS age_bucket FROM sessions"""))
def h9(spark, sf):
    changed = F.when(F.col("event_id") % 50 != 0, F.col("ts_ms"))
    flags = cat.scope_flags(changed, NOW)
    return evt_rows(spark, sf).select(
        F.col("session_id").alias("id"), "event_id", *[flags[c].alias(c) for c in SCOPE_COLUMNS],
        cat.age_bucket(changed, NOW).alias("age_bucket"),
    )


@query("t5_recency_counters", f"""SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type AS kind, count(*) AS n,
  CASE WHEN greatest(0, {NOW} - epoch_ms(date_trunc('hour', ts))) < {3 * 3_600_000} THEN 'realtime'
       WHEN greatest(0, {NOW} - epoch_ms(date_trunc('hour', ts))) < {DAY_MS} THEN 'day' ELSE 'earlier' END AS scope
  FROM events GROUP BY ALL""")
def t5(spark, sf):
    from seslog.streaming.live import hourly_counts, scope_of_hours

    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return scope_of_hours(hourly_counts(rows, watermark=None), NOW)


@query("t3_change_feed", cat_sql(f"""SELECT id, title, changed_ms, (SELECT max(changed_ms) FROM catalog) AS watermark_ms
  FROM catalog WHERE changed_ms > {BEFORE}"""))
def t3(spark, sf):
    from seslog.streaming.live import changes_since

    return changes_since(catalog(spark, sf), BEFORE).select("id", "title", "changed_ms", "watermark_ms")


@query("h10_newest_sessions", cat_sql("SELECT id, changed_ms FROM catalog ORDER BY changed_ms DESC, id LIMIT 800"))
def h10(spark, sf):
    return cat.newest(catalog(spark, sf), 800).select("id", "changed_ms")  # a top-k report; its k is the caller's


@query("h11_record_dedupe", """SELECT id, archived, mtime_ms, path FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY archived, mtime_ms DESC, path) AS rn FROM (
    SELECT doc_id % 300 AS id, lang = 'fr' AS archived, (n_chars // 500) * 1000 AS mtime_ms, source || '/' || doc_id AS path
    FROM documents)) WHERE rn = 1""")
def h11(spark, sf):
    files = table(spark, sf, "documents").select(
        (F.col("doc_id") % 300).alias("id"), (F.col("lang") == "fr").alias("archived"),
        (F.floor(F.col("n_chars") / 500) * 1000).alias("mtime_ms"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
    )
    return cat.dedupe_files(files)


LONG_SQL = "long AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN repeat(p_name || '  ', 60) ELSE p_name END AS title FROM part)"


@query("h12_display_list", with_ctes(LONG_SQL, """n AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM long)""",
  """SELECT id, CASE WHEN length(t) > 400 THEN substr(t, 1, 399) || '…' ELSE t END AS display_title,
     length(t) > 400 AS title_truncated FROM n"""))
def h12(spark, sf):
    name = F.col("p_name")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat(name, F.lit("  ")), F.lit(60))).otherwise(name).alias("title"),
    )
    return cat.display_rows(rows).select("id", "display_title", "title_truncated")


@query("h12_display_list_filtered", with_ctes(LONG_SQL, """SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS display_title
  FROM long WHERE lower(CAST(id AS VARCHAR) || chr(10) || title) LIKE '%bolt%'"""))
def h12_filtered(spark, sf):
    name = F.col("p_name")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat(name, F.lit("  ")), F.lit(60))).otherwise(name).alias("title"),
    )
    return cat.display_rows(rows, text="BOLT").select("id", "display_title")


@query("s5_display_numbers", """
WITH n AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(floor(o_totalprice * 7919) AS BIGINT) AS big FROM orders)
SELECT id,
  CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576
       THEN ((20 * v + 1024) // 2048) // 10 || '.' || ((20 * v + 1024) // 2048) % 10 || ' KB' END AS size_text,
  CASE WHEN big < 1048576 THEN NULL ELSE ((20 * big + 1048576) // 2097152) // 10 || '.' || ((20 * big + 1048576) // 2097152) % 10 || ' MB' END AS large_text,
  CASE WHEN v < 1000 THEN CAST(v AS VARCHAR)
       WHEN v % 500 = 250 THEN ((v + 50) // 100) // 10 || '.' || ((v + 50) // 100) % 10 || 'K'
       ELSE printf('%.1f', v / 1000.0) || 'K' END AS compact_text,
  CASE WHEN v < 1000 THEN v || ' ms'
       WHEN v < 60000 THEN ((v + 50) // 100) // 10 || CASE WHEN ((v + 50) // 100) % 10 <> 0 THEN '.' || ((v + 50) // 100) % 10 ELSE '' END || ' s'
       ELSE (v // 60000) || 'm ' || ((v % 60000 + 500) // 1000) || 's' END AS duration_text
FROM n""")
def s5(spark, sf):
    v = F.floor("o_totalprice").cast("bigint")
    big = F.floor(F.col("o_totalprice") * 7919).cast("bigint")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(v < 1048576, tx.format_bytes(v)).alias("size_text"),
        F.when(big >= 1048576, tx.format_bytes(big)).alias("large_text"),
        tx.compact_number(v).alias("compact_text"), tx.report_duration(v).alias("duration_text"),
    )


@query("b6_timestamp_units", """SELECT event_id, epoch_us(ts) // 1000 AS from_micros, epoch_us(ts) // 1000 AS from_millis,
  (epoch_us(ts) // 1000000) * 1000 AS from_seconds, epoch_us(ts) // 1000 AS from_text FROM events""")
def b6(spark, sf):
    from seslog.functions.js import time_millis

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor(micros / 1_000_000)
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = lambda key, value: F.to_json(F.struct(value.alias(key)))
    parse = lambda text: time_millis(F.try_parse_json(text))
    return table(spark, sf, "events").select(
        "event_id",
        parse(record("ts", micros)).alias("from_micros"),
        parse(record("created_at", millis("ts").cast("string"))).alias("from_millis"),
        parse(record("when", seconds)).alias("from_seconds"),
        parse(record("timestamp", iso)).alias("from_text"),
    )
