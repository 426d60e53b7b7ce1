"""Session-log shaped views over the driver tables, as DataFrames and as the SQL used by the checks.

The driver tables hold no session logs, so each view maps rows of one of them to the columns an operator reads. The
mapping is fixed and uses every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.ordered import DAY_MS, time_block, with_position

CONVERSATION_EPOCH_S = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


# --- intervals: one tool or response interval per order line -------------------------------------------------------
# Dates are whole days, so blocks of 1024 days keep each ordered block below 1024 distinct times.
TOOL_WIDTH_MS = 1024 * DAY_MS

TOOL_INTERVALS_SQL = """tool_intervals AS (
  SELECT o_custkey AS session_id, o_orderkey AS turn_id, l_linenumber AS line_no,
         epoch_ms(o_orderdate) AS start_ms, epoch_ms(l_shipdate) AS end_ms,
         CASE WHEN l_linenumber % 2 = 1 THEN 'llm_wait' ELSE 'tool_execution' END AS bucket,
         l_returnflag AS tool, CAST(l_quantity AS BIGINT) AS tokens, l_linestatus = 'O' AS estimated,
         l_partkey AS part_id, l_suppkey AS supplier_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def tool_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn_id"), millis("o_orderdate").alias("start_ms")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("turn_id"),
        F.col("l_linenumber").alias("line_no"),
        millis("l_shipdate").alias("end_ms"),
        F.when(F.col("l_linenumber") % 2 == 1, "llm_wait").otherwise("tool_execution").alias("bucket"),
        F.col("l_returnflag").alias("tool"),
        F.col("l_quantity").cast("bigint").alias("tokens"),
        (F.col("l_linestatus") == "O").alias("estimated"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
    )
    return orders.join(lines, "turn_id")


TURN_BOUNDS_SQL = f"""turn_bounds AS (
  SELECT session_id, turn_id, min(start_ms) - {DAY_MS} AS lower_ms, max(end_ms) + {DAY_MS} AS upper_ms
  FROM tool_intervals GROUP BY ALL)"""


def turn_bounds(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("session_id", "turn_id").agg(
        (F.min("start_ms") - DAY_MS).alias("lower_ms"), (F.max("end_ms") + DAY_MS).alias("upper_ms")
    )


# --- conversation events ------------------------------------------------------------------------------------------
CONV_EVENTS_SQL = f"""conv_events AS (
  SELECT conv_id AS session_id, turn AS event_index, role, text,
         CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'agent_message' WHEN 'system' THEN 'meta'
              ELSE 'unknown' END AS kind,
         ({CONVERSATION_EPOCH_S} + conv_id * 3600 + turn * 30) * 1000 AS ts_ms
  FROM conversations)"""


def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("event_index"),
        "role",
        "text",
        F.when(F.col("role") == "user", "user_message")
        .when(F.col("role") == "assistant", "agent_message")
        .when(F.col("role") == "system", "meta")
        .otherwise("unknown")
        .alias("kind"),
        ((F.lit(CONVERSATION_EPOCH_S) + F.col("conv_id") * 3600 + F.col("turn") * 30) * 1000).alias("ts_ms"),
    )


# --- timed events per user ----------------------------------------------------------------------------------------
EVT_EVENTS_SQL = """evt_events AS (
  SELECT user_id AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS event_index,
         epoch_us(ts) // 1000 AS ts_ms, event_id, event_type,
         CASE event_type WHEN 'signup' THEN 'user_message' WHEN 'view' THEN 'token_count'
              WHEN 'click' THEN 'function_call' WHEN 'purchase' THEN 'agent_message'
              WHEN 'error' THEN 'task_failed' ELSE event_type END AS kind,
         CAST(json_extract(props, '$.k') AS BIGINT) AS percent, CAST(floor(value + 0.5) AS BIGINT) AS tokens, value, props
  FROM events)"""


def evt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed events without their position (enough where only the order matters)."""
    kinds = {
        "signup": "user_message", "view": "token_count", "click": "function_call",
        "purchase": "agent_message", "error": "task_failed",
    }
    kind = F.col("event_type")
    for source, target in kinds.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        millis("ts").alias("ts_ms"),
        "event_id",
        "event_type",
        kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("percent"),
        F.floor(F.col("value") + 0.5).cast("bigint").alias("tokens"),
        "value",
        "props",
    )


EVT_ORDER = ["ts_us", "event_id"]


def evt_block():
    return time_block("ts_ms", 32 * DAY_MS)


def evt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(evt_rows(spark, sf_dir), ["session_id"], evt_block(), EVT_ORDER, "event_index")


# --- session catalog ----------------------------------------------------------------------------------------------
CATALOG_SQL = """catalog AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, c_mktsegment AS cwd, epoch_ms(o_orderdate) AS changed_ms,
         o_orderstatus = 'F' AS archived, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_custkey AS owner
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

EDGES_SQL = "edges AS (SELECT o_orderkey - 1 AS parent_id, o_orderkey AS child_id FROM orders WHERE o_orderkey % 5 = 0)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("cwd"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("title"),
            millis("o_orderdate").alias("changed_ms"),
            (F.col("o_orderstatus") == "F").alias("archived"),
            F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
            F.col("o_custkey").alias("owner"),
        )
        .join(customer, "owner", "left")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderkey") % 5 == 0)
        .select((F.col("o_orderkey") - 1).alias("parent_id"), F.col("o_orderkey").alias("child_id"))
    )


# --- thread tree ----------------------------------------------------------------------------------------------------
TREE_SQL = """tree AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey // 2 = 0 THEN NULL ELSE p_partkey // 2 END AS parent_id,
         p_name AS title, p_brand AS brand, p_type AS kind, CAST(p_size AS BIGINT) AS size FROM part)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("p_partkey") / 2)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(half != 0, half).alias("parent_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("bigint").alias("size"),
    )


def with_ctes(*parts: str) -> str:
    """Join CTE texts and a final SELECT: all but the last part are CTEs."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
