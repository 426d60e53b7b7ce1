"""Thread and spawn-edge tables of the state database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.text import first_nonempty, nonempty, strip_long_path_prefix

MILLIS_ABOVE = 10_000_000_000
UNTITLED = "未命名会话"


def epoch_or_iso(value: Column) -> Column:
    """Epoch milliseconds of a number in seconds or milliseconds, or of an ISO text."""
    text = nonempty(value.cast("string"))
    number = text.try_cast("double")
    return F.when(text.contains("T"), F.unix_millis(text.try_cast("timestamp"))).otherwise(
        F.when(number > MILLIS_ABOVE, number).otherwise(number * 1000).cast("long")
    )


def read_threads(spark: SparkSession, url: str, table: str = "threads", **options: str) -> DataFrame:
    """The thread table over JDBC, mapped. Bounds and the id filter are pushed to the database by Spark."""
    return map_threads(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def map_threads(rows: DataFrame) -> DataFrame:
    """Thread rows with a title, unified times and plain paths; rows without id or path are dropped."""
    have = set(rows.columns)
    text = lambda c: nonempty(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    raw = lambda c: F.col(c) if c in have else F.lit(None).cast("long")
    usable = rows.filter("id IS NOT NULL AND id <> '' AND rollout_path IS NOT NULL AND rollout_path <> ''")
    return usable.select(
        "id", F.coalesce(first_nonempty(text("title"), text("first_user_message"), text("preview")), F.lit(UNTITLED)).alias("title"),
        strip_long_path_prefix(F.col("rollout_path")).alias("path"), strip_long_path_prefix(F.coalesce(text("cwd"), F.lit(""))).alias("cwd"),
        epoch_or_iso(F.coalesce(raw("created_at_ms"), raw("created_at"))).alias("created_ms"),
        epoch_or_iso(F.coalesce(raw("updated_at_ms"), raw("updated_at"))).alias("updated_ms"),
        *[text(c).alias(c) for c in ("source", "thread_source", "model_provider", "model", "reasoning_effort", "agent_nickname", "agent_role")],
        F.coalesce(F.col("archived") == 1, F.lit(False)).alias("archived") if "archived" in have else F.lit(False).alias("archived"),
        epoch_or_iso(raw("archived_at")).alias("archived_ms"), first_nonempty(text("preview"), text("first_user_message")).alias("preview"),
    )


def map_edges(rows: DataFrame) -> DataFrame:
    """Spawn edges with both ends; an unset status is 'unknown'."""
    return rows.filter("parent_thread_id <> '' AND child_thread_id <> ''").select(
        F.col("parent_thread_id").alias("parent_id"), F.col("child_thread_id").alias("child_id"), F.coalesce(nonempty(F.col("status")), F.lit("unknown")).alias("status"))
