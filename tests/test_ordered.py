"""Blocked running values equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from seslog.functions.ordered import (
    event_block, following_row, last_value, next_value, ordered_scan, previous_row, running_max, running_min, running_sum, with_position,
)


def skewed(spark, n=400):
    random.seed(5)
    rows = [("hot" if random.random() < 0.7 else f"k{random.randrange(9)}", i, random.choice([None, 1, 2, 3, 5])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, v int")


def test_scan_equals_window(spark):
    df = skewed(spark)
    v = F.col("v")
    got = ordered_scan(
        df, ["k"], event_block("i", 7), ["i"],
        s=running_sum(v), sb=running_sum(v, before=True), mx=running_max(v, before=True), mn=running_min(v), last=last_value(v), lastb=last_value(v, before=True),
        nxt=next_value(v), here=next_value(v, after=False), prev=previous_row(v), foll=following_row(v),
    )
    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    after, rest = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "k", "i", "v", F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("s"), F.coalesce(F.sum(v).over(before), F.lit(0)).alias("sb"), F.max(v).over(before).alias("mx"),
        F.min(v).over(upto).alias("mn"), F.last(v, True).over(upto).alias("last"), F.last(v, True).over(before).alias("lastb"), F.first(v, True).over(after).alias("nxt"),
        F.first(v, True).over(rest).alias("here"), F.lag(v).over(w).alias("prev"), F.lead(v).over(w).alias("foll"),
    )
    order = ["k", "i"]
    assert [tuple(r) for r in got.select(want.columns).orderBy(order).collect()] == [tuple(r) for r in want.orderBy(order).collect()]


def test_position(spark):
    df = skewed(spark)
    got = with_position(df, ["k"], event_block("i", 10), ["i"], "p")
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1)
    assert sorted(map(tuple, got.select("k", "i", "p").collect())) == sorted(map(tuple, want.select("k", "i", "p").collect()))


def test_no_frame_ends_at_the_last_row(spark):
    """Such a frame is computed anew for each row, so a block would take the square of its rows."""
    df = spark.range(3_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 1_000 == 0, F.col("id")).alias("v"))
    got = ordered_scan(df, ["k"], event_block("i"), ["i"], nxt=next_value(F.col("v")), here=next_value(F.col("v"), after=False), foll=following_row(F.col("v")))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
    assert got.filter("here IS DISTINCT FROM CASE WHEN i <= 2000 THEN CAST(ceil(i / 1000) AS BIGINT) * 1000 END").count() == 0
    assert got.filter("nxt IS DISTINCT FROM CASE WHEN i < 2000 THEN CAST(floor(i / 1000) + 1 AS BIGINT) * 1000 END").count() == 0
    assert got.filter("foll IS DISTINCT FROM CASE WHEN i < 2000 AND (i + 1) % 1000 = 0 THEN i + 1 END").count() == 0
