"""Timing tables: buckets, groups, usage, quality, turn rows and the step list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import DAY_MS
from seslog.operators.intervals import duration_kind, duration_ms, sweep_totals

USAGE_FIELDS = (
    "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost",
)
FAILED_STATUS = "(?i)fail|error|abort"


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards +infinity, the rule used for every reported percentage and rate."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)


def with_duration(intervals: DataFrame) -> DataFrame:
    start, end = F.col("start_ms"), F.col("end_ms")
    return intervals.withColumns(
        {"duration_ms": duration_ms(start, end), "duration_kind": duration_kind(start, end, F.col("estimated"))}
    )


def confidence(kind: str = "duration_kind", duration: str = "duration_ms") -> Column:
    """Aggregate: how the complete intervals were obtained."""
    complete = F.count_if(F.col(duration).isNotNull())
    estimated = F.count_if(F.col(duration).isNotNull() & (F.col(kind) == "estimated"))
    return (
        F.when(complete == 0, "unavailable").when(estimated == 0, "observed").when(estimated == complete, "estimated")
        .otherwise("mixed")
    )


def generated_tokens(tokens: str = "tokens") -> Column:
    """Aggregate over complete intervals; a zero total counts as no value."""
    return F.nullif(F.sum(F.when(F.col("duration_ms").isNotNull(), F.col(tokens))), F.lit(0))


def throughput(tokens: str = "tokens") -> Column:
    """Aggregate: generated tokens per second over the complete intervals that carry tokens."""
    total = generated_tokens(tokens)
    time = F.nullif(F.sum(F.when(F.col(tokens).isNotNull(), F.col("duration_ms"))), F.lit(0))
    return half_up(total * 1000 / time, 2)


def bucket_rows(
    intervals: DataFrame, keys: Sequence[str], total: DataFrame | None = None, width_ms: int = DAY_MS
) -> DataFrame:
    """One row per (keys, bucket): coverage, summed time, share, count, confidence, overlap, tokens, throughput.

    ``total`` gives ``total_ms`` per key; without it the covered time of all intervals of the key is the total.
    """
    keys = list(keys)
    rows = with_duration(intervals)
    if total is None:
        total = sweep_totals(rows, keys, width_ms).select(*keys, F.col("covered_ms").alias("total_ms"))
    sweep = sweep_totals(rows, [*keys, "bucket"], width_ms)
    sums = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("node_ms"),
        confidence().alias("confidence"),
        generated_tokens().alias("generated_tokens"),
        throughput().alias("tokens_per_second"),
    )
    coverage = F.coalesce("covered_ms", F.lit(0))
    return (
        sums.join(sweep, [*keys, "bucket"], "left")
        .join(total, keys, "left")
        .select(
            *keys, "bucket", coverage.alias("coverage_ms"), "node_ms",
            F.when(F.col("total_ms") > 0, half_up(coverage / F.col("total_ms") * 100, 1)).otherwise(0.0).alias("share_percent"),
            "n", "confidence", F.coalesce("overlap_ms", F.lit(0)).alias("overlap_ms"), "generated_tokens", "tokens_per_second",
        )
    )


def group_rows(intervals: DataFrame, keys: Sequence[str], group: str, status: str, width_ms: int = DAY_MS) -> DataFrame:
    """Groups inside a bucket: count, coverage, sum, average and longest duration, failed and incomplete."""
    keys = [*keys, "bucket", group]
    rows = with_duration(intervals)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("node_ms"),
        half_up(F.avg("duration_ms")).cast("long").alias("average_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.count_if(F.col(status).rlike(FAILED_STATUS)).alias("failed"),
        F.count_if(F.col("duration_ms").isNull()).alias("incomplete"),
    )
    covered = sweep_totals(rows, keys, width_ms).select(*keys, "covered_ms")
    return sums.join(covered, keys, "left").withColumn("coverage_ms", F.coalesce("covered_ms", F.lit(0))).drop("covered_ms")


def usage_summary(intervals: DataFrame, keys: Sequence[str], fields: Sequence[str] = USAGE_FIELDS) -> DataFrame:
    """Sums of the optional usage fields, NULL where no row has a value."""
    return intervals.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in fields])


def usage_composition(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Each part's percentage of their sum, one row per part that has a positive value."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    cells = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("amount")) for p in parts])
    return (
        df.select(*keys, total.alias("__total"), F.inline(cells))
        .filter("amount > 0")
        .select(*keys, "part", "amount", half_up(F.col("amount") / F.col("__total") * 100, 1).alias("percent"))
    )


def quality_counters(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = with_duration(intervals)
    kind = F.col("duration_kind")
    return rows.groupBy(*keys).agg(
        F.count_if(kind == "estimated").alias("estimated"),
        F.count_if(kind == "partial").alias("partial"),
        F.count_if(kind == "unavailable").alias("unavailable"),
        F.count_if(F.col("start_ms").isNull()).alias("missing_start"),
        F.count_if(F.col("end_ms").isNull()).alias("missing_end"),
        F.count_if(F.col("event_index").isNull()).alias("unlinked"),
    )


def turn_rows(intervals: DataFrame, bounds: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    """Per turn: duration and its kind, confidence, active time, interval counts and tokens of both buckets."""
    keys = list(keys)
    rows = with_duration(intervals)
    per_turn = rows.groupBy(*keys).agg(
        confidence().alias("confidence"),
        F.count_if(F.col("bucket") == "llm_wait").alias("llm_count"),
        F.count_if(F.col("bucket") == "tool_execution").alias("tool_count"),
        F.sum(F.when(F.col("bucket") == "llm_wait", F.col("tokens"))).alias("llm_tokens"),
    )
    duration = duration_ms(F.col("lower_ms"), F.col("upper_ms"))
    return (
        bounds.join(per_turn, keys, "left")
        .join(sweep_totals(rows, keys, width_ms).select(*keys, "covered_ms"), keys, "left")
        .select(
            *keys, duration.alias("duration_ms"),
            F.when(duration.isNull(), "partial")
            .when(F.coalesce(F.col("turn_estimated"), F.lit(False)), "estimated")
            .otherwise("observed")
            .alias("duration_kind"),
            F.coalesce("confidence", F.lit("unavailable")).alias("confidence"),
            F.coalesce("covered_ms", F.lit(0)).alias("active_ms"),
            "llm_count", "tool_count", "llm_tokens",
        )
    )
