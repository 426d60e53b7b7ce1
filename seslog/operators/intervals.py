"""Interval sweeps: merged spans, covered and overlapping time, peak concurrency, composition, free gaps.

Intervals are first folded into points, one row per (key, time) with the number of starts and ends there. The fold
combines map-side, so a session with very many intervals shrinks to at most one row per millisecond before it is
ordered; the ordered pass then runs in time blocks (see functions/ordered.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import (
    DAY_MS,
    following_row,
    next_value,
    ordered_scan,
    previous_row,
    running_max,
    running_sum,
    time_block,
)
from seslog.functions.staging import stage

MIN_GAP_MS = 1_000


def duration_ms(start: Column, end: Column) -> Column:
    """NULL for a missing bound or an end before the start, never 0 or negative."""
    return F.when(end >= start, end - start)


def duration_kind(start: Column, end: Column, estimated: Column) -> Column:
    return (
        F.when(end >= start, F.when(estimated, "estimated").otherwise("observed"))
        .when(start.isNull() & end.isNull(), "unavailable")
        .otherwise("partial")
    )


def complete(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.filter(F.col(end) >= F.col(start))


def boundary_points(
    intervals: DataFrame, keys: Sequence[str], weights: dict[str, Column] | None = None,
    start: str = "start_ms", end: str = "end_ms",
) -> DataFrame:
    """One row per (key, t): ``starts``, ``ends`` and per weight w the change ``d_w`` of the active amount at t."""
    weights = weights or {}
    sides = F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("sign")),
        F.struct(F.col(end).alias("t"), F.lit(-1).alias("sign")),
    )
    exploded = complete(intervals, start, end).select(
        *keys, *[w.cast("long").alias(f"w_{n}") for n, w in weights.items()], F.inline(sides)
    )
    return exploded.groupBy(*keys, "t").agg(
        F.count_if(F.col("sign") == 1).alias("starts"),
        F.count_if(F.col("sign") == -1).alias("ends"),
        *[F.sum(F.col("sign") * F.col(f"w_{n}")).alias(f"d_{n}") for n in weights],
    )


def segments(
    intervals: DataFrame, keys: Sequence[str], weights: dict[str, Column] | None = None,
    width_ms: int = DAY_MS, start: str = "start_ms", end: str = "end_ms",
) -> DataFrame:
    """Elementary segments [t, next_t) with ``active`` intervals and the active amount of each weight."""
    weights = weights or {}
    points = boundary_points(intervals, keys, weights, start, end)
    return ordered_scan(
        points, keys, time_block("t", width_ms), ["t"],
        active=running_sum(F.col("starts") - F.col("ends")),
        next_t=next_value(F.col("t")),
        **{n: running_sum(F.col(f"d_{n}")) for n in weights},
    )


def sweep_totals(intervals: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    """Per key: covered time, time with two or more active intervals (counted once) and peak concurrency.

    Ends count before starts at equal times, so touching intervals do not overlap.
    """
    span = F.coalesce(F.col("next_t") - F.col("t"), F.lit(0))
    return (
        segments(intervals, keys, width_ms=width_ms)
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("active") >= 1, span).otherwise(0)).cast("long").alias("covered_ms"),
            F.sum(F.when(F.col("active") > 1, span).otherwise(0)).cast("long").alias("overlap_ms"),
            F.greatest(F.max("active"), F.lit(0)).cast("long").alias("peak"),
        )
    )


def covered_time(intervals: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    return sweep_totals(intervals, keys, width_ms).select(*keys, "covered_ms")


def merge_intervals(intervals: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    """Maximal merged spans; touching intervals join, zero-length intervals are kept."""
    depth = ordered_scan(
        boundary_points(intervals, keys), keys, time_block("t", width_ms), ["t"],
        active=running_sum(F.col("starts") - F.col("ends")),
    )
    edges = stage(
        depth.select(
            *keys, "t",
            (F.col("active") - F.col("starts") + F.col("ends") == 0).alias("opens"),
            (F.col("active") == 0).alias("closes"),
        ).filter("opens or closes")
    )
    paired = ordered_scan(
        edges, keys, time_block("t", width_ms), ["t"],
        span_end=next_value(F.when(F.col("closes"), F.col("t")), after=False),
    )
    return paired.filter("opens").select(*keys, F.col("t").alias("start_ms"), F.col("span_end").alias("end_ms"))


def composition(intervals: DataFrame, keys: Sequence[str], buckets: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    """Time per set of buckets active at once, with its share of all active time and a confidence.

    ``intervals`` has ``bucket`` and boolean ``estimated``; ``buckets`` are the sorted bucket names.
    """
    weights = {f"n_{b}": (F.col("bucket") == b) for b in buckets}
    weights["n_estimated"] = F.col("estimated")
    active_set = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(f"n_{b}") > 0, b) for b in buckets])), "+"
    )
    parts = (
        segments(intervals, keys, weights, width_ms)
        .filter("active > 0 and next_t > t")
        .groupBy(*keys, active_set.alias("buckets"))
        .agg(
            F.sum(F.col("next_t") - F.col("t")).alias("duration_ms"),
            F.sum("active").alias("__n"),
            F.sum("n_estimated").alias("__est"),
        )
    )
    # At most 2^|buckets| rows per key remain, so the total per key is a small window.
    total = F.sum("duration_ms").over(_by(keys))
    return parts.select(
        *keys,
        F.concat(
            F.col("buckets"), F.when(F.col("buckets").contains("+"), ":parallel").otherwise(":single")
        ).alias("component"),
        "duration_ms",
        (F.floor(F.col("duration_ms") / total * 1000 + 0.5) / 10).alias("share_percent"),
        F.when(F.col("__est") == 0, "observed")
        .when(F.col("__est") == F.col("__n"), "estimated")
        .otherwise("mixed")
        .alias("confidence"),
    )


def _by(keys: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def free_segments(
    spans: DataFrame, bounds: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS, minimum_ms: int = MIN_GAP_MS
) -> DataFrame:
    """Free time of at least ``minimum_ms`` between the occupied spans of each [lower_ms, upper_ms] of ``bounds``.

    Spans must end after they start. The head runs from lower_ms to the first start, the tail from the latest end to
    upper_ms; a gap between spans starts at the latest end so far, but not before lower_ms.
    """
    keys = list(keys)
    usable = bounds.filter("upper_ms > lower_ms")
    # Spans with the same start count as one with the latest end: only the first of them can close a gap.
    starts = (
        spans.filter("end_ms > start_ms").join(usable.select(*keys), keys, "left_semi")
        .groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"))
    )
    scanned = ordered_scan(
        starts, keys, time_block("start_ms", width_ms), ["start_ms"], latest=running_max(F.col("end_ms"), before=True)
    )
    inner = scanned.join(usable, keys).select(
        *keys, F.greatest("latest", "lower_ms").alias("gap_start"), F.col("start_ms").alias("gap_end")
    )
    tails = usable.join(starts.groupBy(*keys).agg(F.max("end_ms").alias("__last")), keys, "left").select(
        *keys, F.greatest("__last", "lower_ms").alias("gap_start"), F.col("upper_ms").alias("gap_end")
    )
    return inner.unionByName(tails).filter(F.col("gap_end") - F.col("gap_start") >= minimum_ms)


def unattributed_remainder(
    children: DataFrame, bounds: DataFrame, keys: Sequence[str], minimum_ms: int = MIN_GAP_MS
) -> DataFrame:
    """Turn time that no child accounts for: duration minus the sum of child durations, where it is large enough."""
    keys = list(keys)
    accounted = children.groupBy(*keys).agg(F.sum(duration_ms(F.col("start_ms"), F.col("end_ms"))).alias("__used"))
    return (
        bounds.filter("upper_ms >= lower_ms")
        .join(accounted, keys, "left")
        .select(*keys, (F.col("upper_ms") - F.col("lower_ms") - F.coalesce("__used", F.lit(0))).alias("remainder_ms"))
        .filter(F.col("remainder_ms") >= minimum_ms)
    )


__all__ = [
    "boundary_points", "complete", "composition", "covered_time", "duration_kind", "duration_ms", "following_row",
    "free_segments", "merge_intervals", "previous_row", "segments", "sweep_totals", "unattributed_remainder",
]
