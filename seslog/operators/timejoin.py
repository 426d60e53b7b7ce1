"""Joins on time inside a session, written as ordered scans over both sides.

Neither side is paired with all rows of the other: rows of both sides are put on one time line, and running values
carry what the join needs. Cost is linear in the rows, also for one very long session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import DAY_MS, last_value, next_value, ordered_scan, running_max, running_min, running_sum, time_block
from seslog.functions.staging import stage

FAR_PAST, FAR_FUTURE = -(2**61), 2**61


def first_covering(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS
) -> DataFrame:
    """Each point (keys, t, *) with ``interval_id`` of the first interval (by ``ord``) that holds t, both ends included.

    Intervals have ``ord``, ``interval_id``, ``start_ms``, ``end_ms``; a missing bound is open. With starts that grow
    along ``ord`` (turns), the first interval to hold t is the first whose end reaches t, so only intervals that push
    the latest end further can be an answer. Sessions whose starts go back in time are answered by cells of time instead.
    """
    keys = list(keys)
    spans = intervals.select(
        *keys, "ord", "interval_id", F.coalesce("start_ms", F.lit(FAR_PAST)).alias("s"), F.coalesce("end_ms", F.lit(FAR_FUTURE)).alias("e")
    )
    # Read by several branches: both are written once.
    scanned = stage(ordered_scan(
        spans, keys, F.floor(F.col("ord") / 65_536), ["ord"],
        reach=running_max(F.col("e"), before=True), latest=running_max(F.col("s"), before=True),
    ))
    unordered = stage(scanned.filter("s < latest").select(*keys).distinct())
    some = not unordered.isEmpty()
    steps = scanned.filter("reach IS NULL OR e > reach")
    ahead = points
    if some:
        steps, ahead = steps.join(unordered, keys, "left_anti"), points.join(unordered, keys, "left_anti")
    cells = [c for c in points.columns if c not in keys]
    line = ahead.select(*keys, F.col("t").alias("__t"), F.lit(0).alias("__side"), F.struct(*cells).alias("__p"),
                        F.lit(None).cast(_step_type(spans)).alias("__step"))
    ends = steps.select(*keys, F.col("e").alias("__t"), F.lit(1).alias("__side"),
                        F.lit(None).cast(line.schema["__p"].dataType).alias("__p"), F.struct("interval_id", "s").alias("__step"))
    # Points without a time sort to the front and are answered separately.
    both = ordered_scan(
        line.filter("__t IS NOT NULL").unionByName(ends), keys, time_block("__t", width_ms), ["__t", "__side"],
        hit=next_value(F.col("__step"), after=False),
    ).filter("__side = 0")
    found = both.select(*keys, "__p.*", F.when(F.col("hit.s") <= F.col("__t"), F.col("hit.interval_id")).alias("interval_id"))
    blank = ahead.filter("t IS NULL").select(*keys, *cells, F.lit(None).cast(intervals.schema["interval_id"].dataType).alias("interval_id"))
    placed = found.unionByName(blank)
    if not some:
        return placed
    rest = points.join(unordered, keys, "left_semi")
    times = rest.select(*keys, "t").filter("t IS NOT NULL").distinct()
    answers = _first_by_cells(times, scanned.select(*spans.columns).join(unordered, keys, "left_semi"), keys)
    return placed.unionByName(rest.join(answers, [*keys, "t"], "left").select(*keys, *cells, "interval_id"))


def _first_by_cells(times: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t) with the first interval by ``ord`` that holds t, whatever the order of starts and ends.

    Time is cut into dyadic cells. An interval is a union of at most two cells per level, each cell keeps its first
    interval, and a time asks the one cell per level it lies in: an equi-join, with no pairs of times and intervals.
    The levels reach from one millisecond to the span of the key's times.
    """
    bounds = times.groupBy(*keys).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("__hi") - F.col("__lo") + 1)) - 1)
    inside = spans.join(bounds, keys).filter("s <= e AND e >= __lo AND s <= __hi").select(
        *keys, "ord", "interval_id", (F.greatest("s", "__lo") - F.col("__lo")).alias("__a"), (F.least("e", "__hi") - F.col("__lo") + 1).alias("__b"),
        F.explode(levels).alias("__level"))
    # At a level the interval starts at the next cell border after its start and ends at the last one before its end.
    first = F.expr("shiftright(__a + shiftleft(1L, __level) - 1, __level)")
    past = F.expr("shiftright(__b, __level)")
    pieces = inside.withColumns({"__first": first, "__past": past}).filter("__first < __past").select(
        *keys, "ord", "interval_id", "__level", F.explode(F.array_compact(F.array(
            F.when(F.col("__first") % 2 == 1, F.col("__first")), F.when(F.col("__past") % 2 == 1, F.col("__past") - 1)))).alias("__cell"))
    best = pieces.groupBy(*keys, "__level", "__cell").agg(F.min("ord").alias("__ord"), F.min_by("interval_id", "ord").alias("interval_id"))
    asked = times.join(bounds, keys).select(*keys, "t", "__lo", F.explode(levels).alias("__level")).withColumn(
        "__cell", F.expr("shiftright(t - __lo, __level)"))
    return asked.join(best, [*keys, "__level", "__cell"]).groupBy(*keys, "t").agg(F.min_by("interval_id", "__ord").alias("interval_id"))


def _step_type(spans: DataFrame):
    return spans.select(F.struct("interval_id", "s").alias("x")).schema["x"].dataType


def nearest(
    targets: DataFrame, snapshots: DataFrame, keys: Sequence[str], values: Sequence[str], width_ms: int = DAY_MS
) -> DataFrame:
    """Targets (keys, t, *) with the ``values`` of the snapshot closest in time; the earlier one on a tie.

    Snapshots have ``t`` and ``ord``; of several at one time the first by ``ord`` counts.
    """
    keys = list(keys)
    single = snapshots.groupBy(*keys, "t").agg(F.min_by(F.struct("t", *values), "ord").alias("__snap"))
    cells = [c for c in targets.columns if c not in keys]
    line = targets.select(*keys, "t", F.lit(1).alias("__side"), F.struct(*cells).alias("__p"))
    marks = single.select(*keys, "t", F.lit(0).alias("__side"), "__snap")
    both = ordered_scan(
        marks.unionByName(line, allowMissingColumns=True), keys, time_block("t", width_ms), ["t", "__side"],
        before=last_value(F.col("__snap")), after=next_value(F.col("__snap")),
    ).filter("__side = 1")
    left, right = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    best = F.when(F.coalesce(left <= right, F.col("before").isNotNull()), F.col("before")).otherwise(F.col("after"))
    return both.select(*keys, "__p.*", best.alias("__b")).select(*keys, *cells, *[F.col(f"__b.{v}").alias(v) for v in values])


def closest_context(targets: DataFrame, snapshots: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS) -> DataFrame:
    """Targets (keys, t, ord, own_percent, *) with percent, delta_percent and snap_ms.

    A target with a context of its own takes the snapshot of its event, if that has the same percent, else its own
    without a change; one without takes the snapshot nearest in time. Snapshots: keys, t, ord, percent, delta_percent, snap_ms.
    """
    keys = list(keys)
    own = targets.filter("own_percent IS NOT NULL")
    exact = snapshots.groupBy(*keys, "ord", F.col("percent").alias("own_percent")).agg(F.min_by(F.struct("delta_percent", "snap_ms"), "t").alias("__s"))
    found = own.join(exact, [*keys, "ord", "own_percent"], "left").select(
        *targets.columns, F.col("own_percent").alias("percent"), F.col("__s.delta_percent").alias("delta_percent"), F.col("__s.snap_ms").alias("snap_ms"))
    others = nearest(targets.filter("own_percent IS NULL AND t IS NOT NULL"), snapshots, keys, ["percent", "delta_percent", "snap_ms"], width_ms)
    timeless = targets.filter("own_percent IS NULL AND t IS NULL")
    return found.unionByName(others).unionByName(timeless, allowMissingColumns=True)


def sum_within(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS
) -> DataFrame:
    """Intervals (keys, id, start_ms, end_ms) with ``total``: the sum of ``weight`` of the points in [start, end].

    Prefix sums: what lies up to the end minus what lies before the start.
    """
    keys = list(keys)
    folded = points.groupBy(*keys, "t").agg(F.sum("weight").alias("weight"))
    queries = intervals.select(*keys, "id", F.inline(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(0).alias("__side")), F.struct(F.col("end_ms").alias("t"), F.lit(2).alias("__side")))))
    line = folded.select(*keys, "t", "weight", F.lit(1).alias("__side")).unionByName(queries, allowMissingColumns=True)
    scanned = ordered_scan(line, keys, time_block("t", width_ms), ["t", "__side"], upto=running_sum(F.coalesce("weight", F.lit(0))))
    return scanned.filter("__side <> 1").groupBy(*keys, "id").agg(
        F.sum(F.when(F.col("__side") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("total")
    )


def greatest_overlap(
    segments: DataFrame, spans: DataFrame, keys: Sequence[str], width_ms: int = DAY_MS
) -> DataFrame:
    """Each segment (keys, segment_id, start_ms, end_ms) with the span (span_id, ord) it overlaps longest.

    Both families are free of overlaps within themselves (gaps of a turn, responses of a turn), so every moment
    belongs to at most one of each. Ties go to the smaller ``ord``; segments without any overlap are left out.
    """
    keys = list(keys)
    edge = lambda df, name, *ids: df.filter("end_ms > start_ms").select(*keys, F.inline(F.array(
        F.struct(F.col("start_ms").alias("t"), F.struct(*ids, F.col("end_ms").alias("e")).alias(name)),
        F.struct(F.col("end_ms").alias("t"), F.struct(*[F.lit(None).alias(i) for i in ids], F.col("end_ms").alias("e")).alias(name)),
    )))
    line = edge(segments, "seg", "segment_id").unionByName(edge(spans, "span", "span_id", "ord"), allowMissingColumns=True)
    folded = line.groupBy(*keys, "t").agg(
        F.max_by("seg", F.when(F.col("seg").isNotNull(), F.col("seg.segment_id").isNotNull())).alias("seg"),
        F.max_by("span", F.when(F.col("span").isNotNull(), F.col("span.span_id").isNotNull())).alias("span"),
    )
    cut = ordered_scan(
        folded, keys, time_block("t", width_ms), ["t"],
        in_seg=last_value(F.col("seg")), in_span=last_value(F.col("span")), next_t=next_value(F.col("t")),
    )
    shared = cut.filter("in_seg.segment_id IS NOT NULL AND in_span.span_id IS NOT NULL").groupBy(
        *keys, F.col("in_seg.segment_id").alias("segment_id"), F.col("in_span.span_id").alias("span_id"), F.col("in_span.ord").alias("ord")
    ).agg(F.sum(F.col("next_t") - F.col("t")).alias("overlap_ms"))
    best = F.max_by(F.struct("span_id", "overlap_ms"), F.struct(F.col("overlap_ms"), -F.col("ord")))
    return shared.groupBy(*keys, "segment_id").agg(best.alias("b")).select(*keys, "segment_id", "b.span_id", "b.overlap_ms")


__all__ = ["closest_context", "first_covering", "greatest_overlap", "nearest", "running_min", "sum_within"]
