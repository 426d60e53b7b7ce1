"""Running values over an ordered key without putting a whole key into one task.

A plain ``Window.partitionBy(session).orderBy(event_index)`` sends every row of a session to one task, so one very
long session decides the run time of the job. Here each key is cut into blocks of its order column. A window runs
inside each (key, block); one summary row per block is carried over the blocks of the key (few rows, since blocks are
wide) and joined back. All running values used here are associative, so the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seslog.functions.staging import stage

EVENTS_PER_BLOCK = 65_536
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Running:
    """partial: value of one block; local/carry: window over rows or blocks, in order and backwards; join: both combined."""

    partial: Callable[[Column], Column]
    local: Callable[[WindowSpec, WindowSpec], Column]
    carry: Callable[[Column, WindowSpec, WindowSpec], Column]
    join: Callable[[Column, Column], Column]


def _frame(window, before: bool):
    return window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)


def _forward(aggregate, combine, expr: Column, before: bool) -> Running:
    return Running(
        partial=lambda order: aggregate(expr),
        local=lambda w, back: aggregate(expr).over(_frame(w, before)),
        carry=lambda part, w, back: aggregate(part).over(_frame(w, True)),
        join=combine,
    )


def running_sum(expr: Column, before: bool = False) -> Running:
    """Sum of the rows up to this one (before=True: without it); 0 where there is no row."""
    return _forward(F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), expr, before)


def running_max(expr: Column, before: bool = False) -> Running:
    return _forward(F.max, lambda a, b: F.greatest(a, b), expr, before)


def running_min(expr: Column, before: bool = False) -> Running:
    return _forward(F.min, lambda a, b: F.least(a, b), expr, before)


def last_value(expr: Column, before: bool = False) -> Running:
    """Latest non-null value up to this row (before=True: without it)."""
    return Running(
        partial=lambda order: F.max_by(expr, F.when(expr.isNotNull(), order)),
        local=lambda w, back: F.last(expr, ignorenulls=True).over(_frame(w, before)),
        carry=lambda part, w, back: F.last(part, ignorenulls=True).over(_frame(w, True)),
        join=lambda a, b: F.coalesce(a, b),
    )


def next_value(expr: Column, after: bool = True) -> Running:
    """Next non-null value after this row (after=False: from this row on).

    It is the latest value of a window that runs backwards: a frame that ends at the last row is computed anew for each
    row, which is quadratic in a block.
    """
    return Running(
        partial=lambda order: F.min_by(expr, F.when(expr.isNotNull(), order)),
        local=lambda w, back: F.last(expr, ignorenulls=True).over(_frame(back, after)),
        carry=lambda part, w, back: F.last(part, ignorenulls=True).over(_frame(back, True)),
        join=lambda a, b: F.coalesce(a, b),
    )


def previous_row(expr: Column) -> Running:
    """Value of the row directly before this one, also when that value is null."""
    return _neighbour(expr, forward=False)


def following_row(expr: Column) -> Running:
    """Value of the row directly after this one, also when that value is null."""
    return _neighbour(expr, forward=True)


def _neighbour(expr: Column, forward: bool) -> Running:
    boxed = F.struct(expr.alias("v"))
    inner = next_value(boxed) if forward else last_value(boxed, before=True)
    return Running(inner.partial, inner.local, inner.carry, lambda a, b: F.coalesce(a, b)["v"])


def ordered_scan(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], **outputs: Running
) -> DataFrame:
    """Add running columns to df. ``block`` must not decrease along ``order`` within a key; keys are non-null."""
    keys = list(keys)
    rows = df.withColumn("__block", block)
    scope = [*keys, "__block"]
    order_key = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*scope).orderBy(*order)
    inside_back = Window.partitionBy(*scope).orderBy(*[F.desc(c) for c in order])
    over_blocks = Window.partitionBy(*keys).orderBy("__block")
    over_blocks_back = Window.partitionBy(*keys).orderBy(F.desc("__block"))

    summary = rows.groupBy(*scope).agg(*[spec.partial(order_key).alias(f"__p_{name}") for name, spec in outputs.items()])
    carried = summary.select(
        *scope, *[spec.carry(F.col(f"__p_{name}"), over_blocks, over_blocks_back).alias(f"__c_{name}") for name, spec in outputs.items()]
    )
    local = rows.select("*", *[spec.local(inside, inside_back).alias(f"__l_{name}") for name, spec in outputs.items()])
    joined = local.join(carried, scope)
    results = {name: spec.join(F.col(f"__l_{name}"), F.col(f"__c_{name}")) for name, spec in outputs.items()}
    kept = [c for c in df.columns if c not in results]
    return joined.select(*kept, *[expr.alias(name) for name, expr in results.items()])


def event_block(column: str = "event_index", size: int = EVENTS_PER_BLOCK) -> Column:
    return F.floor(F.col(column) / size)


def time_block(column: str, width_ms: int = DAY_MS) -> Column:
    return F.floor(F.col(column) / width_ms)


def with_position(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row within its key."""
    return ordered_scan(df, keys, block, order, **{name: running_sum(F.lit(1).cast("long"), before=True)})


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a sorted DataFrame with their 0-based places: places within a part, and few rows of how many parts before hold."""
    placed = stage(ordered.withColumn("__mark", F.monotonically_increasing_id()))
    part = F.shiftright("__mark", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))  # one row a part
    inside = F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(name, (F.col("__start") + inside).cast("long")).drop("__part", "__start", "__mark")
