"""Subtree totals and depth-first positions without paths: every round is a join or a sum over as many rows as there are nodes.

After round k a node points 2^k ancestors up, so a tree of depth d takes log2(d) rounds, a chain of 100,000 nodes 17.

* Totals go up: a node adds what the nodes 2^k below it have summed over the 2^k levels from each of them on.
* Positions come down: a node lies behind its parent and the subtrees of its earlier siblings. Siblings are numbered in one
  range-sorted order of all nodes with running sums per range, so a parent of very many children is spread like any others.
  The sum of these offsets over a node's ancestors, found by doubling, is its position.

A parent that is missing from the nodes, or is the node itself, counts as none. Node ids are not null and unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import last_value, ordered_scan, previous_row, running_sum
from seslog.functions.skew import spread_join
from seslog.functions.staging import stage

ROWS_PER_RANGE = 1 << 20


def _linked(nodes: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(id, up, columns): up is the parent where there is one."""
    rows = stage(nodes.select("id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("up"), *columns))
    asked = stage(rows.filter("up IS NOT NULL"))
    found = spread_join(asked.select("id", "up"), rows.select(F.col("id").alias("up")), "up").select("id", "up")
    return stage(rows.drop("up").join(found, "id", "left"))


def _doubled(state: DataFrame, values: dict[str, Callable[[Column, Column], Column]], rounds: int | None = None) -> DataFrame:
    """Follow `up` to the top; values[c](own, above) puts together c of a node's 2^k ancestors and of those above them.

    Ends when every pointer is at its end, or after `rounds`; then `up` tells which are not.
    """
    done = 0
    while rounds is None or done < rounds:
        open_ = state.filter("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in values])
        joined = spread_join(open_, above, "up")
        kept = [c for c in state.columns if c not in values and c != "up"]
        step = joined.select(*kept, F.col("__up").alias("up"), *[join(F.col(c), F.col(f"__{c}")).alias(c) for c, join in values.items()])
        state = stage(step.unionByName(state.filter("up IS NULL")))
        done += 1
    return state


def _cycles(linked: DataFrame, order: Column) -> DataFrame | None:
    """(id, least, on): nodes in or below a cycle, the least `order` among each and all above it, and whether it lies on the cycle; None where there is none."""
    rounds = max(int(linked.count()).bit_length(), 1)
    state = _doubled(linked.select("id", "up", order.alias("least")), {"least": F.least}, rounds)
    left = state.filter("up IS NOT NULL")
    if left.isEmpty():
        return None
    on = left.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))
    return stage(left.select("id", "least").join(on, "id", "left").select("id", "least", F.coalesce("on", F.lit(False)).alias("on")))


def _summed_up(linked: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, names): sums over each node and all below it; `linked` has no cycle."""
    state = linked.select("id", "up", *names)
    while not state.filter("up IS NOT NULL").isEmpty():
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"__{c}") for c in names])
        added = state.join(below, "id", "left").select("id", "up", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in names])
        added = stage(added)
        open_ = added.filter("up IS NOT NULL")
        moved = spread_join(open_, state.select(F.col("id").alias("up"), F.col("up").alias("__up")), "up")
        state = stage(moved.select("id", F.col("__up").alias("up"), *names).unionByName(added.filter("up IS NULL")))
    return state.select("id", *names)


def subtree_sums(nodes: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(id, measures): sums over each node and all nodes below it. On a cycle every node is below every other, and counts once."""
    rows = nodes.select("id", "parent_id", *[F.coalesce(expr, F.lit(0)).alias(name) for name, expr in measures.items()])
    linked = _linked(rows, list(measures))
    cycles = _cycles(linked, F.col("id"))
    if cycles is None:
        return _summed_up(linked, list(measures))
    ring = cycles.filter("on").select("id", "least")
    cut = stage(linked.join(ring, "id", "left").withColumn("up", F.when(F.col("least").isNull(), F.col("up"))))
    sums = stage(_summed_up(cut.drop("least"), list(measures)))
    rings = sums.join(ring, "id").groupBy("least").agg(*[F.sum(c).alias(c) for c in measures])
    whole = ring.join(rings, "least").select("id", *measures)
    return sums.join(ring, "id", "left_anti").unionByName(whole)


def depth_first(nodes: DataFrame, time: str, order: str) -> DataFrame:
    """(id, root_id, depth, position): the place of each node when children follow their parent by time, then list order.

    Nodes without a parent are roots, in list order. On a cycle, and below it, a node that comes before all nodes above
    it in the list is a root; such roots follow the others.
    """
    own = nodes.select("id", "parent_id", F.col(time).alias("__time"), F.col(order).alias("__order"))
    linked = _linked(own, ["__time", "__order"])
    cycles = _cycles(linked, F.struct(F.col("__order").alias("o"), F.col("id").alias("i")))
    rows = linked.withColumn("__late", F.lit(0).cast("long"))
    if cycles is not None:
        first = cycles.filter((F.col("least.i") == F.col("id"))).select("id", F.lit(True).alias("__first"))
        marked = linked.join(first, "id", "left")
        rows = stage(marked.withColumn("up", F.when(F.col("__first").isNull(), F.col("up"))).withColumn("__late", F.when(F.col("__first"), 1).otherwise(0).cast("long")).drop("__first"))
    sizes = _summed_up(rows.withColumn("__size", F.lit(1).cast("long")), ["__size"])
    sized = stage(rows.join(sizes, "id").withColumn("__at", F.when(F.col("up").isNull(), F.col("__late")).otherwise(F.coalesce("__time", F.lit(0)).cast("long"))))
    ranges = int(sized.count() // ROWS_PER_RANGE) + int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [F.col("up").asc_nulls_first(), "__at", "__order", "id"]
    sort = stage(sized.repartitionByRange(ranges, *places).sortWithinPartitions(*places).withColumn("__place", F.monotonically_increasing_id()))
    block = F.shiftright("__place", 33)
    one = sort.withColumn("__all", F.lit(0))
    summed = stage(ordered_scan(one, ["__all"], block, ["__place"], __before=running_sum(F.col("__size"), before=True), __previous=previous_row(F.col("up"))))
    opens = ~F.col("up").eqNullSafe(F.col("__previous"))
    begun = ordered_scan(summed.withColumn("__open", opens), ["__all"], block, ["__place"], __begin=last_value(F.when(F.col("__open"), F.col("__before"))))
    # the first rows of all have no parent and begin at 0
    offset = F.col("__before") - F.coalesce("__begin", F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)
    start = stage(begun.select("id", "up", offset.alias("position"), F.col("up").isNotNull().cast("long").alias("depth"), F.coalesce("up", "id").alias("root_id")))
    found = _doubled(start, {"position": lambda a, b: a + b, "depth": lambda a, b: a + b, "root_id": lambda a, b: b})
    return found.select("id", "root_id", "depth", "position")
