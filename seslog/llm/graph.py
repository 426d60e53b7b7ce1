"""Connected components by alternating stars: every step is a join on one end of the edges, no task holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seslog.llm.common import stage


def _star(edges: DataFrame, lower: bool) -> DataFrame:
    """Each node's neighbours (of smaller name if lower, else of larger) are tied to the smallest of its neighbourhood."""
    if lower:
        near = edges.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the smallest node of each component that has an edge. Loops and repeats are allowed."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(now)
    while True:
        now = stage(_star(_star(now, lower=False), lower=True))
        if (new := _state(now)) == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
