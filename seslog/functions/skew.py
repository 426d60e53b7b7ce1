"""A key join whose crowded keys are not sent to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 1 << 16


def spread_join(left: DataFrame, right: DataFrame, key: str, frequent: int = FREQUENT) -> DataFrame:
    """Inner join on one key, unique in right. Both sides are read twice, so they should be staged.

    Keys that hold more than 1 / frequent of left's rows are fewer than `frequent`: their rows of right are broadcast.
    The others are shuffled, and none of them holds more than that share.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    total = left.count()
    often = F.broadcast(counts.filter(F.col("__n") * frequent > total).select(key))
    known = F.broadcast(right.join(often, key, "left_semi"))  # no more rows than often has
    return left.join(known, key).unionByName(left.join(often, key, "left_anti").join(right, key))
