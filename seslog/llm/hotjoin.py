"""An inner join with a table of counted keys that no key can crowd."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 1 << 16


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, frequent: int = FREQUENT) -> DataFrame:
    """left joined to right on keys. right has one row a key; its column `count` says how many rows of left have the key (or is not below).

    Keys with more than 1 / frequent of all rows are fewer than `frequent`: they are broadcast. The others are shuffled,
    and none of them has more rows than that share.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_often = F.col(count) * frequent > total
    often = F.broadcast(right.filter(is_often))
    rest = left.join(often.select(*keys), keys, "left_anti").join(right.filter(~is_often), keys)
    return left.join(often, keys).unionByName(rest)
