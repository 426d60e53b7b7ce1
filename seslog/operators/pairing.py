"""Calls and their results by id and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import EVENTS_PER_BLOCK, event_block, last_value, ordered_scan


def pair(rows: DataFrame, keys: Sequence[str], position: str, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Each result with the latest earlier call of its key; calls without a result and results without a call stay.

    ``rows`` has a boolean ``is_call``. An ordered scan finds the call, so a key with very many calls is no group of
    its own in one task.
    """
    keys = list(keys)
    place = F.col(position)
    scanned = ordered_scan(
        rows, keys, event_block(position, block_size), [position],
        call_pos=last_value(F.when(F.col("is_call"), place), before=True),
    )
    results = scanned.filter("NOT is_call").withColumnRenamed(position, "result_pos").withColumn("status", F.lit("completed"))
    calls = rows.filter("is_call").withColumnRenamed(position, "call_pos")
    open_calls = calls.join(results.select(*keys, "call_pos"), [*keys, "call_pos"], "left_anti").withColumn("status", F.lit("started"))
    return results.unionByName(open_calls, allowMissingColumns=True).drop("is_call")
