"""A bitmap of fixed size (2^23 bits, 1 MB) over hashes: what may be broadcast whatever the size of the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def slots(hashes: np.ndarray) -> np.ndarray:
    """The bit of each 64-bit hash."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def is_set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def collect(rows: DataFrame, slot: str = "slot") -> np.ndarray:
    """The bitmap of a column of slots; at most 2^17 words reach the driver."""
    word = F.shiftright(F.col(slot), 6).alias("word")
    found = rows.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 AS int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return table
