"""Sharding by histogram sort (Spark functions only).

Rows are ordered by (hash of the text, id), so equal texts stand together. The order's 128-bit key is counted exactly
below candidate boundaries: first at 4,096 even ones, then, for each boundary that is not yet within the tolerance,
at 256 finer ones inside the interval that holds its target, and so on. Only counts of candidates (4,096, or 256 for
each open boundary) reach the driver. When all boundaries are found, rows are exchanged once.

A group of equal texts larger than the tolerance is split by id; only rows equal in text and id cannot be split.

Defined cases: a null text has no bytes (size 16) and the checksum of the empty text; a null id is the smallest id;
repeated rows keep their number; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seslog.llm.common import stage

FIRST_BITS, STEP_BITS, WORD = 12, 8, 64
OVERHEAD = 16
TOLERANCE = 0.001
SLICE_ROWS = 1 << 18


def _digit(word: str, taken: int, bits: int) -> Column:
    """The next `bits` of a 64-bit word after the first `taken`."""
    return F.shiftrightunsigned(F.shiftleft(F.col(word), taken), WORD - bits)


def _signed(bits: int) -> int:
    return bits - (1 << WORD) if bits >= 1 << (WORD - 1) else bits


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One small row per document. h and k are compared as unsigned numbers: k is the id with its sign bit turned."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("h"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))).alias("k"),
    )


def _histogram(rows: DataFrame, prefix: Column, taken: int, bits: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """Bytes of each interval, and whether all its rows have one key."""
    word, inside = ("h", taken) if taken < WORD else ("k", taken - WORD)
    one_key = (F.min("h") == F.max("h")) & (F.min("k") == F.max("k"))
    found = rows.groupBy(prefix.alias("p"), _digit(word, inside, bits).alias("d")).agg(F.sum("size").alias("s"), one_key.alias("one")).collect()
    return {(r.p, r.d): (r.s, r.one) for r in found}


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The shards - 1 boundaries as (h, k) pairs of unsigned numbers; a row at or above a boundary lies behind it.

    tolerance is a share of one shard's even size. A round reads the small key table and returns at most
    (shards - 1) * 256 counts (4,096 in the first round).
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    target = [total * (i + 1) / shards for i in range(shards - 1)]
    found: dict[int, int] = {}
    # an open boundary: the prefix its key has so far, and the bytes below that prefix
    open_: dict[int, tuple[int, int]] = dict.fromkeys(range(shards - 1), (0, 0))
    taken, bits = 0, FIRST_BITS
    while open_ and taken < 2 * WORD:
        prefixes = sorted({p for p, _ in open_.values()})
        if taken == 0:
            within, prefix = rows, F.lit(0)
        else:
            cases, within = None, F.lit(False)
            for n, p in enumerate(prefixes):
                match = _same_prefix(p, taken)
                within = within | match
                cases = F.when(match, n) if cases is None else cases.when(match, n)
            within, prefix = rows.filter(within), cases
        counts = _histogram(within, prefix, taken, bits)
        after = {}
        for i, (p, below) in open_.items():
            n = prefixes.index(p)
            for d in range(1 << bits):
                here, single = counts.get((n, d), (0, True))
                if below + here >= target[i] or d == (1 << bits) - 1:
                    break
                below += here
            low, high = target[i] - below, below + here - target[i]
            at, rest = (p << bits) | d, 2 * WORD - taken - bits
            if min(low, high) <= allowed or single or rest == 0:
                found[i] = (at + (high < low)) << rest
            else:
                after[i] = (at, below)
        open_, taken, bits = after, taken + bits, STEP_BITS
        if taken < WORD < taken + bits:
            bits = WORD - taken
    mask = (1 << WORD) - 1
    return [(found[i] >> WORD, found[i] & mask) for i in range(shards - 1)]


def _same_prefix(prefix: int, taken: int) -> Column:
    if taken <= WORD:
        return F.shiftrightunsigned(F.col("h"), WORD - taken) == F.lit(_signed(prefix) if taken == WORD else prefix)
    first, rest = prefix >> (taken - WORD), prefix & ((1 << (taken - WORD)) - 1)
    more = taken - WORD
    return (F.col("h") == F.lit(_signed(first))) & (F.shiftrightunsigned(F.col("k"), WORD - more) == F.lit(_signed(rest) if more == WORD else rest))


def _shard_of(bounds: list[tuple[int, int]]) -> Column:
    turned = -(1 << 63)
    h, k = F.col("h").bitwiseXOR(F.lit(turned)), F.col("k").bitwiseXOR(F.lit(turned))
    out = F.lit(0)
    for a, b in bounds:
        if a >> WORD:  # past the largest key
            continue
        a, b = _signed(a ^ (1 << 63)), _signed(b ^ (1 << 63))
        out = out + F.when((h > a) | ((h == a) & (k >= b)), 1).otherwise(0)
    return out.cast("int")


def shard(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: sizes of shards are equal within the tolerance; slots run from 0.

    Slots are numbered in slices of a shard, none of which is larger than its share of hashes and ids allows, so that no
    task sorts a whole shard.
    """
    rows = stage(keyed(df, doc_id, text))
    bounds = splitters(rows, shards, tolerance)
    ids = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    parts = max(1, min(4096, ids.n // SLICE_ROWS))
    step = max(1, ((ids.high or 0) - (ids.low or 0)) // parts + 1)
    placed = rows.withColumn("shard", _shard_of(bounds)).withColumn(
        # by hash, and for a text with very many copies by id
        "slice", F.struct(_digit("h", 0, FIRST_BITS).alias("a"), F.coalesce(F.floor((F.col("doc_id") - F.lit(ids.low or 0)) / step), F.lit(-1)).alias("b"))
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slice").orderBy("h", "k")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).alias("slot"))
