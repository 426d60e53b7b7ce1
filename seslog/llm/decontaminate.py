"""Benchmark decontamination: a prefix-filtered set join of item windows with document passages.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. A window is `window` consecutive words of
an item, or all of a shorter item. Shingles are `SHINGLE` consecutive words (a shorter window is one shingle).

1. All shingles of item windows set bits of a bitmap of fixed size (1 MB), the only thing that is broadcast by hand.
2. Documents are read once. Words inside a shingle whose bit is set form passages; a passage shorter than the shortest
   window is dropped (length bound). Nothing can be lost: an occurrence has only item shingles. Equal passages are
   combined before they are joined, so a passage in a third of all documents is one row.
3. Shingles are ordered by how many passages hold them. Containment of a whole window needs all its shingles, so its
   necessary prefix is its rarest one: windows and passages are joined on it alone, at the place that the shingle has
   in the window (positional bound), and the words are compared.

Defined cases: null and empty texts have no words and are clean; an item without words has no window; repeated items and
rows each count for themselves; with no items, or no documents, nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seslog.llm import bitmap as bits_of
from seslog.llm.arrowtext import ALNUM_WORDS, Words, blocks
from seslog.llm.common import fresh_name, sha256_text, stage

WINDOW, SHINGLE = 10, 3


def _item_bits(window: int):
    """(slot, size, shortest): bits of shingles, their number of words and the shortest window of their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column(0), ALNUM_WORDS)
            hashes, counts = words.hashes(), words.counts
            for size in range(1, SHINGLE + 1):
                value, at = words.shingles(hashes, size)
                if size < SHINGLE:  # only items of just so many words
                    value = value[counts[words.rows[at]] == size]
                slots = np.unique(bits_of.slots(value))
                if len(slots):
                    fits = np.minimum(counts[counts >= size], window) if size == SHINGLE else np.array([size])
                    shortest = np.full(len(slots), int(fits.min()))
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), size)), pa.array(shortest)], ["slot", "size", "shortest"])

    return run


def _bitmap(items: DataFrame, window: int) -> tuple[np.ndarray, list[int], int]:
    found = stage(items.mapInArrow(_item_bits(window), "slot long, size long, shortest long").groupBy("slot", "size").agg(F.min("shortest").alias("shortest")))
    facts = found.agg(F.collect_set("size").alias("sizes"), F.min("shortest").alias("shortest")).first()
    return bits_of.collect(found), sorted(facts.sizes), int(facts.shortest or 1)


def _passages(bitmap, sizes: list[int], shortest: int):
    """Each row with its number of words and the passages that consist of item shingles: (start word, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value
        for batch in blocks(batches, "text"):
            words = Words(batch.column(0), ALNUM_WORDS)
            hashes = words.hashes()
            covered = np.zeros(len(hashes) + 1, dtype=np.int32)
            for size in sizes:
                value, at = words.shingles(hashes, size)
                hit = at[bits_of.is_set(table, bits_of.slots(value))]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + size, -1)
            inside = np.cumsum(covered[:-1]) > 0
            before, after = np.zeros_like(inside), np.zeros_like(inside)
            before[1:], after[:-1] = inside[:-1], inside[1:]
            some = words.counts > 0
            before[words.first[:-1][some]] = False  # passages end with their text
            after[words.first[1:][some] - 1] = False
            starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            long_enough = ends - starts >= shortest
            starts, ends = starts[long_enough], ends[long_enough]
            owner = words.rows[starts] if len(starts) else starts
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for row, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
                found[row].append({"start": a - int(words.first[row]), "passage": words.text(a, b)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(words.counts.astype(np.int64)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("passage", pa.string())])))],
                [*batch.schema.names[1:], "n_words", "passages"],
            )

    return run


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """One row per distinct window: its words and the items that have it."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_id).alias("item_id"), F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    placed = words.filter(F.size("words") > 0).select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return placed.select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words")).distinct()


def _shingled(df: DataFrame, words: str, size) -> DataFrame:
    """df with one row per place of a shingle of `size` words: (at, shingle)."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    return df.withColumn("at", F.explode(places)).withColumn("shingle", F.array_join(F.slice(words, F.col("at") + 1, size), " "))


def passage_hits(passages: DataFrame, windows: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(pid, passage) -> (pid, n_hit: words inside a window, items). Only passages with a hit are returned.

    sizes: the sizes of shingles that windows have. A place of a shingle carries only the words a window there can reach.
    """
    size = F.least(F.size("words"), F.lit(SHINGLE))
    parts = _shingled(windows.select("words").distinct(), "words", size).select("words", "at", "shingle")
    split = passages.select("pid", F.split("passage", " ").alias("p"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size"))
    base = F.greatest(F.col("at") - (window - 1), F.lit(0))
    near = F.slice("p", base + 1, F.lit(2 * window + SHINGLE))
    places = stage(_shingled(split, "p", F.col("size")).select("pid", F.col("at").alias("p_at"), "shingle", base.alias("base"), near.alias("near")))
    rarity = places.groupBy("shingle").agg(F.count("*").alias("n"))
    # a window with a shingle that no passage has occurs nowhere; the others keep their rarest
    ranked = parts.join(rarity, "shingle", "left").groupBy("words").agg(
        F.min_by(F.struct("shingle", "at"), F.struct(F.coalesce("n", F.lit(0)), "shingle", "at")).alias("rarest"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    )
    prefix = ranked.filter("n > 0").select("words", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("at"))
    start = F.col("p_at") - F.col("at")
    joined = places.join(prefix, "shingle").filter(start >= F.col("base")).filter(F.slice("near", start - F.col("base") + 1, F.size("words")) == F.col("words"))
    found = stage(joined.select("pid", "words", start.alias("start"), (start + F.size("words")).alias("end")))
    reach = Window.partitionBy("pid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(reach), F.lit(0))), F.lit(0))
    hits = found.select("pid", "start", "end").distinct().withColumn("new", new).groupBy("pid").agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.select("pid", "words").distinct().join(windows, "words").groupBy("pid").agg(F.collect_set("item_id").alias("items"))
    return hits.join(items, "pid")


def match(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_words, n_hit and items (ids of the items with occurring windows).

    window may be any positive number of words; windows longer than three words are searched by three-word shingles.
    """
    spark = docs.sparkSession
    windows = stage(item_windows(items, item_id, item_text, window))
    bitmap, sizes, shortest = _bitmap(items.select(F.col(item_text).alias("text")), window)
    shared = spark.sparkContext.broadcast(bitmap)
    source = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), sha256_text(text).alias("text_sha256"))
    kind = dict(source.dtypes)["doc_id"]
    scanned = stage(
        source.mapInArrow(
            _passages(shared, sizes, min(shortest, window)), f"doc_id {kind}, text_sha256 string, n_words long, passages array<struct<start:long,passage:string>>"
        )
    )
    rows = scanned.filter(F.size("passages") > 0)
    # equal texts have equal passages: from here on, one row per text
    by_text = rows.dropDuplicates(["text_sha256"]).select("text_sha256", F.explode("passages.passage").alias("passage"))
    # the ids are written with the passages once, so that every reader sees the same
    distinct = stage(by_text.select("passage").distinct().withColumn("pid", F.monotonically_increasing_id()))
    hits = stage(passage_hits(distinct, windows, sizes or [SHINGLE], window)).join(distinct, "pid").drop("pid")
    counted = by_text.join(hits, "passage").groupBy("text_sha256").agg(F.sum("n_hit").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    clean = scanned.filter(F.size("passages") == 0).select("doc_id", "text_sha256", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(f"array<{dict(windows.dtypes)['item_id']}>").alias("items"))
    touched = rows.select("doc_id", "text_sha256", "n_words").join(counted, "text_sha256", "left")
    return clean.unionByName(
        touched.select("doc_id", "text_sha256", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array()).alias("items"))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a window of an item; all columns are kept."""
    key = fresh_name(docs, "text_sha256")
    marker = fresh_name(docs, "match_id")
    hit = match(docs.select(F.lit(0).alias(marker), text), items, marker, text, **options).filter("n_hit > 0").select(F.col("text_sha256").alias(key)).distinct()
    return docs.withColumn(key, sha256_text(text)).join(hit, key, "left_anti").select(*docs.columns)
