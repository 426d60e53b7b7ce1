"""Substring dedup: windows of words that occur elsewhere, found by an FM-index per shard of the corpus.

Equal windows have to meet in one shard, so a shard holds a part of the corpus by content, not by document. The shingles
of a window are hashed; the least of them (the leftmost, where they tie) is the window's minimizer, and equal windows
have equal minimizers. Neighbouring windows with one minimizer are a segment. Segments whose minimizer occurs once in the
corpus hold no repeated window. Of the others each distinct text is taken once, marked if there is more than one copy,
and goes to the shard of its minimizer. Minimizers that occur very often go there window by window, by the hash of the
window, so that no shard has to hold all that surrounds a common passage.

A shard builds the FM-index of its segments (a wavelet matrix of word numbers) and asks it about them: backward search
gives, for a place, the longest run of words up to it that occurs twice. Windows inside such a run are repeated, those that
hold it and the word before it are not; places are asked until no window of a segment is open. All windows of a segment fit a mask of 64 bits, which goes back to every copy of the segment; words
under repeated windows are cut from the texts.

Words, segments and minimizers are known by 64-bit hashes; a segment by its own and its minimizer's together.

Defined cases: a document is a row, so equal rows are copies of each other and all of them lose what they share; ids may
repeat or be null. A null or empty text, or one without words, has no words and keeps nothing (empty); a text with fewer
words than a window keeps all. Kept words are joined by one space. An empty table gives an empty table. Other columns,
whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seslog.llm.arrowtext import KEEP_CASE, SPACE_WORDS, Words, _powers, blocks, mix
from seslog.llm.common import stage
from seslog.llm.fmindex import FMIndex
from seslog.llm.hotjoin import counted_join

WINDOW = 35
MOST_SHINGLES = 24  # shingles of a window, and so windows of a segment; a mask holds 63
SHARD_WORDS = 1 << 20
CLASS_SEGMENTS = 1 << 12  # a minimizer that occurs more often is dealt out window by window
STREAM = 1 << 17


def window_segments(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first word, windows, minimizer, digest) of the segments of a block of texts, in order."""
    n, shingles = len(hashes), min(MOST_SHINGLES, window)
    left = np.repeat(words.first[1:], words.counts) - np.arange(n)
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    value, at = words.shingles(hashes, window - shingles + 1)
    whole = np.zeros(n, dtype=np.uint64)
    whole[at] = value
    least = np.full(n, ~np.uint64(0))
    least[at] = (value >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= shingles:
        least[: n - reach] = np.minimum(least[: n - reach], least[reach:])
        reach *= 2
    if rest := shingles - reach:
        least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(hashes * power[:n], dtype=np.uint64)))
        last = first + count + window - 1
        digest = mix((total[last] - total[first]) * inverse[first] + count.astype(np.uint64))
    return first, count, whole[place[at]].view(np.int64), digest.view(np.int64)


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column(1), SPACE_WORDS, KEEP_CASE)
            first, count, minimizer, digest = window_segments(words, words.hashes(), window)
            row = np.searchsorted(words.first, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(first - words.first[row]), pa.array(count.astype(np.int32)), pa.array(minimizer), pa.array(digest)],
                ["row", "start", "n", "mini", "digest"],
            )

    return run


def _segment_words(window: int):
    """Rows of a text and its chosen segments to one row a segment, with its words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column(0), SPACE_WORDS, KEEP_CASE)
            hashes = words.hashes().view(np.int64)
            wanted = batch.column(1)
            parts = wanted.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            start, n = (parts.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            first, size = words.first[row] + start, n + window - 1
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(hashes[place]))
            kept = ("mini", "digest", "copies", "seen", "n")
            yield pa.RecordBatch.from_arrays([*(parts.field(c) for c in kept), lists], [*kept, "words"])

    return run


def repeated_masks(index: FMIndex, stream: np.ndarray, begin: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """A bit for each window of the segments that begin at `begin` that occurs twice.

    A window is asked for the longest run up to its end that occurs twice, as far back as windows are open: all windows inside the
    run are repeated, and none is that holds the run and the word before it. The open windows on both sides are asked next.
    """
    mask = np.zeros(len(begin), dtype=np.int64)
    of = np.flatnonzero(windows > 0)
    low, high = np.zeros(len(of), dtype=np.int64), windows[of].astype(np.int64)
    nth = high - 1
    while len(of):
        ends = begin[of] + nth + window - 1
        run = np.concatenate([
            index.matching_statistics(stream, ends[at : at + STREAM], (window + nth - low)[at : at + STREAM]) for at in range(0, len(of), STREAM)
        ])
        word = nth + window - 1 - run  # the word before the run, or the one before the first open window
        hit = run >= window
        first, count = word[hit] + 1, (run - window + 1)[hit]
        np.bitwise_or.at(mask, of[hit], ((np.int64(1) << count) - 1) << first)
        left, right = np.where(hit, word + 1, nth), np.where(hit, nth, word) + 1
        more, rest = left > low, right < high
        asked = np.where(hit, left - 1, np.maximum(low, word - window))
        of, low, high, nth = (np.concatenate(x) for x in ((of[more], of[rest]), (low[more], right[rest]), (left[more], high[rest]), (asked[more], right[rest])))
    return mask


def _search(window: int):
    """The rows of a shard (mini, digest, copies, words) to (mini, digest, mask): its windows that occur twice."""

    def run(rows: pa.Table) -> pa.Table:
        lists = rows.column("words").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        known, number = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
        begin = offsets[:-1] - offsets[0] + np.arange(len(sizes))  # a 0 stands after every segment before
        stream = np.zeros(len(number) + len(sizes), dtype=np.int64)
        stream[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = number + 1
        index = FMIndex(stream, len(known) + 1, np.repeat(rows.column("copies").to_numpy() > 1, sizes + 1))
        mask = repeated_masks(index, stream, begin, sizes - window + 1, window)
        return pa.table({"mini": rows.column("mini"), "digest": rows.column("digest"), "mask": mask}).filter(pa.array(mask != 0))

    return run


def _searched(units: DataFrame, shard, window: int, shard_words: int) -> DataFrame:
    """units (mini, digest, copies, words) -> (mini, digest, mask) of those with repeated windows."""
    total = units.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = total // shard_words + 1
    dealt = units.select(F.pmod(shard, F.lit(shards)).alias("shard"), "mini", "digest", "copies", "words")
    return dealt.groupBy("shard").applyInArrow(_search(window), "mini long, digest long, mask long")


def repeated_windows(rows: DataFrame, window: int, shard_words: int, class_segments: int, frequent: int) -> DataFrame:
    """rows (row, text) -> (row, start, mask): segments by their first word, with a bit for each repeated window."""
    found = stage(rows.mapInArrow(_segments(window), "row long, start long, n int, mini long, digest long"))
    shared = stage(found.groupBy("mini").agg(F.count("*").alias("seen")).filter("seen > 1"))
    candidates = stage(counted_join(found, shared, ["mini"], "seen", frequent))
    # the first copy of a segment stands for it: its place is taken from one row, and written with the count
    same = candidates.groupBy("mini", "digest").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("row", "start", "n", "seen")])
    distinct = stage(same)
    wanted = distinct.groupBy("row").agg(F.collect_list(F.struct("start", "n", "mini", "digest", "copies", "seen")).alias("wanted"))
    segments = rows.join(wanted, "row").select("text", "wanted").mapInArrow(_segment_words(window), "mini long, digest long, copies long, seen long, n int, words array<long>")
    segments = stage(segments)
    masks = _searched(segments.filter(F.col("seen") <= class_segments), F.col("mini"), window, shard_words)
    # crowded minimizers: each distinct window is a unit of its own
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth")
    windows = segments.filter(F.col("seen") > class_segments).select("mini", "digest", "copies", at, "words").withColumn("words", F.slice("words", F.col("nth") + 1, window))
    windows = stage(windows.withColumn("key", F.xxhash64("words")))
    units = stage(windows.groupBy("mini", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("segments"), F.first("words").alias("words")))
    hits = _searched(units.withColumnRenamed("key", "digest"), F.xxhash64("mini", "digest"), window, shard_words).select("mini", F.col("digest").alias("key"))
    hits = stage(hits.join(units.select("mini", "key", "segments"), ["mini", "key"]))
    crowded = counted_join(windows.select("mini", "digest", "key", "nth"), hits, ["mini", "key"], "segments", frequent)
    bit = F.expr("shiftleft(1L, nth)")
    masks = masks.unionByName(crowded.groupBy("mini", "digest").agg(F.bit_or(bit).alias("mask")))
    counted = stage(masks.join(distinct.select("mini", "digest", "copies"), ["mini", "digest"]))
    return counted_join(candidates.select("row", "start", "mini", "digest"), counted, ["mini", "digest"], "copies", frequent).select("row", "start", "mask")


def _cut(window: int, size: int):
    """(text, hits, other columns) -> other columns and (n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column(0), SPACE_WORDS, KEEP_CASE)
            n, hits = len(words.starts), batch.column(1)
            parts = hits.flatten()
            row = np.repeat(np.arange(batch.num_rows), hits.value_lengths().fill_null(0).to_numpy())
            start, mask = (parts.field(c).to_numpy().astype(np.int64) for c in ("start", "mask"))
            change = np.zeros(n + 1, dtype=np.int64)
            for k in range(size):
                at = (words.first[row] + start)[(mask >> k) & 1 == 1] + k
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
            keep = np.cumsum(change)[:n] == 0
            of = words.rows
            starts, sizes = words.starts[keep], (words.ends - words.starts)[keep] + 1
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
            text = words.buf[np.minimum(place, max(len(words.buf) - 1, 0))] if len(place) else np.zeros(0, dtype=np.uint8)
            text[ends - 1] = 0x20
            count = np.bincount(of[keep], minlength=batch.num_rows)
            # the space after a row's last word is left out
            last = np.cumsum(count)[count > 0] - 1
            drop = np.ones(len(text), dtype=bool)
            drop[ends[last] - 1] = False
            sizes[last] -= 1
            lengths = np.bincount(of[keep], sizes, batch.num_rows).astype(np.int64)
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            kept = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[drop].tobytes()))
            numbers = [pa.array(words.counts.astype(np.int64)), pa.array((words.counts - count).astype(np.int64)), kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *numbers], [*batch.schema.names[2:], "n_words", "n_removed", "kept"])

    return run


def cut_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, out: str = "cut", shard_words: int = SHARD_WORDS, class_segments: int = CLASS_SEGMENTS, frequent: int = 1 << 16) -> DataFrame:
    """df without its texts and with a struct column `out` (an older one is replaced): n_words, n_removed and the kept text."""
    inner = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in (text, out)}
    # rows are numbered where they are written, so a number stays with its row when a task is run again
    rows = stage(df.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in inner.items()]))
    hits = repeated_windows(rows.select("row", "text"), window, shard_words, class_segments, frequent)
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))
    marked = rows.join(hits, "row", "left").select("text", "hits", *inner.values())
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    done = marked.mapInArrow(_cut(window, min(MOST_SHINGLES, window)), T.StructType([*marked.schema.fields[2:], *added]))
    return done.select(*[F.col(k).alias(c) for c, k in inner.items()], F.struct("n_words", "n_removed", "kept").alias(out))
