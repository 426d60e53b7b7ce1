"""Line dedup: repeated runs of lines from a suffix array that is built by distributed prefix doubling.

The sequence of a document is its lines that have a word. A line that occurs once in the whole corpus cannot be in a
repeated run: it ends every suffix that reaches it, and only the other lines are ranked. Round k sorts the distinct
pairs (rank of 2^k lines here, rank of 2^k lines from 2^k places on) over the cluster and numbers them in that order, so
ranks after it are the order of all suffixes by their first 2^(k+1) lines. Rows of equal rank are an interval of the
suffix array with a common prefix of that many lines.

A run is deleted if it has `min_words` words or more and an earlier copy (by document, then line). All maximal repeated
runs of so many words are unions of runs that just reach min_words, forward from their first line or backward from their
last, and all copies of such a run have the same length. So the rounds end at the longest of these, at most min_words
lines; a run of n lines is named by the ranks of its first and last 2^k lines (2^k <= n) and n, and the runs of one name
form one prefix interval. The smallest place of an interval stays, the others' lines go.

Defined cases: a null text stays null, an empty one empty; lines without a word are never compared and go only where the
lines around them go; a null id counts as the smallest among different texts, but beside
equal texts that have an id a row without one is a later copy; of different texts with one id the smaller digest is first; rows
equal in id and text count as one document. An untouched text is returned unchanged. Other columns, whatever their
names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seslog.llm.arrowtext import KEEP_CASE, SPACE_WORDS, Words, blocks
from seslog.llm.common import fresh_name, sha256_text, stage

MIN_WORDS = 50


_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ord, pos, line hash, words) of each line with a word; pos counts all lines."""
    for batch in blocks(batches, "text"):
        lines = Words(batch.column(2), _NOT_NEWLINE, KEEP_CASE)
        words = Words(batch.column(2), SPACE_WORDS, KEEP_CASE)
        n = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
        newlines = np.concatenate(([0], np.cumsum(words.buf == 10)))
        rows = lines.rows
        pos = newlines[lines.starts] - newlines[lines.bounds[rows]]
        some = n > 0
        of = pa.array(rows[some])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), batch.column(1).take(of), pa.array(pos[some]), pa.array(lines.hashes()[some].view(np.int64)), pa.array(n[some])],
            ["key", "ord", "pos", "line", "words"],
        )


def _ranked(values: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with an increasing rank in the order of their columns, sorted over the cluster and written once."""
    ordered = values.repartitionByRange(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns).sortWithinPartitions(*columns)
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id() + 1))


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """For k = 0, 1, ... while 2^k <= depth: (key, seq, rank) of each suffix by its first 2^k lines.

    lines: (key, seq, line), only lines that occur more than once; seq is the place in its document. A suffix that
    is cut off by the document's end or by a line that occurs once ranks before all longer ones (partner rank 0).
    """
    names = _ranked(lines.select("line").distinct(), "line")
    levels = [stage(lines.join(names, "line").select("key", "seq", "rank"))]
    reach = 1
    while 2 * reach <= depth:
        here = levels[-1]
        ahead = here.select("key", (F.col("seq") - reach).alias("seq"), F.col("rank").alias("next"))
        pairs = here.join(ahead, ["key", "seq"], "left").select("key", "seq", "rank", F.coalesce("next", F.lit(0)).alias("next"))
        names = _ranked(pairs.select("rank", "next").distinct().withColumnsRenamed({"rank": "a", "next": "b"}), "a", "b")
        levels.append(stage(pairs.join(names, (F.col("a") == pairs["rank"]) & (F.col("b") == pairs["next"])).select("key", "seq", names["rank"].alias("rank"))))
        reach *= 2
    return levels


def _just_enough(lines: DataFrame, min_words: int) -> DataFrame:
    """Runs that just reach min_words words: forward from each line, and backward from each line. (key, seq, n)."""
    stretch = Window.partitionBy("key", "stretch")
    sums = lines.withColumn("upto", F.sum("words").over(stretch.orderBy("seq"))).withColumn("low", F.col("upto") - F.col("words"))
    # the first line with min_words words between this line's start and its own, the last one with so many between its end and this one's
    beyond = F.first("seq").over(stretch.orderBy("low").rangeBetween(min_words, Window.unboundedFollowing))
    behind = F.last("seq").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    marked = sums.select(
        "key", "seq", "low", "upto", beyond.alias("beyond"), behind.alias("behind"), F.min("seq").over(stretch).alias("first"), F.max("seq").over(stretch).alias("last"), F.max("upto").over(stretch).alias("total")
    )
    forward = marked.filter(F.col("total") - F.col("low") >= min_words).select("key", "seq", (F.coalesce(F.col("beyond") - 1, "last") - F.col("seq") + 1).alias("n"))
    start = F.coalesce(F.col("behind") + 1, "first")
    backward = marked.filter(F.col("upto") >= min_words).select("key", start.alias("seq"), (F.col("seq") - start + 1).alias("n"))
    return forward.union(backward).distinct()


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """lines: (key, ord, seq, pos, line, words) -> (key, seq, n): runs with an earlier copy. ord orders the keys."""
    shared = lines.groupBy("line").agg(F.count("*").alias("copies")).filter("copies > 1").select("line")
    often = lines.join(shared, "line").select("key", "ord", "seq", "pos", "line", "words")
    # stretches: neighbouring lines that all occur more than once
    order = Window.partitionBy("key").orderBy("seq")
    kept = stage(often.withColumn("stretch", F.col("seq") - F.row_number().over(order)))
    runs = stage(_just_enough(kept, min_words))
    depth = runs.agg(F.max("n")).first()[0] or 0
    if not depth:
        return runs.select("key", "seq", "n").limit(0)
    levels = suffix_ranks(kept.select("key", "seq", "line"), depth)
    named = None
    for k, ranks in enumerate(levels):
        part = runs.filter((F.col("n") >= 1 << k) & (F.col("n") < 2 << k))
        head = part.join(ranks.withColumnRenamed("rank", "head"), ["key", "seq"])
        tail = ranks.select("key", F.col("seq").alias("tail_seq"), F.col("rank").alias("tail"))
        both = head.withColumn("tail_seq", F.col("seq") + F.col("n") - (1 << k)).join(tail, ["key", "tail_seq"]).select("key", "seq", "n", "head", "tail")
        named = both if named is None else named.union(both)
    placed = stage(named.join(kept.select("key", "seq", "ord"), ["key", "seq"]))
    first = placed.groupBy("n", "head", "tail").agg(F.min(F.struct("ord", "key", "seq")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = placed.join(first.drop("copies"), ["n", "head", "tail"]).filter(F.struct("ord", "key", "seq") > F.col("first"))
    return later.select("key", "seq", "n")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the line ranges (first, last) given for them."""
    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = text.split("\n")
            gone = np.zeros(len(lines) + 1, dtype=np.int32)
            for r in ranges:
                gone[r["a"]] += 1
                gone[r["b"] + 1] -= 1
            gone = np.cumsum(gone)
            texts.append("\n".join(line for line, g in zip(lines, gone) if not g))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "new_text"])


def _ranges(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, ranges): the line ranges, by place in the text, that are later copies."""
    runs = repeated_runs(lines, min_words)
    place = lines.select("key", "seq", "pos")
    ends = runs.withColumn("last", F.col("seq") + F.col("n") - 1).join(place.withColumnsRenamed({"seq": "last", "pos": "b"}), ["key", "last"])
    return ends.join(place.withColumnRenamed("pos", "a"), ["key", "seq"]).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, deleted: str | None = None) -> DataFrame:
    """df with later copies of repeated line runs cut out of `text`; `deleted` names a column for the number of lines cut.

    Runs are searched among distinct texts, each at the smallest id that has it; a later row with an equal text is a
    copy as a whole and becomes empty if it has min_words words. Rows equal in id and text count as one document.
    """
    key, mark = fresh_name(df, "text_key"), fresh_name(df, "line_marks")
    source = df.select(sha256_text(text).alias("key"), F.col(doc_id).alias("ord"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["ord"]
    found = source.mapInArrow(_lines, f"key string, ord {kind}, pos long, line long, words long")
    # one row per distinct text and line: copies of a text are combined before they are shuffled
    once = found.groupBy("key", "pos").agg(F.min("ord").alias("ord"), F.first("line").alias("line"), F.first("words").alias("words"), F.count("*").alias("rows"))
    lines = stage(once.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("pos"))))
    copied = lines.groupBy("key").agg(F.min("ord").alias("first"), F.max("rows").alias("rows"), F.sum("words").alias("words")).filter((F.col("rows") > 1) & (F.col("words") >= min_words))
    marks = stage(copied.select("key", "first").join(_ranges(lines, min_words), "key", "full_outer").select(F.col("key").alias(key), F.struct("first", "ranges", F.lit(True).alias("any")).alias(mark)))
    joined = df.withColumn(key, sha256_text(text)).join(marks, key, "left")
    spans = F.col(f"{mark}.ranges")
    later = ~F.col(doc_id).eqNullSafe(F.col(f"{mark}.first")) & F.col(f"{mark}.first").isNotNull()
    split = F.split(F.col(text), "\n", -1)
    in_span = lambda i: F.exists(spans, lambda r: (r["a"] <= i) & (r["b"] >= i))
    left = F.filter(split, lambda line, i: ~in_span(i))
    new = F.when(later, F.lit("")).when(spans.isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))
    count = F.when(later, F.size(split)).when(spans.isNotNull(), F.size(split) - F.size(left)).otherwise(0).cast("long")
    extra = [count.alias(deleted)] if deleted else []
    return joined.select(*[(new.alias(c) if c == text else F.col(c)) for c in df.columns], *extra)
