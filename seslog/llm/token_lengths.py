"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Encoded lengths are combined to one row per length before they are shuffled, so documents and hot sources do not
matter afterwards. Sums over all longer documents are taken in two levels (blocks of lengths, then inside a block).

Defined cases: a null or empty text has length 0; repeated rows count each time; an empty table has no lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seslog.llm.arrowtext import blocks
from seslog.llm.vocabulary import load

BLOCK = 256


def length_histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many rows of df have each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        counts: dict[int, int] = {}
        for batch in blocks(batches, text, 1 << 21):
            for t in batch.column(0).to_pylist():
                n = len(vocabulary.encode_array(t)) if t else 0
                counts[n] = counts.get(n, 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return df.select(text).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens of length L or more, of all lengths, and the tokens that are
    left if every document is cut at L (tokens_if_cut); share_at_most is the share of documents of length L or less."""
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = histogram.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_block = (
        rows.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
            F.sum("d").over(whole).alias("total_docs"),
            F.sum("t").over(whole).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = F.sum("n_docs").over(inside) + F.col("later_docs")
    tokens = F.sum("tokens").over(inside) + F.col("later_tokens")
    summed = rows.join(by_block, "block").select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens")
    return summed.withColumn("tokens_if_cut", F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).withColumn(
        "share_at_most", (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")
    )


def tokens_cut_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens): all tokens left if documents are cut at each limit, occurring length or not."""
    spark = sums.sparkSession
    # the smallest length above a limit holds the sums of all longer documents
    picked = [
        sums.filter(F.col("n_tokens") > limit).agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s")).select(F.lit(limit).cast("long").alias("context_limit"), "s")
        for limit in limits
    ]
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("all_tokens"))
    out = spark.createDataFrame([], "context_limit long, s struct<docs_at_least:long,tokens_at_least:long>")
    for one in picked:
        out = out.unionByName(one)
    left = F.coalesce(F.col("all_tokens") - F.col("s.tokens_at_least") + F.col("s.docs_at_least") * F.col("context_limit"), F.col("all_tokens"))
    return out.join(F.broadcast(total)).select("context_limit", left.alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents do not exceed (no row for an empty table)."""
    return sums.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


