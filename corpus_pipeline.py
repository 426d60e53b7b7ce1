"""A training corpus from `documents`: low quality out, repeated lines cut, near copies and benchmark passages out, encoded.

Each stage takes what the one before it kept, as Parquet that was written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.staging import stage, staging_root
from seslog.llm import bpe, decontaminate, linededup, minhash, quality, vocabulary
from seslog.llm.common import sha256_text, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long line runs go; so does a document of which nothing is left."""
    cut = linededup.dedup_lines(docs, deleted="lines_deleted").filter((F.col("lines_deleted") == 0) | (F.btrim("text", F.lit(quality.BLANKS)) != ""))
    return cut.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("lines_deleted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and the digest of the text that the ids give back."""
    path = vocabulary.default_path()
    # written in between: a task that encodes and decodes has two Python workers, each with its batches, on top of an executor's heap
    ids = stage(bpe.encode(docs, path))
    return bpe.decode(ids, path).withColumn("decoded_sha256", sha256_text("decoded")).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_root(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for n, (_, work) in enumerate(STAGES):
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
