"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seslog.functions.staging import stage

__all__ = ["stage", "table", "spread", "fresh_name", "checksum_of_id", "sha256_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows out evenly by the given columns over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checksum_of_id(column: Column | str) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def sha256_text(column: Column | str) -> Column:
    """Lower-case hex of the SHA-256 of a text in UTF-8; null counts as the empty text."""
    return F.sha2(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), 256)
