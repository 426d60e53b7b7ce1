"""Writing a costly intermediate result once, so that several branches read it instead of recomputing it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    root = spark.conf.get(SHARED_FOLDER, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SHARED_FOLDER} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seslog-stage-")
        spark.conf.set(SHARED_FOLDER, root)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The copy survives the loss of executors and cuts the lineage; unlike a row checkpoint the reader still prunes
    columns and pushes filters down.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/seslog/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
