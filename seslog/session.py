"""SparkSession settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A JSON record may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "seslog", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, app: str = "seslog-local", **extra: str) -> SparkSession:
    """One-machine session for tests and the benchmark; clusters bring their own master and sizes."""
    local = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SESLOG_DRIVER_MEMORY", "12g"),
        "spark.driver.extraJavaOptions": "-Djava.net.preferIPv4Stack=true",
    }
    spark = build_session(app, f"local[{cores}]", **{**local, **extra})
    spark.sparkContext.setLogLevel("ERROR")
    return spark
