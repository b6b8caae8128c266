"""One way to get a session: UTC, ANSI SQL, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "martlib", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect. Sizes (memory, partitions) are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    return builder.config(map=settings).getOrCreate()
