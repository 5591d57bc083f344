"""SparkSession factory: UTC, adaptive execution, partitions sized by the cluster rather than by a constant."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that queries rely on. Sizes (shuffle partitions, bytes of a scan partition) are the caller's to choose.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def create(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
