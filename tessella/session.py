"""The session that the command line, the bench and the tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; on a cluster, master and partitions come from its own settings."""
    builder = SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
