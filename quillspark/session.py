"""The session that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillspark", **conf: str) -> SparkSession:
    """UTC times, adaptive execution with skew handling; `conf` adds or replaces settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
