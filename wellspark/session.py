"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """UTC, adaptive execution; ``settings`` (with ``__`` for dots) override."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
