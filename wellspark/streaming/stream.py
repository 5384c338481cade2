"""Structured Streaming forms of the append-only parts (an extension: the batch operators are the same)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.operators.labels import current_states
from wellspark.sources.catalog import parse


def read_stream(spark: SparkSession, path: str, schema: object, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark (on a zoned timestamp, as watermarks need one); a batch frame as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def window_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts with a watermark; the same expression on a batch frame gives the final result."""
    counted = _watermarked(events, time, late)
    return counted.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    counted = _watermarked(events, time, late)
    return counted.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def decision_log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch``: decisions go to a folder of their batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def decision_state(spark: SparkSession, path: str) -> DataFrame:
    return current_states(spark.read.parquet(path))


def replace_directories_sink(path: str, key: str = "directory") -> Callable[[DataFrame, int], None]:
    """``foreachBatch``: an incoming folder's rows replace its old ones; repeating a batch changes nothing."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return write


def new_images(spark: SparkSession, root: str, pattern: str, glob: str = "*.tif*") -> DataFrame:
    """A stream of parsed file names; contents aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return parse(files.select("path"), pattern)
