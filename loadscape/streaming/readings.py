"""Readings as a stream: windowed sums with late data dropped behind a watermark, and gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, key: str, ts: str, value: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, n, total) of each window; readings later than ``late`` behind the newest are dropped."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(key, F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): readings of a key that follow each other within ``gap``."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
