"""Stored tables: computed once, found under the first path that exists, selected by value and granularity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the paths that exists, in any store that Spark reads."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)}")


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed by ``make`` and written there if it is not; half a table, as of a stopped job, is written anew."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_selectable(df: DataFrame, path: str, by: Sequence[str] = ("measure", "granularity")) -> None:
    """One folder for each value of the selecting columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def selected(spark: SparkSession, path: str, **choice: str) -> DataFrame:
    """The rows of the chosen measure and granularity; only their folders are read."""
    df = spark.read.parquet(path)
    for name, value in choice.items():
        df = df.where(F.col(name) == value)
    return df.drop(*choice)
