"""Written tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written, for ``clean``.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may leave that unset: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loadscape-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete every table that this process wrote; results that were not yet read or written elsewhere are lost with them."""
    while _written:
        _delete(spark, _written.pop())


class Scratch:
    """Tables written under one folder of their own. ``drop`` deletes one that nothing reads any longer."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        if not self._paths:
            _written.append(self.base)
        path = f"{self.base}/{len(self._paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, self._paths[id(df)][1])
