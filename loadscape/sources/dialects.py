"""Readers of meter files: CSV dialects, fixed-layout texts, logs and configurations.

Each parser takes a table of lines (``spark.read.text``), so files of any number and size are parsed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.operators.cleaning import decimal_comma

ISO, COMPACT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ddMMMyy:HH:mm:ss"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a given schema; unused columns are pruned by the reader."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding)


def timestamp(text: Column, pattern: str) -> Column:
    """A naive timestamp, NULL where the text does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def _fields(lines: DataFrame, sep: str, names: list[str]) -> DataFrame:
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": sep})
    return lines.select(parsed.alias("r")).select("r.*")


def comma_readings(lines: DataFrame) -> DataFrame:
    """(meter_id, ts, offtake, injection) from columns 0, 2, 3 and 4 of comma-separated lines."""
    f = _fields(lines, ",", ["meter_id", "ean", "ts", "offtake", "injection"])
    return f.select("meter_id", timestamp(F.col("ts"), ISO).alias("ts"), F.col("offtake").try_cast("double").alias("offtake"), F.col("injection").try_cast("double").alias("injection"))


def semicolon_readings(lines: DataFrame) -> DataFrame:
    """(meter_id, measure, ts, value) from columns 2, 3, 4 and 6; decimal commas; 'Afname' is Offtake, all else Injection."""
    f = _fields(lines, ";", ["a", "b", "meter_id", "kind", "ts", "c", "value"])
    return f.select("meter_id", F.when(F.col("kind") == "Afname", "Offtake").otherwise("Injection").alias("measure"), timestamp(F.col("ts"), COMPACT).alias("ts"), decimal_comma(F.col("value")).alias("value"))


def quarter_hour_rows(lines: DataFrame) -> DataFrame:
    """(meter_id, ts, kind, value): lines 'id;from;to;kind;v0;v1;...' exploded to one row each 15 minutes."""
    parts = F.split("value", ";")
    rows = lines.select(parts[0].alias("meter_id"), parts[1].cast("timestamp_ntz").alias("start"), parts[3].alias("kind"), F.posexplode(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0)))).alias("k", "v"))
    return rows.select("meter_id", F.expr("start + k * INTERVAL 15 MINUTES").alias("ts"), "kind", F.col("v").try_cast("double").alias("value"))


def constraint_log(lines: DataFrame) -> DataFrame:
    """(i1, i2, is_ml) from 'i1,i2, True' lines."""
    f = _fields(lines, ",", ["i1", "i2", "ml"])
    return f.select(F.col("i1").try_cast("int").alias("i1"), F.col("i2").try_cast("int").alias("i2"), (F.trim("ml") == "True").alias("is_ml"))


def losses(lines: DataFrame) -> DataFrame:
    """The number after 'loss:' of the lines that have one."""
    found = F.regexp_extract("value", r"loss:\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    return lines.where(found != "").select(found.cast("double").alias("loss"))


def numbered_files(lines: DataFrame) -> DataFrame:
    """(step, value) of lines that carry their file's name in ``path``: the number in the name orders the files."""
    return lines.select(F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("int").alias("step"), "value")


def excel_serial(days: Column) -> Column:
    """A spreadsheet's serial date, to the minute."""
    minutes = F.round(days * 1440).cast("bigint")
    return F.timestamp_add("MINUTE", minutes, F.lit("1899-12-30").cast("timestamp_ntz"))
