"""Domain tables: how the star-schema and event tables are read as meters, readings and daily profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meter_id, ts, kind, value), one row per raw measurement."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("meter_id"), "ts", F.col("event_type").alias("kind"), "value", F.col("event_id").alias("row_id"))


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meter_id, location_id, yearly, segment): the master table."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meter_id"), F.col("c_nationkey").alias("location_id"), F.col("c_acctbal").alias("yearly"), F.col("c_mktsegment").alias("segment"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, cluster, vals): fixed-grid profiles as arrays of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vals"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, cluster, slot, value): the same, one row per slot."""
    return profiles(spark, sf_dir).select("profile_id", "cluster", F.posexplode("vals").alias("slot", "value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): every calendar date on which something was ordered."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


#: The same tables in SQL, as common table expressions.
SQL = {
    "readings": "readings AS (SELECT user_id AS meter_id, ts, event_type AS kind, value, event_id AS row_id FROM events)",
    "meters": "meters AS (SELECT c_custkey AS meter_id, c_nationkey AS location_id, c_acctbal AS yearly, c_mktsegment AS segment FROM customer)",
    "profiles": "profiles AS (SELECT vec_id AS profile_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings)",
    "slots": "slots AS (SELECT vec_id AS profile_id, label AS cluster, generate_subscripts(embedding, 1) - 1 AS slot, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "days": "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)",
}


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
