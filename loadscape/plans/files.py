"""Queries on file dialects: tables are written as lines of a dialect and parsed back."""

from pyspark.sql import functions as F

from loadscape.plans.registry import query
from loadscape.sources import dialects
from loadscape.sources.tables import readings, table, with_tables


@query(with_tables("readings") + "SELECT CAST(meter_id AS VARCHAR) AS meter_id, date_trunc('second', ts) AS ts, CASE WHEN kind = 'error' THEN NULL ELSE value END AS offtake, CASE WHEN kind = 'error' THEN value END AS injection FROM readings")
def s1_comma_dialect(spark, sf_dir):
    err = F.col("kind") == "error"
    line = F.concat_ws(",", F.col("meter_id").cast("string"), F.lit("ean"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), F.when(err, "").otherwise(F.col("value").cast("string")), F.when(err, F.col("value").cast("string")).otherwise("n/a"))
    return dialects.comma_readings(readings(spark, sf_dir).select(line.alias("value")))


@query(with_tables("readings") + "SELECT CAST(meter_id AS VARCHAR) AS meter_id, CASE WHEN kind = 'purchase' THEN 'Offtake' ELSE 'Injection' END AS measure, date_trunc('second', ts) AS ts, value FROM readings")
def s2_semicolon_dialect(spark, sf_dir):
    kind = F.when(F.col("kind") == "purchase", "Afname").otherwise("Injectie")
    line = F.concat_ws(";", F.lit("a"), F.lit("b"), F.col("meter_id").cast("string"), kind, F.date_format("ts", "ddMMMyy:HH:mm:ss"), F.lit(""), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    return dialects.semicolon_readings(readings(spark, sf_dir).select(line.alias("value")))


@query("SELECT CAST(vec_id AS VARCHAR) AS meter_id, TIMESTAMP '2021-01-01' + INTERVAL (15 * k) MINUTE AS ts, 'Off' AS kind, round(CAST(embedding[k + 1] AS DOUBLE), 4) AS value FROM embeddings, (SELECT unnest(range(64)) AS k)")
def s6_quarter_hour_rows(spark, sf_dir):
    vals = F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 4).cast("string")), ";")
    line = F.concat_ws(";", F.col("vec_id").cast("string"), F.lit("2021-01-01 00:00:00"), F.lit("2021-01-02 00:00:00"), F.lit("Off"), vals)
    return dialects.quarter_hour_rows(table(spark, sf_dir, "embeddings").select(line.alias("value")))


@query("SELECT CAST(o_orderkey AS INT) AS i1, CAST(o_custkey AS INT) AS i2, o_orderstatus = 'F' AS is_ml FROM orders")
def s19_constraint_log(spark, sf_dir):
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", ", True").otherwise(", False"))
    return dialects.constraint_log(table(spark, sf_dir, "orders").select(line.alias("value")))


@query("SELECT CAST(s_suppkey AS INT) AS step, s_name AS value FROM supplier")
def s20_numbered_files(spark, sf_dir):
    return dialects.numbered_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("/logs2/run_"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"), F.col("s_name").alias("value")))


@query("SELECT c_acctbal AS loss FROM customer WHERE c_mktsegment = 'BUILDING'")
def s21_training_log(spark, sf_dir):
    line = F.concat(F.lit("epoch 1 "), F.when(F.col("c_mktsegment") == "BUILDING", "loss: ").otherwise("done "), F.col("c_acctbal").cast("string"))
    return dialects.losses(table(spark, sf_dir, "customer").select(line.alias("value")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def s22_json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT o_orderkey, TIMESTAMP '1899-12-30' + INTERVAL (CAST(round((o_orderkey % 50000 + 0.25) * 1440) AS BIGINT)) MINUTE AS ts FROM orders")
def s7_excel_serial_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dialects.excel_serial(F.col("o_orderkey") % 50000 + F.lit(0.25)).alias("ts"))
