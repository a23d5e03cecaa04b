"""Queries on cleaning operators and features of dates and readings."""

from pyspark.sql import functions as F

from loadscape.functions import calendar as cal
from loadscape.functions import features as feat
from loadscape.operators import cleaning as ops
from loadscape.plans.registry import query
from loadscape.sources.tables import days, meters, readings, table, with_tables


@query(with_tables("readings") + """
SELECT row_id, CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), second(ts)) ELSE date_trunc('second', ts) END AS ts FROM readings""")
def p3_swap_day_month(spark, sf_dir):
    return readings(spark, sf_dir).select("row_id", ops.swap_day_month(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("ts"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def p4_dedup_full_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").dropDuplicates()


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def p5_first_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ops.first_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round_even(coalesce(o, 0) - coalesce(i, 0), 4) AS consumption
FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS o, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS i FROM lineitem)""")
def p6_net_consumption(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    o, i = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", ops.net(o, i).alias("consumption"))


@query(with_tables("readings") + """
SELECT row_id, CASE WHEN kind = 'purchase' THEN value ELSE 0 END AS offtake, CASE WHEN kind <> 'purchase' THEN value END AS injection FROM readings""")
def p7_split_by_kind(spark, sf_dir):
    off = F.col("kind") == "purchase"
    return readings(spark, sf_dir).select("row_id", F.when(off, F.col("value")).otherwise(0.0).alias("offtake"), F.when(~off, F.col("value")).alias("injection"))


@query(with_tables("readings") + """
SELECT row_id, CASE WHEN kind = 'error' AND value > 0 THEN -value ELSE value END AS consumption FROM readings""")
def p8_signed_consumption(spark, sf_dir):
    return readings(spark, sf_dir).select("row_id", ops.signed(F.col("value"), F.col("kind") == "error").alias("consumption"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS clipped FROM customer""")
def p9_clip_negative(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ops.clip_negative(F.col("c_acctbal")).alias("clipped"))


@query(with_tables("readings", "meters") + """
SELECT row_id, meter_id, value FROM readings WHERE meter_id NOT IN (SELECT meter_id FROM meters WHERE yearly > 5000)""")
def p10_drop_large_meters(spark, sf_dir):
    return ops.drop_over(readings(spark, sf_dir), meters(spark, sf_dir), "meter_id", "yearly", 5000.0).select("row_id", "meter_id", "value")


@query(with_tables("readings") + """
SELECT row_id, meter_id FROM readings WHERE meter_id NOT IN (SELECT meter_id FROM readings GROUP BY 1 HAVING count(*) FILTER (kind = 'error') > 15)""")
def p11_drop_by_count(spark, sf_dir):
    return ops.drop_by_count(readings(spark, sf_dir), "meter_id", F.col("kind") == "error", 15).select("row_id", "meter_id")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice AS p FROM lineitem),
b AS (SELECT a.* FROM a, (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM a) WHERE p BETWEEN lo AND hi)
SELECT b.* FROM b, (SELECT quantile_cont(q, 0.01) AS lo, quantile_cont(q, 0.99) AS hi FROM b) WHERE q BETWEEN lo AND hi""")
def p12_percentile_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return ops.between_percentiles(rows, ["p", "q"])


@query(with_tables("meters") + """
SELECT meter_id, CASE segment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN false END AS flag, starts_with(segment, 'AUTO') AS auto FROM meters""")
def p16_translate_values(spark, sf_dir):
    flag = F.when(F.col("segment") == "BUILDING", True).when(F.col("segment") == "MACHINERY", False)
    return meters(spark, sf_dir).select("meter_id", flag.alias("flag"), F.col("segment").startswith("AUTO").alias("auto"))


@query(with_tables("meters") + """
SELECT meter_id, TRY_CAST(replace(nullif(trim(t), '/'), ',', '.') AS DOUBLE) AS power
FROM (SELECT meter_id, CASE WHEN meter_id % 7 = 0 THEN '/' WHEN meter_id % 5 = 0 THEN 'n/a' ELSE CAST(location_id AS VARCHAR) || ',25' END AS t FROM meters)""")
def p17_float_field(spark, sf_dir):
    t = F.when(F.col("meter_id") % 7 == 0, "/").when(F.col("meter_id") % 5 == 0, "n/a").otherwise(F.concat(F.col("location_id").cast("string"), F.lit(",25")))
    return meters(spark, sf_dir).select("meter_id", ops.decimal_comma(t).alias("power"))


@query(with_tables("readings") + """
SELECT row_id, 'smartmeter_' || k AS meter FROM readings JOIN (SELECT meter_id, row_number() OVER (ORDER BY meter_id) - 1 AS k FROM (SELECT DISTINCT meter_id FROM readings)) USING (meter_id)""")
def p27_ordinal_ids(spark, sf_dir):
    return ops.ordinal_ids(readings(spark, sf_dir), "meter_id", "meter", "smartmeter_").select("row_id", "meter")


@query("""SELECT o_orderkey, make_timestamp(2015, month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), 0) AS ts FROM orders
WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def p29_without_leap_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("minute", "o_orderdate").cast("timestamp_ntz").alias("ts"))
    return ops.without_leap_day(rows, "ts", 2015)


@query(with_tables("days") + """
SELECT date, day(date) AS day_of_month, month(date) AS month, year(date) AS year, isodow(date) - 1 AS day_of_week, isodow(date) >= 6 AS is_weekend,
  dayofyear(date) AS day_of_year, weekofyear(date) AS iso_week, CAST(strftime(date, '%W') AS INT) AS monday_week,
  CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'spring' WHEN month(date) BETWEEN 6 AND 8 THEN 'summer' WHEN month(date) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season,
  CASE WHEN month(date) * 100 + day(date) BETWEEN 321 AND 620 THEN 'spring' WHEN month(date) * 100 + day(date) BETWEEN 621 AND 922 THEN 'summer'
    WHEN month(date) * 100 + day(date) BETWEEN 923 AND 1220 THEN 'autumn' ELSE 'winter' END AS fixed_season
FROM days""")
def f1_calendar(spark, sf_dir):
    d = F.col("date")
    return days(spark, sf_dir).select("date", *[v.alias(k) for k, v in cal.calendar(d).items()], cal.monday_week(d).alias("monday_week"), cal.meteorological_season(d).alias("season"), cal.astronomical_season(d).alias("fixed_season"))


@query(with_tables("days") + """,
easter(y, e) AS (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15'))
SELECT date, month(date) * 100 + day(date) IN (101, 501, 721, 815, 1101, 1111, 1225) OR date - e IN (0, 1, 39, 49, 50) AS is_holiday,
  CASE WHEN month(date) * 100 + day(date) IN (101, 501, 721, 815, 1101, 1111, 1225) OR date - e IN (0, 1, 39, 49, 50) THEN 'holiday' WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
FROM days JOIN easter ON year(date) = y""")
def f4_holidays_and_day_type(spark, sf_dir):
    return days(spark, sf_dir).select("date", cal.belgian_holiday(F.col("date")).alias("is_holiday"), cal.day_type(F.col("date")).alias("day_type"))


@query(with_tables("readings") + """
SELECT row_id, CAST(ts AS DATE) AS date, CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS INT) AS slot, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS time FROM readings""")
def f7_date_and_slot(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return readings(spark, sf_dir).select("row_id", F.to_date("ts").alias("date"), cal.slot_of(F.col("ts")).alias("slot"), F.concat(two(F.hour("ts")), F.lit(":"), two(F.minute("ts"))).alias("time"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(u*u + v*v), 6) AS speed, round(0.5 * pow(sqrt(u*u + v*v), 3), 4) AS energy, round(degrees(atan2(u, v)), 6) AS direction
FROM (SELECT *, l_discount * 100 AS u, l_tax * 100 + 1 AS v FROM lineitem)""")
def f11_wind(spark, sf_dir):
    found = feat.wind(F.col("l_discount") * 100, F.col("l_tax") * 100 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, 4 if k == "energy" else 6).alias(k) for k, v in found.items()])


@query(with_tables("readings") + """
SELECT row_id, kind, CAST(kind = 'click' AS INT) AS kind_click, CAST(kind = 'view' AS INT) AS kind_view, dense_rank() OVER (ORDER BY kind) - 1 AS code FROM readings""")
def f14_one_hot_and_ordinal(spark, sf_dir):
    rows = feat.one_hot(readings(spark, sf_dir).select("row_id", "kind"), "kind", ["click", "view"])
    return feat.ordinal(rows, "kind", "code")


@query(with_tables("meters") + """,
fitted AS (SELECT avg(yearly) AS m, stddev_pop(yearly) AS s, min(yearly) AS a, max(yearly) AS b FROM meters WHERE segment <> 'BUILDING')
SELECT meter_id, round((yearly - m) / s, 6) AS standard, round((yearly - a) / (b - a), 6) AS ranged FROM meters, fitted""")
def f16_scaling(spark, sf_dir):
    rows = meters(spark, sf_dir).select("meter_id", "segment", F.col("yearly").alias("standard"), F.col("yearly").alias("ranged"))
    train = rows.where("segment <> 'BUILDING'")
    out = feat.min_max(feat.standardise(rows, train, ["standard"]), train, ["ranged"])
    return out.select("meter_id", F.round("standard", 6).alias("standard"), F.round("ranged", 6).alias("ranged"))


@query(with_tables("readings") + """,
a AS (SELECT row_id, value / (SELECT max(value) + 1 FROM readings) AS y FROM readings), b AS (SELECT row_id, y, 1e-6 + (1 - 2e-6) * y AS z FROM a)
SELECT row_id, round(ln(z / (1 - z)), 6) AS logit, round((1 / (1 + exp(-y)) - 1e-6) / (1 - 2e-6), 6) AS sigmoid FROM b""")
def f21_logit(spark, sf_dir):
    top = readings(spark, sf_dir).agg((F.max("value") + 1).alias("top"))
    rows = readings(spark, sf_dir).join(F.broadcast(top)).select("row_id", (F.col("value") / F.col("top")).alias("y"))
    return rows.select("row_id", F.round(feat.logit(F.col("y")), 6).alias("logit"), F.round(feat.sigmoid(F.col("y")), 6).alias("sigmoid"))


@query("""WITH lse AS (SELECT c_nationkey, round(ln(sum(exp(c_acctbal / 1000))), 6) AS lse FROM customer GROUP BY 1) SELECT * FROM lse""")
def f22_log_sum_exp(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") / 1000).alias("x"))
    return rows.groupBy("c_nationkey").agg(F.round(feat.log_sum_exp("x"), 6).alias("lse"))


@query(with_tables("readings", "meters") + """,
day AS (SELECT meter_id, CAST(ts AS DATE) AS date, round(max(value), 3) AS max_consumption, round(min(value), 3) AS min_consumption, round(sum(value) + max(value) + min(value), 3) AS total_consumption FROM readings GROUP BY 1, 2)
SELECT meter_id, date, max_consumption, min_consumption, total_consumption, day(date) AS day_of_month, month(date) AS month, isodow(date) - 1 AS day_of_week, isodow(date) >= 6 AS is_weekend, dayofyear(date) AS day_of_year,
  CASE WHEN month(date) * 100 + day(date) BETWEEN 321 AND 620 THEN 'spring' WHEN month(date) * 100 + day(date) BETWEEN 621 AND 922 THEN 'summer'
    WHEN month(date) * 100 + day(date) BETWEEN 923 AND 1220 THEN 'autumn' ELSE 'winter' END AS season, yearly, CASE WHEN yearly = 0 THEN 0 ELSE 1 END AS pv
FROM day JOIN meters USING (meter_id)""")
def f24_daily_feature_rows(spark, sf_dir):
    """Daily peaks and total (which, as the source has it, counts both peaks again) with calendar and master attributes."""
    day = readings(spark, sf_dir).groupBy("meter_id", F.to_date("ts").alias("date")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("sum"))
    day = day.select("meter_id", "date", F.round("hi", 3).alias("max_consumption"), F.round("lo", 3).alias("min_consumption"), F.round(F.col("sum") + F.col("hi") + F.col("lo"), 3).alias("total_consumption"))
    d = {k: v for k, v in cal.calendar(F.col("date")).items() if k not in ("year", "iso_week")}
    master = meters(spark, sf_dir).select("meter_id", "yearly")
    return day.select("*", *[v.alias(k) for k, v in d.items()], cal.astronomical_season(F.col("date")).alias("season")).join(master, "meter_id").withColumn("pv", F.when(F.col("yearly") == 0, 0).otherwise(1))
