"""Queries on window and sequence operators, time resampling and interval tables.

Before a result with many exact halves is rounded, 1e-9 is added, so that it rounds alike everywhere.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.operators import cleaning, intervals
from loadscape.operators import sequences as ops
from loadscape.plans.registry import query
from loadscape.sources.tables import profiles, readings, slots, table, with_tables

START, END, HOURS = "2024-01-01 00:00:00", "2024-01-30 23:00:00", 720


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meter_id, pos, value): every meter and hour of the period START to END, NULL where nothing was read.

    The tables' readings all lie in that period (tests/test_whole_plans.py); others would not be in the grid.
    """
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = readings(spark, sf_dir).groupBy("meter_id", hour.alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    grid = cleaning.complete_grid(rows, "meter_id", "ts", START, END, "1 HOUR")
    return grid.select("meter_id", F.timestamp_diff("HOUR", F.lit(START).cast("timestamp_ntz"), F.col("ts")).cast("int").alias("pos"), "value")


HOURLY = with_tables("readings") + """,
read AS (SELECT meter_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS INT) AS pos, round(sum(value), 4) AS value FROM readings GROUP BY 1, 2),
hourly AS (SELECT m.meter_id, CAST(h.pos AS INT) AS pos, value FROM (SELECT DISTINCT meter_id FROM readings) m CROSS JOIN (SELECT unnest(range(720)) AS pos) h LEFT JOIN read USING (meter_id, pos)),
flagged AS (SELECT *, value IS NULL AS f FROM hourly),
runs AS (SELECT meter_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY meter_id ORDER BY pos) AS g FROM flagged WHERE f) GROUP BY meter_id, g)
"""


#: NULL runs with the values around them; 1e300 stands for none where the last value of a run is picked.
GAPS = HOURLY + """, around AS (SELECT meter_id, pos, value, coalesce(lag(value) OVER w, 1e300) AS before, coalesce(lead(value) OVER w, 1e300) AS after, coalesce(lead(value, 2) OVER w, 1e300) AS second FROM hourly WINDOW w AS (PARTITION BY meter_id ORDER BY pos)),
unread AS (SELECT *, pos - row_number() OVER (PARTITION BY meter_id ORDER BY pos) AS g FROM around WHERE value IS NULL),
gaps AS (SELECT meter_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end", nullif(arg_min(before, pos), 1e300) AS before, nullif(arg_max(after, pos), 1e300) AS after, nullif(arg_max(second, pos), 1e300) AS second FROM unread GROUP BY meter_id, g)
"""


@query(HOURLY + "SELECT * FROM hourly")
def j2_grid_completion(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(HOURLY + "SELECT * FROM runs")
def w1_null_runs(spark, sf_dir):
    return ops.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())


@query(HOURLY + """,
all_runs AS (SELECT *, CAST(NULL AS DOUBLE) AS interval_value FROM runs UNION ALL
  SELECT meter_id, CAST(min(pos) AS INT), CAST(max(pos) + 1 AS INT), 0.0 FROM (SELECT *, pos - row_number() OVER (PARTITION BY meter_id ORDER BY pos) AS g FROM hourly WHERE value <= 20) GROUP BY meter_id, g)
SELECT meter_id, start, "end", interval_value, CAST("end" - start AS INT) AS interval_length, a.value AS value_before, start = 0 AS at_start, b.value AS value_after, c.value AS second_after, "end" = 720 AS at_end
FROM all_runs r LEFT JOIN (SELECT meter_id AS m1, pos AS p1, value FROM hourly) a ON m1 = meter_id AND p1 = start - 1
LEFT JOIN (SELECT meter_id AS m2, pos AS p2, value FROM hourly) b ON m2 = meter_id AND p2 = "end" LEFT JOIN (SELECT meter_id AS m3, pos AS p3, value FROM hourly) c ON m3 = meter_id AND p3 = "end" + 1""")
def q1_interval_table(spark, sf_dir):
    """NULL runs and low runs (20 or less, the stand-in for zero) with their neighbours."""
    return intervals.interval_table(hourly(spark, sf_dir), ["meter_id"], "pos", "value", F.col("value") <= 20)


@query(HOURLY + """SELECT meter_id, pos, lag(value, 10) OVER (PARTITION BY meter_id ORDER BY pos) AS shifted, value - lag(value) OVER (PARTITION BY meter_id ORDER BY pos) AS diff,
  last_value(value IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM hourly""")
def w5_shift_difference_fill(spark, sf_dir):
    rows = ops.shift(hourly(spark, sf_dir), ["meter_id"], "pos", "value", 10, "shifted")
    rows = ops.difference(rows, ["meter_id"], "pos", "value", "diff")
    return ops.forward_fill(rows, ["meter_id"], "pos", "value", "filled").drop("value")


@query(with_tables("slots") + "SELECT profile_id, slot, greatest(value - lag(value, 1, 0.0) OVER (PARTITION BY profile_id ORDER BY slot), 0.0) AS step FROM slots")
def w6_deaccumulate(spark, sf_dir):
    return ops.deaccumulate(slots(spark, sf_dir), ["profile_id"], "slot", "value", "step").select("profile_id", "slot", "step")


@query(with_tables("readings") + """
SELECT row_id, round(sum(value) OVER (PARTITION BY meter_id ORDER BY value DESC, row_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY meter_id), 6) AS share FROM readings""")
def w7_load_duration(spark, sf_dir):
    return ops.load_duration(readings(spark, sf_dir), ["meter_id"], "value", "row_id", "share").select("row_id", F.round("share", 6).alias("share"))


@query(with_tables("slots") + """
SELECT rank, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY value DESC, slot) AS rank FROM slots) GROUP BY rank""")
def w8_mean_load_curve(spark, sf_dir):
    return ops.mean_by_rank(slots(spark, sf_dir), ["profile_id"], "value", "slot").select("rank", F.round("mean", 6).alias("mean"))


@query(with_tables("readings") + """
SELECT row_id, rank() OVER (PARTITION BY meter_id ORDER BY kind) + (count(*) OVER (PARTITION BY meter_id, kind) - 1) / 2 AS r FROM readings""")
def w9_average_rank(spark, sf_dir):
    return readings(spark, sf_dir).select("row_id", ops.average_rank(["meter_id"], F.col("kind")).alias("r"))


@query(with_tables("readings") + """
SELECT row_id FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY row_id) QUALIFY kind = 'view' AND lead(kind) OVER w = 'click' AND lead(kind, 2) OVER w = 'view'""")
def w11_pattern_search(spark, sf_dir):
    return ops.find_pattern(readings(spark, sf_dir), ["meter_id"], "row_id", "kind", ["view", "click", "view"]).select("row_id")


@query(HOURLY + """,
sides AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1,
  last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER a AS v1 FROM hourly
  WINDOW b AS (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT meter_id, pos, round(coalesce(value, v0 + (v1 - v0) * (pos - p0) / (p1 - p0)) + 1e-9, 6) AS filled FROM sides""")
def w12_interpolate(spark, sf_dir):
    return ops.interpolate(hourly(spark, sf_dir), ["meter_id"], "pos", "value", "filled").select("meter_id", "pos", F.round(F.col("filled") + 1e-9, 6).alias("filled"))


@query(HOURLY + """,
known AS (SELECT meter_id, pos, value, lag(pos) OVER w AS pb, lag(value) OVER w AS vb, lead(pos) OVER w AS pa, lead(value) OVER w AS va FROM hourly WHERE value IS NOT NULL WINDOW w AS (PARTITION BY meter_id ORDER BY pos)),
sides AS (SELECT h.meter_id, h.pos, h.value, b.pb AS p1, b.vb AS v1, b.pos AS p2, b.value AS v2, a.pos AS p3, a.value AS v3, a.pa AS p4, a.va AS v4 FROM hourly h ASOF LEFT JOIN known b ON b.meter_id = h.meter_id AND b.pos <= h.pos ASOF LEFT JOIN known a ON a.meter_id = h.meter_id AND a.pos >= h.pos),
points AS (SELECT meter_id, pos, p, v FROM sides, LATERAL (SELECT unnest([p1, p2, p3, p4]) AS p, unnest([v1, v2, v3, v4]) AS v) WHERE value IS NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND p IS NOT NULL),
shares AS (SELECT x.meter_id, x.pos, x.p, any_value(x.v) * product((x.pos - y.p) / CAST(x.p - y.p AS DOUBLE)) AS s FROM points x JOIN points y ON x.meter_id = y.meter_id AND x.pos = y.pos AND x.p <> y.p GROUP BY 1, 2, 3),
curve AS (SELECT meter_id, pos, sum(s) AS c FROM shares GROUP BY 1, 2)
SELECT meter_id, pos, round(coalesce(value, c) + 1e-9, 5) AS filled FROM hourly LEFT JOIN curve USING (meter_id, pos)""")
def w12_cubic(spark, sf_dir):
    """Missing hours on the cubic through the two readings before and the two after."""
    return ops.interpolate_cubic(hourly(spark, sf_dir), ["meter_id"], "pos", "value", "filled").select("meter_id", "pos", F.round(F.col("filled") + 1e-9, 5).alias("filled"))


@query(HOURLY + """,
near AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS x, first_value(value IGNORE NULLS) OVER a AS y FROM (SELECT *, pos % 24 AS phase, pos // 24 AS day FROM hourly)
  WINDOW b AS (PARTITION BY meter_id, phase ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY meter_id, phase ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT meter_id, pos, round(coalesce(value, (x + y) / 2, x, y), 6) AS filled FROM near""")
def w13_seasonal_fill(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumns({"phase": F.col("pos") % 24, "day": F.floor(F.col("pos") / 24)})
    return ops.seasonal_fill(rows, ["meter_id"], "phase", "day", "value", "filled").select("meter_id", "pos", F.round("filled", 6).alias("filled"))


@query(HOURLY + """
SELECT meter_id, pos, round(coalesce(value, avg(value) OVER (PARTITION BY meter_id, pos % 24 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(value) OVER (PARTITION BY meter_id, pos % 24)), 5) AS filled FROM hourly""")
def w14_seasonal_mean_fill(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("phase", F.col("pos") % 24)
    return ops.seasonal_mean_fill(rows, ["meter_id"], "phase", "pos", "value", "filled").select("meter_id", "pos", F.round("filled", 5).alias("filled"))


@query(with_tables("slots") + """,
c AS (SELECT profile_id, slot, value - avg(value) OVER (PARTITION BY profile_id) AS d FROM slots)
SELECT a.profile_id, CAST(l.lag AS INT) AS lag, round(sum(a.d * b.d) / any_value(s.s), 6) AS acf FROM c a JOIN (SELECT unnest(range(1, 11)) AS lag) l ON true
JOIN c b ON b.profile_id = a.profile_id AND b.slot = a.slot + l.lag JOIN (SELECT profile_id, sum(d * d) AS s FROM c GROUP BY 1) s ON s.profile_id = a.profile_id GROUP BY 1, 2""")
def w16_autocorrelation(spark, sf_dir):
    return ops.autocorrelation(slots(spark, sf_dir), "profile_id", "slot", "value", 10).select("profile_id", "lag", F.round("acf", 6).alias("acf"))


@query(with_tables("readings") + """
SELECT row_id, round(avg(value) OVER (PARTITION BY meter_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) + 1e-9, 5) AS mean FROM readings""")
def w18_running_average(spark, sf_dir):
    return ops.moving_average(readings(spark, sf_dir), ["meter_id"], "row_id", "value", "mean").select("row_id", F.round(F.col("mean") + 1e-9, 5).alias("mean"))


@query(with_tables("profiles") + "SELECT profile_id, round(list_reduce(vals, lambda a, x: a * 0.9::DOUBLE + x * (1 - 0.9::DOUBLE)), 9) AS state FROM profiles")
def w18_exponential_state(spark, sf_dir):
    """The exponential moving average of each profile after its last slot."""
    return profiles(spark, sf_dir).select("profile_id", F.round(ops.ema(F.col("vals"), 0.9), 9).alias("state"))


@query(with_tables("slots") + """
SELECT profile_id, slot, value FROM slots WINDOW w AS (PARTITION BY profile_id ORDER BY slot) QUALIFY value > lag(value) OVER w AND value > lead(value) OVER w""")
def q26_strict_peaks(spark, sf_dir):
    return ops.strict_peaks(slots(spark, sf_dir), ["profile_id"], "slot", "value").select("profile_id", "slot", "value")


@query(with_tables("readings") + """
SELECT meter_id, date_trunc('day', ts) AS day, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, count(*) AS n FROM readings GROUP BY 1, 2""")
def a4_daily_resample(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("meter_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def a5_month_and_week_resample(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.last_day(d).alias("month_end"), F.date_add(F.to_date(F.date_trunc("week", d)), 6).alias("week_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(HOURLY + """,
mask AS (SELECT meter_id, start, "end" FROM runs WHERE "end" - start >= 6)
SELECT h.meter_id, h.pos, CASE WHEN bool_or(m.start IS NOT NULL) THEN NULL ELSE any_value(h.value) END AS value FROM hourly h LEFT JOIN mask m ON m.meter_id = h.meter_id AND h.pos BETWEEN m.start AND m."end" GROUP BY 1, 2""")
def q7_mask_intervals(spark, sf_dir):
    """Long runs are masked to NULL, the value after each included."""
    rows = hourly(spark, sf_dir)
    return intervals.mask_long_runs(rows, ["meter_id"], "pos", "value", F.col("value").isNull(), 6)


@query(with_tables("readings") + """,
b AS (SELECT meter_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY 1)
SELECT row_id, value < q1 - 1.5 * greatest(q3 - q1, 0.25) OR value > q3 + 1.5 * greatest(q3 - q1, 0.25) AS is_peak FROM readings JOIN b USING (meter_id)""")
def q5_boxplot_peaks(spark, sf_dir):
    return intervals.boxplot_peaks(readings(spark, sf_dir), "meter_id", "value").select("row_id", "is_peak")


@query(with_tables("readings", "meters") + """
SELECT row_id, coalesce(value > conn, false) OR coalesce(value < -conn, false) OR coalesce(value < -pv, false) AS over
FROM (SELECT r.*, nullif(yearly, 0) / 40 AS conn, CASE WHEN location_id % 2 = 0 THEN yearly / 80 END AS pv FROM readings r JOIN meters USING (meter_id))""")
def q4_capacity_peaks(spark, sf_dir):
    from loadscape.sources.tables import meters

    rows = readings(spark, sf_dir).join(meters(spark, sf_dir), "meter_id")
    conn, pv = F.nullif(F.col("yearly"), F.lit(0.0)) / 40, F.when(F.col("location_id") % 2 == 0, F.col("yearly") / 80)
    return rows.select("row_id", intervals.over_capacity(F.col("value"), conn, pv).alias("over"))


@query(HOURLY + """,
sized AS (SELECT *, "end" - start AS n, count(*) OVER (PARTITION BY start) AS same FROM runs),
modal AS (SELECT start, n AS mode_n FROM (SELECT start, n, row_number() OVER (PARTITION BY start ORDER BY count(*) DESC, n) AS k FROM sized GROUP BY start, n) WHERE k = 1)
SELECT meter_id, start, "end", same >= 5 AND abs(n - mode_n) <= 2 AS collective FROM sized JOIN modal USING (start)""")
def q10_collective_errors(spark, sf_dir):
    found = ops.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())
    return intervals.collective(found, least=5, within=2)


@query(HOURLY + """,
common AS (SELECT start AS s, "end" AS e FROM runs GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT meter_id, start, "end", EXISTS (SELECT 1 FROM common WHERE abs(start - s) + abs("end" - e) <= 2) AS disconnected FROM runs""")
def q23_disconnection_periods(spark, sf_dir):
    found = ops.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())
    return intervals.disconnected(found, ["meter_id"], least=2, within=2)


@query(with_tables("readings") + """,
flags AS (SELECT row_id, CASE WHEN value > 80 THEN true WHEN value < 5 THEN false END AS a, CASE WHEN kind = 'error' THEN true WHEN kind = 'signup' THEN false END AS b FROM readings)
SELECT row_id, CASE WHEN a = false OR b = false THEN false WHEN a OR b THEN true END AS error FROM flags""")
def q20_combine_detectors(spark, sf_dir):
    a = F.when(F.col("value") > 80, True).when(F.col("value") < 5, False)
    b = F.when(F.col("kind") == "error", True).when(F.col("kind") == "signup", False)
    return readings(spark, sf_dir).select("row_id", intervals.combine(a, b).alias("error"))


@query(with_tables("readings") + """
SELECT CASE WHEN value > 80 THEN true WHEN value < 5 THEN false END AS verdict, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM readings GROUP BY 1""")
def q21_detection_summary(spark, sf_dir):
    verdict = F.when(F.col("value") > 80, True).when(F.col("value") < 5, False)
    return intervals.summary(readings(spark, sf_dir).select(verdict.alias("verdict")), "verdict")


@query(with_tables("readings") + """,
dst(y, s, e) AS (VALUES (2024, TIMESTAMP '2024-01-10 02:00:00', TIMESTAMP '2024-01-20 02:00:00')),
moved AS (SELECT meter_id, CASE WHEN ts >= s AND ts < e THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END AS ts, value FROM readings LEFT JOIN dst ON year(ts) = y)
SELECT meter_id, ts, round(avg(value), 4) AS value FROM moved GROUP BY 1, 2""")
def q17_daylight_saving(spark, sf_dir):
    """Hours inside the period move forward; the hour that comes twice is averaged, the one that is skipped has no row."""
    rows = readings(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    periods = spark.createDataFrame([(2024, "2024-01-10 02:00:00", "2024-01-20 02:00:00")], "year int, start string, end string")
    return intervals.wall_clock(rows, periods, "meter_id", "ts", "value").select("meter_id", "ts", F.round("value", 4).alias("value"))
