"""Queries on error rules, missing values and reconciliation of readings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadscape.operators import rules
from loadscape.operators import sequences as seq
from loadscape.plans.registry import query
from loadscape.plans.series import GAPS, HOURLY, hourly
from loadscape.sources.tables import meters, profiles, readings, slots, table, with_tables

_HOLES = "holes AS (SELECT profile_id, cluster, list_transform(vals, lambda x: CASE WHEN abs(x) > 0.3 THEN NULL WHEN abs(x) < 0.001 THEN 0 ELSE x END) AS vals FROM profiles)"


def _holes(spark, sf_dir):
    """Profiles with large values taken as missing and tiny ones as zero."""
    return profiles(spark, sf_dir).withColumn("vals", F.transform("vals", lambda x: F.when(F.abs(x) > 0.3, None).when(F.abs(x) < 0.001, 0.0).otherwise(x)))


@query(with_tables("profiles") + ", " + _HOLES + "SELECT profile_id FROM holes WHERE len(list_filter(vals, lambda x: x IS NULL)) = 0")
def p13_drop_incomplete(spark, sf_dir):
    return _holes(spark, sf_dir).where(~F.exists("vals", lambda x: x.isNull())).select("profile_id")


@query(with_tables("profiles") + ", " + _HOLES + "SELECT profile_id, round(list_sum(list_transform(vals, lambda x: coalesce(x, list_avg(vals)))), 6) AS total FROM holes")
def p15_fill_with_mean(spark, sf_dir):
    from loadscape.operators.distance import fill_mean

    return _holes(spark, sf_dir).select("profile_id", F.round(F.aggregate(fill_mean(F.col("vals")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(with_tables("profiles") + ", " + _HOLES + "SELECT profile_id, len(list_filter(vals, lambda x: x = 0)) > 0 AS has_zero, len(list_filter(vals, lambda x: x IS NULL)) > 0 AS has_null FROM holes")
def p25_problem_profiles(spark, sf_dir):
    v = F.col("vals")
    return _holes(spark, sf_dir).select("profile_id", F.coalesce(F.exists(v, lambda x: F.coalesce(x == 0, F.lit(False))), F.lit(False)).alias("has_zero"), F.exists(v, lambda x: x.isNull()).alias("has_null"))


@query(with_tables("profiles") + ", " + _HOLES + ", r AS (SELECT profile_id, len(list_filter(vals, lambda x: x IS NULL)) / 64.0 AS m FROM holes) SELECT round(avg(m), 9) AS missing, round(avg(CAST(m < 0.004 AS INT)), 9) AS nearly_complete FROM r")
def a20_missing_share(spark, sf_dir):
    m = F.size(F.filter("vals", lambda x: x.isNull())) / 64.0
    return _holes(spark, sf_dir).select(m.alias("m")).agg(F.round(F.avg("m"), 9).alias("missing"), F.round(F.avg((F.col("m") < 0.004).cast("int")), 9).alias("nearly_complete"))


@query(HOURLY + """,
b AS (SELECT meter_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM hourly GROUP BY 1),
n AS (SELECT r.meter_id, start, "end", x.value AS v0, y.value AS v1 FROM runs r LEFT JOIN hourly x ON x.meter_id = r.meter_id AND x.pos = "end" LEFT JOIN hourly y ON y.meter_id = r.meter_id AND y.pos = "end" + 1)
SELECT meter_id, start, "end", CASE WHEN v0 > 95 THEN true WHEN v0 < v1 THEN false WHEN v0 > q3 + 1.5 * greatest(q3 - q1, 0.25) OR v0 < q1 - 1.5 * greatest(q3 - q1, 0.25) THEN true END AS cumulative
FROM n JOIN b USING (meter_id)""")
def q6_cumulative_rules(spark, sf_dir):
    """Capacity first, then a rising second value clears, then the box plot convicts."""
    rows = hourly(spark, sf_dir)
    found = seq.runs_of_kinds(rows, ["meter_id"], "pos", "value", F.when(F.col("value").isNull(), 1))
    return rules.cumulative(rows, found, "meter_id", "pos", "value", capacity=95.0)


@query(GAPS + """
SELECT meter_id, start, "end", CASE WHEN "end" - start = 1 AND sign(before - 25) = -sign(after - 25) THEN false END AS sign_change, CASE WHEN abs(before) < 10 AND abs(after) < 10 THEN false END AS low_sides FROM gaps""")
def q8_zero_rules(spark, sf_dir):
    """A lone gap between opposite signs (around 25), and low values on both sides: both normal."""
    found = seq.runs_of_kinds(hourly(spark, sf_dir), ["meter_id"], "pos", "value", F.when(F.col("value").isNull(), 1))
    b, a = F.col("value_before"), F.col("value_after")
    return found.select("meter_id", "start", "end", rules.sign_change(F.col("end") - F.col("start"), b - 25, a - 25).alias("sign_change"), rules.low_sides(b, a, 10.0).alias("low_sides"))


@query(with_tables("readings", "meters") + "SELECT row_id, CASE WHEN value > abs(yearly) / 50 THEN NULL ELSE value END AS value FROM readings JOIN meters USING (meter_id)")
def q9_mask_power_peaks(spark, sf_dir):
    rows = readings(spark, sf_dir).join(meters(spark, sf_dir), "meter_id")
    return rows.select("row_id", F.when(~(F.col("value") > F.abs("yearly") / 50), F.col("value")).alias("value"))


@query(with_tables("readings") + "SELECT row_id, abs(value - avg(value) OVER (PARTITION BY meter_id)) > 1.96 * stddev_pop(value) OVER (PARTITION BY meter_id) AS outside FROM readings")
def q11_normal_interval(spark, sf_dir):
    return rules.outside_normal(readings(spark, sf_dir), "meter_id", "value", 1.96).select("row_id", "outside")


@query("SELECT o_orderkey, make_timestamp(2016, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 THEN least(day(o_orderdate), 28) ELSE day(o_orderdate) END, 0, 0, 0) AS ts FROM orders")
def q18_rebase_year(spark, sf_dir):
    d = F.col("o_orderdate")
    day = F.when(F.month(d) == 2, F.least(F.dayofmonth(d), F.lit(28))).otherwise(F.dayofmonth(d))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.make_timestamp_ntz(F.lit(2016), F.month(d), day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).alias("ts"))


@query("SELECT c_custkey, round(100 * (t - c_acctbal) / nullif(c_acctbal, 0), 4) AS off_by FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q19_reconcile_master(spark, sf_dir):
    measured = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    rows = table(spark, sf_dir, "customer").join(measured, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("c_custkey", F.round(100 * F.try_divide(F.col("t") - F.col("c_acctbal"), F.col("c_acctbal")), 4).alias("off_by"))


@query(with_tables("slots") + """, f AS (SELECT profile_id, slot, value < 0 AS z FROM slots),
r AS (SELECT profile_id, slot, z, bool_and(z) OVER (PARTITION BY profile_id ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND count(*) OVER (PARTITION BY profile_id ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AS three FROM f)
SELECT profile_id, bool_or(coalesce(three, false) AND NOT z) AS hit FROM r GROUP BY 1""")
def q24_run_then_break(spark, sf_dir):
    """Whether three flagged slots are followed at once by an unflagged one."""
    return rules.run_then_break(slots(spark, sf_dir), "profile_id", "slot", F.col("value") < 0, 3)


@query(HOURLY + """,
f AS (SELECT h.meter_id, r.start, r."end" - r.start AS gap, h.value, h.pos - r."end" AS k FROM runs r JOIN hourly h ON h.meter_id = r.meter_id AND h.pos >= r."end" AND h.pos < r."end" + 6)
SELECT meter_id, start, gap, max(value) FILTER (k = 0) AS v1, max(value) FILTER (k = 1) AS v2, round(avg(value) FILTER (k > 0), 4) AS mean, max(value) FILTER (k > 0) AS hi FROM f GROUP BY 1, 2, 3""")
def q25_features_after_gap(spark, sf_dir):
    """The first two values after a gap, and mean and maximum of the five after the first."""
    return rules.after_null_runs(hourly(spark, sf_dir), "meter_id", "pos", "value", 6)


@query(with_tables("slots") + ", p AS (SELECT profile_id, avg(value) AS x, max(value) AS y FROM slots GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p) SELECT round(corr(rx, ry), 9) AS rho FROM r")
def a23_spearman(spark, sf_dir):
    from loadscape.operators.statistics import spearman

    p = slots(spark, sf_dir).groupBy("profile_id").agg(F.avg("value").alias("x"), F.max("value").alias("y"))
    return spearman(p, "x", "y").select(F.round("rho", 9).alias("rho"))


@query("SELECT label AS truth, round(sum(CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE 0 END) / count(*), 9) AS p0, round(sum(CASE WHEN vec_id % 10 = 1 THEN 1.0 ELSE 0 END) / count(*), 9) AS p1 FROM embeddings GROUP BY 1")
def a24_confusion_matrix(spark, sf_dir):
    """Rows of true clusters, columns of predicted ones, as shares of the row."""
    from loadscape.operators.statistics import confusion

    rows = profiles(spark, sf_dir).select(F.col("cluster").alias("truth"), (F.col("profile_id") % 10).alias("guess"), F.lit(1.0).alias("p"))
    return confusion(rows, "truth", "guess", "p", list(range(10))).select("truth", F.round("0", 9).alias("p0"), F.round("1", 9).alias("p1"))


@query(with_tables("readings") + ", s AS (SELECT value AS x, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS y FROM readings), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r")
def g13_roc_auc(spark, sf_dir):
    from loadscape.operators.statistics import roc_auc

    rows = readings(spark, sf_dir).select("value", (F.col("kind") == "purchase").cast("int").alias("y"))
    return roc_auc(rows, "value", "y").select(F.round("auc", 9).alias("auc"))


@query(with_tables("readings") + ", s AS (SELECT greatest(least(value / 100, 0.999), 0.001) AS p, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS y FROM readings) SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 9) AS accuracy, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 9) AS log_loss FROM s")
def g15_classification_scores(spark, sf_dir):
    p = F.greatest(F.least(F.col("value") / 100, F.lit(0.999)), F.lit(0.001))
    rows = readings(spark, sf_dir).select(p.alias("p"), (F.col("kind") == "purchase").cast("int").alias("y"))
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")
    loss = -(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))
    return rows.agg(F.round(F.avg(hit), 9).alias("accuracy"), F.round(F.avg(loss), 9).alias("log_loss"))


_CURVE = with_tables("readings") + """, c AS (SELECT value AS threshold, count(*) FILTER (kind = 'purchase') AS positives, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT threshold, positives, sum(positives) OVER w AS hit, sum(n) OVER w AS taken, sum(positives) OVER () AS p, sum(n) OVER () AS t FROM c WINDOW w AS (ORDER BY threshold DESC))"""


@query(_CURVE + "SELECT threshold, positives, round(hit / taken, 9) AS precision, round(hit / p, 9) AS recall, round((taken - hit - 0.0) / (t - p), 9) AS fall_out FROM r")
def g13_threshold_curve(spark, sf_dir):
    """Precision, recall and fall-out at every value of the readings, purchases being the positives."""
    from loadscape.operators.statistics import threshold_curve

    rows = readings(spark, sf_dir).select("value", (F.col("kind") == "purchase").cast("int").alias("y"))
    return threshold_curve(rows, "value", "y").select("threshold", "positives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fall_out")])


@query(_CURVE + "SELECT round(sum(positives * hit / taken) / max(p), 9) AS average_precision FROM r")
def g13_average_precision(spark, sf_dir):
    from loadscape.operators.statistics import average_precision

    rows = readings(spark, sf_dir).select("value", (F.col("kind") == "purchase").cast("int").alias("y"))
    return average_precision(rows, "value", "y").select(F.round("average_precision", 9).alias("average_precision"))


@query(with_tables("slots") + """, c AS (SELECT cluster AS cls, slot, avg(value) AS m FROM slots GROUP BY 1, 2), d AS (SELECT profile_id, cluster AS truth, cls, exp(-10 * sqrt(sum((value - m) * (value - m)))) AS e FROM slots JOIN c USING (slot) GROUP BY 1, 2, 3),
s AS (SELECT profile_id, truth, cls, round(e / sum(e) OVER (PARTITION BY profile_id), 9) AS p FROM d),
g AS (SELECT profile_id, truth, arg_max(cls, (p, -cls)) AS guess, max(p) FILTER (cls = truth) AS own FROM s GROUP BY 1, 2), b AS (SELECT truth, avg(CASE WHEN guess = truth THEN 1.0 ELSE 0 END) AS r FROM g GROUP BY 1),
u AS (SELECT x.cls, y.truth AS other, sum(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) AS s, count(*) AS n FROM s x JOIN s y ON x.cls = x.truth AND y.cls = x.cls AND y.truth <> x.cls GROUP BY 1, 2), a AS (SELECT cls, sum(s) / sum(n) AS ovr FROM u GROUP BY 1)
SELECT (SELECT round(avg(CASE WHEN guess = truth THEN 1.0 ELSE 0 END), 6) FROM g) AS accuracy, (SELECT round(avg(r), 6) FROM b) AS balanced_accuracy, (SELECT round(avg(-ln(greatest(own, 1e-15))), 6) FROM g) AS log_loss, (SELECT round(avg(ovr), 6) FROM a) AS auc_ovr, (SELECT round(avg(s / n), 6) FROM u) AS auc_ovo""")
def g15_classifier_inspection(spark, sf_dir):
    """Clusters given to profiles by how near their centres are, and how well those chances tell the clusters apart."""
    from loadscape.operators.statistics import inspection

    s = slots(spark, sf_dir)
    centres = s.groupBy(F.col("cluster").alias("cls"), "slot").agg(F.avg("value").alias("m"))
    gap = F.col("value") - F.col("m")
    d = s.join(F.broadcast(centres), "slot").groupBy("profile_id", F.col("cluster").alias("truth"), "cls").agg(F.exp(-10 * F.sqrt(F.sum(gap * gap))).alias("e"))
    scores = d.withColumn("p", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("profile_id")), 9)).drop("e")
    classes = sorted(r[0] for r in s.select("cluster").where("cluster is not null").distinct().collect())
    return inspection(scores, "profile_id", classes).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "log_loss", "auc_ovr", "auc_ovo")])


@query(with_tables("readings") + ", d AS (SELECT meter_id, kind, round(sum(value), 4) AS v FROM readings GROUP BY 1, 2), r AS (SELECT kind, row_number() OVER (PARTITION BY meter_id ORDER BY v DESC, kind) AS place FROM d), c AS (SELECT kind, place, count(*) AS n FROM r GROUP BY 1, 2) SELECT kind, place, n, CAST(sum(n) OVER (PARTITION BY kind ORDER BY place) AS BIGINT) AS up_to FROM c")
def w10_rank_histogram(spark, sf_dir):
    """How often each kind comes first, second, ... among a meter's totals, and cumulated."""
    d = readings(spark, sf_dir).groupBy("meter_id", "kind").agg(F.round(F.sum("value"), 4).alias("v"))
    r = d.withColumn("place", F.row_number().over(Window.partitionBy("meter_id").orderBy(F.desc("v"), "kind")))
    return r.groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n")).withColumn("up_to", F.sum("n").over(Window.partitionBy("kind").orderBy("place")))


@query(with_tables("slots") + """, w AS (SELECT k, exp(-k * k / 8.0) AS w FROM (SELECT unnest(range(-8, 9)) AS k))
SELECT a.profile_id, a.slot, round(sum(b.value * w.w) / sum(w.w), 6) AS smooth FROM slots a JOIN w ON true JOIN slots b ON b.profile_id = a.profile_id AND b.slot = a.slot + w.k GROUP BY 1, 2""")
def w17_gaussian_smoothing(spark, sf_dir):
    """Gaussian weights of deviation 2 within four deviations, renormalised at the ends."""
    from loadscape.operators.statistics import smooth

    out = smooth(profiles(spark, sf_dir), "vals", 2.0)
    return out.select("profile_id", F.posexplode("smooth").alias("slot", "v")).select("profile_id", "slot", F.round("v", 6).alias("smooth"))


@query(with_tables("slots") + "SELECT profile_id, 'slot_' || CAST(slot AS VARCHAR) AS name, value FROM slots WHERE slot < 4")
def o16_melt(spark, sf_dir):
    wide = profiles(spark, sf_dir).select("profile_id", *[F.col("vals")[i].alias(f"slot_{i}") for i in range(4)])
    return wide.unpivot("profile_id", [f"slot_{i}" for i in range(4)], "name", "value")


@query("SELECT isodow(o_orderdate) - 1 AS dow, CAST(floor((dayofyear(o_orderdate) + 6 - (isodow(o_orderdate) - 1)) / 7) AS INT) AS week, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2, 3")
def o15_weekly_table(spark, sf_dir):
    from loadscape.functions.calendar import monday_week

    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.weekday(d).alias("dow"), monday_week(d).alias("week"), F.year(d).alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(HOURLY + """,
judged AS (SELECT meter_id, start, "end", "end" - start AS n, count(*) OVER (PARTITION BY start) AS same FROM runs)
SELECT n AS interval_length, count(*) AS intervals, count(*) FILTER (same >= 5) AS shared FROM judged GROUP BY 1""")
def a14_shared_starts(spark, sf_dir):
    found = seq.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())
    starts = found.groupBy("start").agg(F.count(F.lit(1)).alias("same"))
    return found.join(starts, "start").groupBy((F.col("end") - F.col("start")).alias("interval_length")).agg(F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("same") >= 5).alias("shared"))


