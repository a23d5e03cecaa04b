"""Queries on scenario scores. A cluster is a day, its first profile the observation and the others the scenarios."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadscape.operators import scoring
from loadscape.operators.counted import quantiles
from loadscape.plans.registry import query
from loadscape.plans.series import HOURLY, hourly
from loadscape.sources.tables import profiles, readings, slots, table, with_tables


def _cases(spark, sf_dir):
    """(scenarios, observed): long rows."""
    first = profiles(spark, sf_dir).groupBy(F.col("cluster").alias("day")).agg(F.min("profile_id").alias("first"))
    rows = slots(spark, sf_dir).withColumnRenamed("cluster", "day").join(F.broadcast(first), "day")
    own = F.col("profile_id") == F.col("first")
    return rows.where(~own).select("day", "slot", F.col("profile_id").alias("s"), "value"), rows.where(own).select("day", "slot", F.col("value").alias("y"))


_CASES = with_tables("slots") + """, firsts AS (SELECT cluster AS day, min(profile_id) AS f FROM slots GROUP BY 1),
scen AS (SELECT day, slot, profile_id AS s, value FROM slots JOIN firsts ON cluster = day WHERE profile_id <> f), obs AS (SELECT day, slot, value AS y FROM slots JOIN firsts ON cluster = day WHERE profile_id = f)"""


@query(_CASES + """, n AS (SELECT day, count(DISTINCT s) AS n FROM scen GROUP BY 1),
a AS (SELECT day, sum(d) AS a FROM (SELECT day, s, sqrt(sum((value - y) * (value - y))) AS d FROM scen JOIN obs USING (day, slot) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT day, sum(d) AS b FROM (SELECT x.day, x.s, z.s, sqrt(sum((x.value - z.value) * (x.value - z.value))) AS d FROM scen x JOIN scen z ON x.day = z.day AND x.slot = z.slot AND x.s < z.s GROUP BY 1, 2, 3) GROUP BY 1)
SELECT day AS test_id, round(a / n - b / (n * n), 6) AS es FROM a JOIN b USING (day) JOIN n USING (day)""")
def g1_energy_score(spark, sf_dir):
    p = profiles(spark, sf_dir)
    first = F.broadcast(p.groupBy("cluster").agg(F.min("profile_id").alias("first"), (F.count(F.lit(1)) - 1).alias("n")))
    rows = p.join(first, "cluster")
    samples = rows.where("profile_id <> first").select(F.col("cluster").alias("test_id"), F.col("profile_id").alias("s"), (1 / F.col("n").cast("double")).alias("p"), "vals")
    observed = rows.where("profile_id = first").select(F.col("cluster").alias("test_id"), F.col("vals").alias("y"))
    return scoring.energy_score(samples, observed).select("test_id", F.round("es", 6).alias("es"))


@query(_CASES + """, fs AS (SELECT day, s, slot // 4 AS k, sum(value) AS v FROM scen GROUP BY 1, 2, 3), fo AS (SELECT day, slot // 4 AS k, sum(y) AS y FROM obs GROUP BY 1, 2),
m AS (SELECT a.day, a.k AS k1, b.k AS k2, avg(sqrt(abs(a.v - b.v))) AS m FROM fs a JOIN fs b USING (day, s) GROUP BY 1, 2, 3)
SELECT m.day, round(sum(pow(sqrt(abs(p.y - q.y)) - m, 2)), 5) AS vs FROM m JOIN fo p ON p.day = m.day AND p.k = k1 JOIN fo q ON q.day = m.day AND q.k = k2 GROUP BY 1""")
def g4_variogram_score(spark, sf_dir):
    """Over profiles folded to 16 slots."""
    s, o = _cases(spark, sf_dir)
    k = F.floor(F.col("slot") / 4).cast("int").alias("slot")
    return scoring.variogram_score(s.groupBy("day", "s", k).agg(F.sum("value").alias("value")), o.groupBy("day", k).agg(F.sum("y").alias("y"))).select("day", F.round("vs", 5).alias("vs"))


@query(_CASES + """, near AS (SELECT day, slot, avg(abs(value - y)) AS a FROM scen JOIN obs USING (day, slot) GROUP BY 1, 2), far AS (SELECT a.day, a.slot, avg(abs(a.value - b.value)) / 2 AS b FROM scen a JOIN scen b ON a.day = b.day AND a.slot = b.slot GROUP BY 1, 2)
SELECT day, slot, round(a - b, 6) AS crps FROM near JOIN far USING (day, slot)""")
def g5_crps(spark, sf_dir):
    return scoring.crps(*_cases(spark, sf_dir)).select("day", "slot", F.round("crps", 6).alias("crps"))


_LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]
_QUANTILES = _CASES + """, lv(q) AS (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)), qs AS (SELECT day, slot, unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS q, unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM scen GROUP BY 1, 2)"""


@query(_QUANTILES + "SELECT q, round(100 * avg(CASE WHEN y >= v THEN q * (y - v) ELSE (q - 1) * (y - v) END), 6) AS loss FROM qs JOIN obs USING (day, slot) GROUP BY 1")
def g6_pinball(spark, sf_dir):
    s, o = _cases(spark, sf_dir)
    return scoring.pinball(scoring.quantiles(s, _LEVELS), o).select("q", F.round("loss", 6).alias("loss"))


@query(_QUANTILES + "SELECT q, round(100 * avg(CASE WHEN y < v THEN 1.0 ELSE 0.0 END), 6) AS share FROM qs JOIN obs USING (day, slot) GROUP BY 1")
def g7_reliability(spark, sf_dir):
    s, o = _cases(spark, sf_dir)
    return scoring.reliability(scoring.quantiles(s, _LEVELS), o).select("q", F.round("share", 6).alias("share"))


@query(with_tables("readings") + """, l AS (SELECT meter_id, abs(value - 50) AS a, abs(value - 45) AS b FROM readings), d AS (SELECT meter_id, avg(a - b) AS m, count(*) AS n, var_pop(a - b) AS v FROM l GROUP BY 1)
SELECT meter_id, round(m, 6) AS mean_d, n, CASE WHEN v > 0 THEN round(m / sqrt(v / n), 6) END AS statistic FROM d""")
def g8_diebold_mariano(spark, sf_dir):
    losses = readings(spark, sf_dir).select("meter_id", F.abs(F.col("value") - 50).alias("a"), F.abs(F.col("value") - 45).alias("b"))
    return scoring.diebold_mariano(losses, "a", "b", "meter_id").select("meter_id", F.round("mean_d", 6).alias("mean_d"), "n", F.round("statistic", 6).alias("statistic"))


def _tail_sql(z: str) -> str:
    """1 - normal CDF of a column in SQL."""
    polynomial = lambda cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * abs({z}) + {c!r})" for c in cs[1:])
    far = f"(abs({z}) + 1 / (abs({z}) + 2 / (abs({z}) + 3 / (abs({z}) + 4 / (abs({z}) + 0.65::DOUBLE)))))"
    density = f"exp(-{z} * {z} / 2)"
    tail = f"CASE WHEN abs({z}) < 7.07106781186547 THEN {density} * {polynomial(scoring.HART_TOP)} / {polynomial(scoring.HART_BOTTOM)} ELSE {density} / {far} / sqrt(2 * pi()) END"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


_MODELS = ["hour", "day", "level"]
_LOSSES = HOURLY + """, lagged AS (SELECT meter_id, pos, value, lag(value) OVER w AS h, lag(value, 24) OVER w AS d, avg(value) OVER (PARTITION BY meter_id) AS l FROM hourly WINDOW w AS (PARTITION BY meter_id ORDER BY pos)),
losses AS (SELECT meter_id, pos, abs(value - h) AS hour, abs(value - d) AS day, abs(value - l) AS level FROM lagged WHERE value IS NOT NULL),
pairs(a, b) AS (VALUES ('hour', 'day'), ('hour', 'level'), ('day', 'hour'), ('day', 'level'), ('level', 'hour'), ('level', 'day'))"""
_TEST = """, d AS (SELECT a, b, CASE a WHEN 'hour' THEN hour WHEN 'day' THEN day ELSE level END - CASE b WHEN 'hour' THEN hour WHEN 'day' THEN day ELSE level END AS d FROM cases, pairs),
z AS (SELECT a, b, avg(d) AS m, count(d) AS n, avg(d) / sqrt(var_pop(d) / count(d)) AS z FROM d GROUP BY 1, 2)
SELECT a, b, round(m, 6) AS mean_d, n, round(z, 5) AS statistic, round(""" + _tail_sql("z") + """, 7) AS p FROM z"""


def _losses(spark, sf_dir):
    """(meter_id, pos, hour, day, level): how far the value of the hour or day before, or the mean, is from each reading."""
    w = Window.partitionBy("meter_id").orderBy("pos")
    mean = F.avg("value").over(Window.partitionBy("meter_id"))
    rows = hourly(spark, sf_dir).withColumns({"hour": F.lag("value").over(w), "day": F.lag("value", 24).over(w), "level": mean}).where("value is not null")
    return rows.select("meter_id", "pos", *[F.abs(F.col("value") - F.col(m)).alias(m) for m in _MODELS])


def _tested(losses):
    return scoring.diebold_mariano_pairs(losses, _MODELS).select("a", "b", F.round("mean_d", 6).alias("mean_d"), "n", F.round("statistic", 5).alias("statistic"), F.round("p", 7).alias("p"))


@query(_LOSSES + ", cases AS (SELECT * FROM losses)" + _TEST)
def g8_model_pairs(spark, sf_dir):
    """Every two of three simple forecasts, tested hour by hour over all meters."""
    return _tested(_losses(spark, sf_dir))


@query(_LOSSES + ", cases AS (SELECT meter_id, pos // 24 AS on_day, avg(hour) AS hour, avg(day) AS day, avg(level) AS level FROM losses GROUP BY 1, 2)" + _TEST)
def g8_model_pairs_of_days(spark, sf_dir):
    """The same forecasts, tested by the mean loss of each meter's days."""
    losses = _losses(spark, sf_dir).withColumn("on_day", F.floor(F.col("pos") / 24))
    return _tested(scoring.losses_of_cases(losses, ["meter_id", "on_day"], _MODELS))


@query(with_tables("profiles") + """, k AS (SELECT a.cluster AS x, b.cluster AS y, sum(exp(-list_sum(list_transform(list_zip(a.vals, b.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2)) AS t FROM profiles a, profiles b GROUP BY 1, 2),
n AS (SELECT cluster, count(*) AS n FROM profiles GROUP BY 1), own AS (SELECT x, t / (n * (n - 1)) AS own, n FROM k JOIN n ON cluster = x WHERE x = y)
SELECT k.x, k.y, round(a.own + b.own - 2 * t / (a.n * b.n), 9) AS mmd2 FROM k JOIN own a ON a.x = k.x JOIN own b ON b.x = k.y WHERE k.x < k.y""")
def g9_mmd(spark, sf_dir):
    """Between the profiles of every two clusters."""
    return scoring.mmd2_of_groups(profiles(spark, sf_dir), "cluster", "profile_id", "vals", 1.0).select("x", "y", F.round("mmd2", 9).alias("mmd2"))


@query(_CASES + "SELECT s, round(avg((value - y) * (value - y)), 6) AS mse, round(avg(abs(value - y)), 6) AS mae, round(sqrt(avg((value - y) * (value - y))), 6) AS rmse FROM scen JOIN obs USING (day, slot) GROUP BY 1")
def g10_errors(spark, sf_dir):
    s, o = _cases(spark, sf_dir)
    gap = F.col("value") - F.col("y")
    return s.join(o, ["day", "slot"]).groupBy("s").agg(F.round(F.avg(gap * gap), 6).alias("mse"), F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"))


@query(with_tables("readings") + """, b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM readings)
SELECT meter_id, round(avg(CASE WHEN value BETWEEN a AND b THEN 1.0 ELSE 0 END), 6) AS lower, round(avg(CASE WHEN value BETWEEN b AND c THEN 1.0 ELSE 0 END), 6) AS upper FROM readings, b GROUP BY 1""")
def g11_quantile_band_share(spark, sf_dir):
    """Share of each meter's readings in two quantile bands of all readings, both ends included."""
    r = readings(spark, sf_dir)
    q = quantiles(r, "value", [0.25, 0.5, 0.75]).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "value"))), lambda x: x["value"]).alias("q"))
    inside = lambda i: F.avg(F.col("value").between(F.col("q")[i], F.col("q")[i + 1]).cast("double"))
    return r.join(F.broadcast(q)).groupBy("meter_id").agg(F.round(inside(0), 6).alias("lower"), F.round(inside(1), 6).alias("upper"))


@query("""WITH d AS (SELECT c_nationkey, c_acctbal, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS u FROM customer) SELECT c_nationkey, c_acctbal, round(u, 9) AS u FROM d""")
def h2_empirical_cdf(spark, sf_dir):
    return scoring.empirical_cdf(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), "c_acctbal", ["c_nationkey"], "u").withColumn("u", F.round("u", 9))
