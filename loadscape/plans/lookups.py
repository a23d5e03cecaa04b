"""Queries on lookups, splits, masks, rule pipelines and evaluation reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadscape.operators import blocks, clustering, distance, intervals, matching, reshape, rules, samplers, scoring
from loadscape.operators import sequences as seq
from loadscape.plans.quality import _HOLES, _holes
from loadscape.plans.registry import query
from loadscape.plans.scores import _CASES, _cases
from loadscape.plans.series import GAPS, HOURLY, hourly
from loadscape.sources.tables import meters, profiles, readings, slots, table, with_tables


@query(HOURLY + ', m AS (SELECT c_custkey AS meter_id, c_acctbal / 4 AS power FROM customer) SELECT r.meter_id, start, "end", power FROM runs r LEFT JOIN m USING (meter_id)')
def j7_interval_attributes(spark, sf_dir):
    """Intervals with their meter's connection power over four."""
    found = seq.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())
    return found.join(meters(spark, sf_dir).select("meter_id", (F.col("yearly") / 4).alias("power")), "meter_id", "left")


@query("WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_quantity < 2 GROUP BY 1), b AS (SELECT l_linestatus AS k, count(*) AS m FROM lineitem WHERE l_quantity >= 2 GROUP BY 1) SELECT k, coalesce(n, 0) - coalesce(m, 0) AS rest FROM a FULL JOIN b USING (k)")
def j8_label_histograms(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a = t.where("l_quantity < 2").groupBy(F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.where("l_quantity >= 2").groupBy(F.col("l_linestatus").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "k", "full").select("k", (F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("rest"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j17_semi_and_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").join(returned, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(with_tables("profiles") + ", " + _HOLES + """
SELECT q.profile_id AS query, arg_min(p.profile_id, (round(list_avg(list_transform(list_zip(q.vals, p.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), p.profile_id)) AS nearest FROM holes q JOIN holes p ON q.profile_id <> p.profile_id WHERE q.profile_id % 20 = 0 GROUP BY 1""")
def j20_nearest_with_missing(spark, sf_dir):
    """The nearest of all profiles to each query profile, over the slots that both have."""
    h = _holes(spark, sf_dir)
    near = distance.nearest_to_queries(h, h.where("profile_id % 20 = 0"), "profile_id", "vals", distance.missing_aware_to_nine_places, 1)
    return near.where("d is not null").select("query", F.col("other").alias("nearest"))


@query("SELECT label AS cluster, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM embeddings GROUP BY 1")
def a28_cluster_members(spark, sf_dir):
    return profiles(spark, sf_dir).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("profile_id")).cast("array<string>"), ",").alias("members"))


@query("""SELECT cluster, part, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM (SELECT label AS cluster, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS part FROM embeddings) GROUP BY 1, 2""")
def a28_cluster_member_parts(spark, sf_dir):
    """Members of each cluster in order, a hundred a row, so that no row grows with its cluster."""
    return reshape.in_parts(profiles(spark, sf_dir), "cluster", "profile_id", 100)


@query("SELECT k, x FROM (SELECT c_nationkey AS k, c_acctbal AS x FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)")
def o12_union_of_common_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"), "c_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"), "s_suppkey")
    common = [n for n in c.columns if n in s.columns]
    return c.select(common).union(s.select(common))


@query("SELECT o_orderkey, 2 * (o_totalprice - a) / (b - a) - 1 AS scaled FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)")
def f18_global_range(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    ends = F.broadcast(t.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")))
    return t.join(ends).select("o_orderkey", (2 * (F.col("o_totalprice") - F.col("a")) / (F.col("b") - F.col("a")) - 1).alias("scaled"))


@query("SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS feels_like, round(max(l_quantity), 6) AS max_temp, CAST(round(sum(l_tax), 4) AS DOUBLE) AS sun_hours FROM lineitem GROUP BY 1")
def f25_daily_weather(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_quantity"), 6).alias("feels_like"), F.round(F.max("l_quantity"), 6).alias("max_temp"), F.round(F.sum("l_tax"), 4).alias("sun_hours"))


@query(_CASES + """, lv AS (SELECT day, slot, unnest([0.1::DOUBLE, 0.5, 0.9]) AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS v FROM scen GROUP BY 1, 2),
p AS (SELECT slot, 100 * avg(CASE WHEN y >= v THEN q * (y - v) ELSE (q - 1) * (y - v) END) AS pinball, sqrt(avg(CASE WHEN q = 0.5 THEN (y - v) * (y - v) END)) AS rmse FROM lv JOIN obs USING (day, slot) GROUP BY 1)
SELECT slot, round(pinball, 6) AS pinball, round(rmse, 6) AS rmse FROM p""")
def g16_report_per_slot(spark, sf_dir):
    """Pinball loss and error of the median, slot by slot."""
    s, o = _cases(spark, sf_dir)
    q = scoring.quantiles(s, [0.1, 0.5, 0.9])
    gap = F.col("y") - F.col("value")
    rmse = q.where("q = 0.5").join(o, ["day", "slot"]).groupBy("slot").agg(F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"))
    return scoring.pinball(q, o, "slot").select("slot", F.round("loss", 6).alias("pinball")).join(rmse, "slot")


@query(_CASES + """, e AS (SELECT day, s, avg(abs(value - y)) AS e FROM scen JOIN obs USING (day, slot) GROUP BY 1, 2), f AS (SELECT *, CAST(('0x' || substr(md5('cv:' || s), 1, 8)) AS BIGINT) % 5 AS fold FROM e)
SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg(e), 6) AS score FROM f GROUP BY 1""")
def m16_cross_validated_scores(spark, sf_dir):
    """Scores by fold; folds are decided by a hash of the scenario."""
    s, o = _cases(spark, sf_dir)
    e = s.join(o, ["day", "slot"]).groupBy("day", "s").agg(F.avg(F.abs(F.col("value") - F.col("y"))).alias("e"))
    return e.groupBy(samplers.fold_of(F.col("s"), "cv", 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("score"))


@query("WITH p AS (SELECT o_custkey AS test, o_orderkey AS pick FROM orders) SELECT test, pick, 1 / CAST(count(*) OVER (PARTITION BY test) AS DOUBLE) AS p FROM p")
def m12_uniform_probabilities(spark, sf_dir):
    return samplers.uniform(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test"), F.col("o_orderkey").alias("pick")))


@query()
def d5_masked_time_warping(spark, sf_dir):
    """DTW of query profiles (ids divisible by 20) with all profiles whose total is near theirs; the mask comes first."""
    p = profiles(spark, sf_dir)
    return blocks.warped_where_near(p, p.where("profile_id % 20 = 0"), "profile_id", "vals", 1.0, 4)


@query("SELECT vec_id AS profile_id, least(abs(vec_id % 366 - 100), 366 - abs(vec_id % 366 - 100)) <= 30 AS in_season FROM embeddings")
def d7_season_window(spark, sf_dir):
    """The circular window of 30 days around day 100 that limits which days may be matched."""
    return profiles(spark, sf_dir).select("profile_id", matching.in_season(F.col("profile_id") % 366, F.lit(100), 30).alias("in_season"))


@query()
def d7_season_matching(spark, sf_dir):
    """Eight days a profile, matched at least total cost, only days within two of each other around the end counting.

    Query profiles (ids divisible by 20) against all others.
    """
    p = profiles(spark, sf_dir)
    return matching.assigned(p.where("profile_id % 20 = 0"), p, "profile_id", "vals", 8, reach=2)


@query()
def c6_elbow_by_chord(spark, sf_dir):
    """The point furthest from the chord of fitted inertias, standardised."""
    curve = clustering.standardised(clustering.inertias(profiles(spark, sf_dir), "vals", [2, 3, 4, 5, 6, 7, 8, 10]), "inertia")
    return clustering.chord_elbow(curve, "k", "inertia").select("k", F.round("d", 6).alias("d"))


@query(HOURLY + """SELECT meter_id, start, "end" FROM runs WHERE NOT ((start = 48 AND "end" = 49) OR (start = 100 AND "end" = 101))""")
def q2_drop_clock_artefacts(spark, sf_dir):
    """Without the intervals that the change of clocks makes."""
    found = seq.runs(hourly(spark, sf_dir), ["meter_id"], "pos", F.col("value").isNull())
    bad = F.broadcast(spark.createDataFrame([(48, 49), (100, 101)], "start int, `end` int"))
    return found.join(bad, ["start", "end"], "left_anti").select("meter_id", "start", "end")


_BOX = "box AS (SELECT meter_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM hourly GROUP BY 1)"
_CUMULATIVE = "CASE WHEN after > 95 THEN true WHEN after < second THEN false WHEN after > q3 + 1.5 * greatest(q3 - q1, 0.25) OR after < q1 - 1.5 * greatest(q3 - q1, 0.25) THEN true END"


@query(GAPS + ", " + _BOX + """, v AS (SELECT *, "end" - start AS len, ("end" - start = 1 AND sign(before - 25) = -sign(after - 25)) OR (abs(before) < 10 AND abs(after) < 10) AS normal FROM gaps),
rest AS (SELECT * FROM v WHERE normal IS NOT TRUE), counts AS (SELECT start, len, count(*) AS c FROM rest GROUP BY 1, 2),
modal AS (SELECT start, len AS mode, sum(c) OVER (PARTITION BY start) AS same FROM counts QUALIFY row_number() OVER (PARTITION BY start ORDER BY c DESC, len) = 1)
SELECT v.meter_id, v.start, v."end", CASE WHEN normal THEN false WHEN same >= 5 AND abs(len - mode) <= 2 THEN true ELSE """ + _CUMULATIVE + """ END AS error
FROM v JOIN box USING (meter_id) LEFT JOIN modal ON modal.start = v.start""")
def q22_zero_interval_pipeline(spark, sf_dir):
    """Sign change and low sides clear an interval; of the rest, a start that many share with a like length convicts; of
    what is left, the value after it tells whether it holds what was not read."""
    rows = hourly(spark, sf_dir)
    near = seq.runs_of_kinds(rows, ["meter_id"], "pos", "value", F.when(F.col("value").isNull(), 1))
    b, a = F.col("value_before"), F.col("value_after")
    near = near.withColumn("normal", intervals.combine(rules.sign_change(F.col("end") - F.col("start"), b - 25, a - 25), rules.low_sides(b, a, 10.0)))
    all_ = intervals.collective_rest(near, F.col("normal").isNull(), 5, 2).join(rules.quartiles(rows, "meter_id", "value"), "meter_id")
    more = rules.holds_more(a, F.col("second_after"), F.col("_q1"), F.col("_q3"), 95.0)
    return all_.select("meter_id", "start", "end", F.coalesce("normal", "shared", more).alias("error"))


@query(with_tables("readings") + """, c AS (SELECT meter_id, CAST(floor(value / 5) AS BIGINT) AS cell, count(*) AS n FROM readings GROUP BY 1, 2),
d AS (SELECT a.meter_id, a.cell, a.n, round(sum(b.n * exp(-0.5 * o * o)), 6) AS f FROM c a CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN c b ON b.meter_id = a.meter_id AND b.cell = a.cell + o GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY meter_id ORDER BY f DESC, cell ROWS UNBOUNDED PRECEDING) - n AS denser, sum(n) OVER (PARTITION BY meter_id) AS total FROM d)
SELECT row_id, denser >= 0.95 * total AS outside FROM readings JOIN r ON r.meter_id = readings.meter_id AND r.cell = CAST(floor(value / 5) AS BIGINT)""")
def q11_density_region(spark, sf_dir):
    """Readings outside the densest cells that hold 95 % of their meter's readings, by a Gaussian kernel over cells."""
    return rules.outside_density(readings(spark, sf_dir), "meter_id", "value", width=5.0, bandwidth=5.0, reach=3, mass=0.95).select("row_id", "outside")


@query(GAPS + """, asked AS (SELECT meter_id, start, "end", before, after, d FROM gaps CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) WHERE d <> 0 AND after IS NOT NULL),
seen AS (SELECT a.meter_id, start, "end", after, d, max(CASE WHEN h.pos - d * 24 = "end" THEN h.value END) AS real, coalesce(round(sum(h.value), 6), 0) AS total FROM asked a JOIN hourly h ON h.meter_id = a.meter_id AND h.pos BETWEEN start + d * 24 AND "end" + d * 24 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = "end" - start + 1),
alike AS (SELECT meter_id, start, "end", min(round(abs(after - total), 6)) < min(round(abs(after - real), 6)) AS cumulative FROM seen GROUP BY 1, 2, 3),
c AS (SELECT meter_id, CAST(floor(value / 10) AS BIGINT) AS cell, count(*) AS n FROM hourly WHERE value IS NOT NULL GROUP BY 1, 2), s AS (SELECT meter_id, cell, n / CAST(sum(n) OVER (PARTITION BY meter_id) AS DOUBLE) AS share FROM c)
SELECT g.meter_id, g.start, g."end", CASE WHEN g.after > 95 THEN true WHEN a.cumulative IS NOT NULL THEN a.cumulative WHEN s.share < 0.02 THEN true WHEN abs(g.before) < 10 AND abs(g.after) < 10 THEN false END AS error
FROM gaps g LEFT JOIN alike a USING (meter_id, start, "end") LEFT JOIN s ON s.meter_id = g.meter_id AND s.cell = CAST(floor(g.after / 10) AS BIGINT)""")
def q15_detector_ensemble(spark, sf_dir):
    """The first detector that has a verdict decides: capacity, likeness to days nearby, a rare value, low sides."""
    rows = hourly(spark, sf_dir)
    near = seq.runs_of_kinds(rows, ["meter_id"], "pos", "value", F.when(F.col("value").isNull(), 1))
    alike = rules.real_or_cumulative(rows, near.select("meter_id", "start", "end"), "meter_id", "pos", "value", 24, 3)
    cell = F.floor(F.col("value") / 10)
    n = rows.where("value is not null").groupBy("meter_id", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    rare = n.select("meter_id", "cell", F.when(F.col("n") / F.sum("n").over(Window.partitionBy("meter_id")) < 0.02, True).alias("rare"))
    all_ = near.join(alike, ["meter_id", "start", "end"], "left").withColumn("cell", F.floor(F.col("value_after") / 10)).join(rare, ["meter_id", "cell"], "left")
    verdict = F.coalesce(F.when(F.col("value_after") > 95, True), F.col("cumulative"), F.col("rare"), rules.low_sides(F.col("value_before"), F.col("value_after"), 10.0))
    return all_.select("meter_id", "start", "end", verdict.alias("error"))


@query(with_tables("profiles") + """, p AS (SELECT profile_id, cluster, list_avg(vals) AS x, CAST(('0x' || substr(md5('fit:' || profile_id), 1, 8)) AS BIGINT) % 5 AS fold FROM profiles),
f AS (SELECT a.fold, b.cluster, avg(b.x) AS m FROM (SELECT DISTINCT fold FROM p) a JOIN p b ON b.fold <> a.fold GROUP BY 1, 2),
g AS (SELECT p.profile_id, p.fold, p.cluster, p.x, f.cluster AS guess, f.m FROM p JOIN f USING (fold) QUALIFY row_number() OVER (PARTITION BY p.profile_id ORDER BY round(abs(p.x - f.m), 12), f.cluster) = 1)
SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg(CASE WHEN guess = cluster THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(abs(x - m)), 6) AS error FROM g GROUP BY 1""")
def m16_cross_validated_fits(spark, sf_dir):
    """Cluster means fitted without each fold, and the held-out fold's profiles given to the nearest one."""
    mean = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x) / F.size("vals")
    p = profiles(spark, sf_dir).select("profile_id", "cluster", mean.alias("x"), samplers.fold_of(F.col("profile_id"), "fit", 5).alias("fold"))
    scored = samplers.cross_validated_centroids(p, "profile_id", "cluster", "x", "fold")
    hit = F.avg((F.col("guess") == F.col("cluster")).cast("double"))
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(hit, 6).alias("accuracy"), F.round(F.avg("d"), 6).alias("error"))


@query(with_tables("profiles") + """, p AS (SELECT profile_id, cluster, vals, list_avg(vals) AS x, CAST(('0x' || substr(md5('fit:' || profile_id), 1, 8)) AS BIGINT) % 5 AS fold FROM profiles),
f AS (SELECT a.fold, b.cluster, avg(b.x) AS m FROM (SELECT DISTINCT fold FROM p) a JOIN p b ON b.fold <> a.fold GROUP BY 1, 2),
g AS (SELECT p.profile_id, p.fold, p.vals, f.cluster AS guess FROM p JOIN f USING (fold) QUALIFY row_number() OVER (PARTITION BY p.profile_id ORDER BY round(abs(p.x - f.m), 12), f.cluster) = 1),
drawn AS (SELECT a.fold, cluster, profile_id AS s, vals FROM (SELECT DISTINCT fold FROM p) a JOIN p ON p.fold <> a.fold QUALIFY row_number() OVER (PARTITION BY a.fold, cluster ORDER BY md5('energy:' || profile_id), profile_id) <= 25),
away AS (SELECT a.fold, a.cluster, avg(sqrt(list_sum(list_transform(list_zip(a.vals, b.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) / 2 AS d FROM drawn a JOIN drawn b ON a.fold = b.fold AND a.cluster = b.cluster GROUP BY 1, 2),
near AS (SELECT g.profile_id, g.fold, g.guess, avg(sqrt(list_sum(list_transform(list_zip(g.vals, d.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM g JOIN drawn d ON d.fold = g.fold AND d.cluster = g.guess GROUP BY 1, 2, 3)
SELECT CAST(near.fold AS INT) AS fold, count(*) AS n, round(avg(near.d - away.d), 6) AS energy FROM near JOIN away ON away.fold = near.fold AND away.cluster = near.guess GROUP BY 1""")
def m16_cross_validated_energy(spark, sf_dir):
    """Energy scores of held-out profiles under 25 scenarios from the cluster that the other folds' means give them."""
    mean = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x) / F.size("vals")
    p = profiles(spark, sf_dir).select("profile_id", "cluster", "vals", mean.alias("x"), samplers.fold_of(F.col("profile_id"), "fit", 5).alias("fold"))
    scored = samplers.cross_validated_energy(p, "profile_id", "cluster", "x", "fold", "vals", 25, "energy")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("es"), 6).alias("energy"))


@query(GAPS + """, asked AS (SELECT meter_id, start, "end", before, after, d FROM gaps CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) WHERE d <> 0 AND after IS NOT NULL),
seen AS (SELECT a.meter_id, start, "end", after, d, max(CASE WHEN h.pos - d * 24 = "end" THEN h.value END) AS real, coalesce(round(sum(h.value), 6), 0) AS total FROM asked a JOIN hourly h ON h.meter_id = a.meter_id AND h.pos BETWEEN start + d * 24 AND "end" + d * 24 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = "end" - start + 1),
alike AS (SELECT meter_id, start, "end", min(round(abs(after - total), 6)) < min(round(abs(after - real), 6)) AS cumulative FROM seen GROUP BY 1, 2, 3),
c AS (SELECT meter_id, CAST(floor(value / 5) AS BIGINT) AS cell, count(*) AS n FROM hourly WHERE value IS NOT NULL GROUP BY 1, 2),
d AS (SELECT a.meter_id, a.cell, a.n, round(sum(b.n * exp(-0.5 * o * o)), 6) AS f FROM c a CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN c b ON b.meter_id = a.meter_id AND b.cell = a.cell + o GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY meter_id ORDER BY f DESC, cell ROWS UNBOUNDED PRECEDING) - n AS denser, sum(n) OVER (PARTITION BY meter_id) AS total FROM d)
SELECT g.meter_id, g.start, g."end", CASE WHEN g.after > 95 THEN true WHEN a.cumulative IS NOT NULL THEN a.cumulative WHEN r.denser >= 0.95 * r.total THEN true WHEN abs(g.before) < 10 AND abs(g.after) < 10 THEN false END AS error
FROM gaps g LEFT JOIN alike a USING (meter_id, start, "end") LEFT JOIN r ON r.meter_id = g.meter_id AND r.cell = CAST(floor(g.after / 5) AS BIGINT)""")
def q15_density_ensemble(spark, sf_dir):
    """As ``q15_detector_ensemble``, with the region outside 95 % of the meter's kernel density as third detector."""
    rows = hourly(spark, sf_dir)
    near = seq.runs_of_kinds(rows, ["meter_id"], "pos", "value", F.when(F.col("value").isNull(), 1))
    alike = rules.real_or_cumulative(rows, near.select("meter_id", "start", "end"), "meter_id", "pos", "value", 24, 3)
    region = rules.density_region(rows, "meter_id", "value", width=5.0, bandwidth=5.0, reach=3, mass=0.95)
    all_ = near.join(alike, ["meter_id", "start", "end"], "left").withColumn("_cell", F.floor(F.col("value_after") / 5)).join(region, ["meter_id", "_cell"], "left")
    verdict = F.coalesce(F.when(F.col("value_after") > 95, True), F.col("cumulative"), F.when(F.col("outside"), True), rules.low_sides(F.col("value_before"), F.col("value_after"), 10.0))
    return all_.select("meter_id", "start", "end", verdict.alias("error"))


@query("SELECT 'c_custkey' AS name, count(c_custkey) AS known FROM customer UNION ALL SELECT 'c_name', count(c_name) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer")
def p14_known_per_column(spark, sf_dir):
    """How many values each column has; columns without any are the ones to drop."""
    from loadscape.operators.cleaning import known_counts

    return known_counts(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))


@query(with_tables("slots") + "SELECT profile_id, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls FROM (SELECT profile_id, CASE WHEN slot BETWEEN 8 AND 11 THEN 0 WHEN abs(value) > 0.4 THEN NULL ELSE value END AS value FROM slots) GROUP BY 1 HAVING count(*) FILTER (value IS NULL) = 0")
def p30_clean_profiles(spark, sf_dir):
    """The skipped hour filled with 0, peaks masked, and only complete profiles kept."""
    v = F.when(F.col("slot").between(8, 11), 0.0).when(F.abs("value") > 0.4, None).otherwise(F.col("value"))
    rows = slots(spark, sf_dir).select("profile_id", v.alias("value")).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))
    return rows.where("nulls = 0")


@query(with_tables("readings") + "SELECT meter_id, kind, row_id FROM readings QUALIFY row_number() OVER (PARTITION BY meter_id, kind ORDER BY md5('sub:' || row_id), row_id) = 1")
def o7_one_per_stratum(spark, sf_dir):
    key = F.md5(F.concat(F.lit("sub:"), F.col("row_id").cast("string")).cast("binary"))
    w = Window.partitionBy("meter_id", "kind").orderBy(key, "row_id")
    return readings(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("meter_id", "kind", "row_id")


@query(with_tables("readings") + ", c AS (SELECT meter_id, CAST(floor(value / 10) AS BIGINT) AS cell, count(*) AS n FROM readings GROUP BY 1, 2), s AS (SELECT meter_id, cell, n / CAST(sum(n) OVER (PARTITION BY meter_id) AS DOUBLE) AS share FROM c) SELECT row_id, share < 0.02 AS rare FROM readings r JOIN s ON s.meter_id = r.meter_id AND s.cell = CAST(floor(value / 10) AS BIGINT)")
def q12_rare_values(spark, sf_dir):
    """Readings in sparse cells of their meter's own distribution."""
    return rules.rare_values(readings(spark, sf_dir), "meter_id", "value", 10.0, 0.02).select("row_id", "rare")


@query(HOURLY + """, asked AS (SELECT r.meter_id, start, "end", h.value AS v, d FROM runs r JOIN hourly h ON h.meter_id = r.meter_id AND h.pos = "end" AND h.value IS NOT NULL, (SELECT unnest(range(-3, 4)) AS d) WHERE d <> 0),
seen AS (SELECT a.meter_id, start, "end", v, d, max(CASE WHEN h.pos - d * 24 = "end" THEN h.value END) AS real, coalesce(round(sum(h.value), 6), 0) AS total FROM asked a JOIN hourly h ON h.meter_id = a.meter_id AND h.pos BETWEEN start + d * 24 AND "end" + d * 24 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = "end" - start + 1)
SELECT meter_id, start, "end", min(round(abs(v - total), 6)) < min(round(abs(v - real), 6)) AS cumulative FROM seen GROUP BY 1, 2, 3""")
def q14_real_or_cumulative(spark, sf_dir):
    """Values after gaps held against the same hours of the three days before and after."""
    rows = hourly(spark, sf_dir)
    found = seq.runs(rows, ["meter_id"], "pos", F.col("value").isNull())
    return rules.real_or_cumulative(rows, found, "meter_id", "pos", "value", 24, 3)
