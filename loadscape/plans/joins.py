"""Queries on joins, aggregates, reshaping, sampling and the conditional samplers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadscape.functions import calendar as cal
from loadscape.operators import reshape, samplers
from loadscape.plans.registry import query
from loadscape.sources.tables import days, meters, profiles, readings, slots, table, with_tables


@query(with_tables("readings", "meters") + "SELECT row_id, meter_id, location_id FROM readings LEFT JOIN meters USING (meter_id)")
def j1_left_dimension(spark, sf_dir):
    return readings(spark, sf_dir).join(meters(spark, sf_dir), "meter_id", "left").select("row_id", "meter_id", "location_id")


@query("""SELECT o_orderkey, o_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j3_attribute_lookup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "o_custkey", "n_name", "r_name")


@query(with_tables("days") + """, d AS (SELECT year(date) AS y, count(*) AS n, min(date) AS first FROM days GROUP BY 1)
SELECT o_custkey, y, count(*) AS days, min(date) AS first_day FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders) h JOIN (SELECT date, year(date) AS y2 FROM days) ON y = y2 GROUP BY 1, 2""")
def j5_household_days(spark, sf_dir):
    """Each meter-year meets every day of its year; the M:N join is by year."""
    h = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    d = days(spark, sf_dir).withColumn("y", F.year("date"))
    return h.join(d, "y").groupBy("o_custkey", "y").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"))


@query(with_tables("readings", "meters") + """
SELECT meter_id, a.n AS events, b.yearly FROM (SELECT meter_id, count(*) AS n FROM readings WHERE kind = 'purchase' GROUP BY 1) a FULL JOIN (SELECT meter_id, yearly FROM meters WHERE yearly > 0) b USING (meter_id)""")
def j6_full_outer(spark, sf_dir):
    a = readings(spark, sf_dir).where("kind = 'purchase'").groupBy("meter_id").agg(F.count(F.lit(1)).alias("events"))
    return a.join(meters(spark, sf_dir).where("yearly > 0").select("meter_id", "yearly"), "meter_id", "full")


@query(with_tables("readings", "meters") + "SELECT meter_id, sum(value) IS NULL AS silent, count(row_id) AS n FROM readings RIGHT JOIN meters USING (meter_id) GROUP BY 1")
def j9_right_join(spark, sf_dir):
    return readings(spark, sf_dir).join(meters(spark, sf_dir), "meter_id", "right").groupBy("meter_id").agg(F.sum("value").isNull().alias("silent"), F.count("row_id").alias("n"))


@query(with_tables("readings", "meters") + "SELECT count(*) FILTER (k = 1) AS only_meters, count(*) FILTER (k = 2) AS only_readings FROM (SELECT meter_id, 1 AS k FROM meters WHERE meter_id NOT IN (SELECT meter_id FROM readings) UNION ALL SELECT DISTINCT meter_id, 2 FROM readings WHERE meter_id NOT IN (SELECT meter_id FROM meters))")
def j18_key_differences(spark, sf_dir):
    m, r = meters(spark, sf_dir).select("meter_id"), readings(spark, sf_dir).select("meter_id").distinct()
    both = m.join(r, "meter_id", "left_anti").withColumn("k", F.lit(1)).union(r.join(m, "meter_id", "left_anti").withColumn("k", F.lit(2)))
    return both.agg(F.count_if(F.col("k") == 1).alias("only_meters"), F.count_if(F.col("k") == 2).alias("only_readings"))


_TEMPERATURE = """temps AS (SELECT date, dayofyear(date) % 40 + (year(date) % 3) * 0.7 + CASE WHEN dayofyear(date) % 97 = 0 THEN (year(date) - 1990) * 100 ELSE 0 END AS t, isodow(date) >= 6 AS weekend, isodow(date) - 1 AS dow, month(date) AS month, year(date) AS y FROM days)"""


def _temperatures(spark, sf_dir):
    d = F.col("date")
    t = (F.dayofyear(d) % 40).cast("decimal(10,1)") + (F.year(d) % 3) * F.lit(0.7).cast("decimal(2,1)")
    t = t + F.when(F.dayofyear(d) % 97 == 0, (F.year(d) - 1990) * 100).otherwise(0).cast("decimal(10,1)")
    return days(spark, sf_dir).select("date", t.cast("double").alias("t"), (F.weekday(d) >= 5).alias("weekend"), F.weekday(d).alias("dow"), F.month(d).alias("month"), F.year(d).alias("y"))


@query(with_tables("days") + ", " + _TEMPERATURE + """,
q AS (SELECT * FROM temps), train AS (SELECT * FROM temps),
band AS (SELECT q.date AS test, train.date AS pick FROM q JOIN train ON q.weekend = train.weekend AND q.y <> train.y AND abs(q.t - train.t) <= 2.5),
second AS (SELECT q.date AS test, train.date AS pick FROM q JOIN train ON q.dow = train.dow AND q.month = train.month AND q.y <> train.y WHERE q.date NOT IN (SELECT test FROM band)),
third AS (SELECT q.date AS test, train.date AS pick FROM q JOIN train ON q.month = train.month AND q.y <> train.y WHERE q.date NOT IN (SELECT test FROM band) AND q.date NOT IN (SELECT test FROM second)),
picks AS (SELECT * FROM band UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)
SELECT test, pick, 1 / CAST(count(*) OVER (PARTITION BY test) AS DOUBLE) AS p FROM picks""")
def j12_temperature_band(spark, sf_dir):
    """For every day: days of other years of like temperature and day kind, else of like weekday and month, else of the
    month, equally likely. A few days are made too warm for any other."""
    rows = _temperatures(spark, sf_dir)
    return samplers.temperature_band(rows, rows, 2.5)


@query(with_tables("readings") + "SELECT meter_id, date_trunc('hour', ts) AS ts, coalesce(sum(value) FILTER (kind = 'purchase'), 0) AS offtake, sum(value) FILTER (kind = 'error') AS injection FROM readings GROUP BY 1, 2")
def a1_null_aware_sums(spark, sf_dir):
    """A missing side is 0 where sums skip NULL, and NULL where an all-NULL sum stays NULL."""
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("value")))
    return readings(spark, sf_dir).groupBy("meter_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.coalesce(side("purchase"), F.lit(0.0)).alias("offtake"), side("error").alias("injection"))


@query(with_tables("readings") + "SELECT meter_id, count(*) FILTER (value < 10) AS low, count(DISTINCT kind) AS kinds, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd FROM readings GROUP BY 1")
def a8_meter_statistics(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("meter_id").agg(F.count_if(F.col("value") < 10).alias("low"), F.count_distinct("kind").alias("kinds"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query(with_tables("profiles") + "SELECT profile_id, list_max(vals) AS hi, list_min(vals) AS lo, round(list_sum(vals), 6) AS total FROM profiles")
def a9_profile_extremes(spark, sf_dir):
    v = F.col("vals")
    return profiles(spark, sf_dir).select("profile_id", F.array_max(v).alias("hi"), F.array_min(v).alias("lo"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(with_tables("readings") + """, c AS (SELECT meter_id, kind, count(*) AS n FROM readings GROUP BY 1, 2)
SELECT meter_id, kind AS most_common FROM c QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY n DESC, kind) = 1""")
def a11_most_common(spark, sf_dir):
    c = readings(spark, sf_dir).groupBy("meter_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("meter_id").orderBy(F.desc("n"), "kind"))).where("k = 1").select("meter_id", F.col("kind").alias("most_common"))


@query("SELECT years, count(*) AS meters FROM (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1) GROUP BY 1")
def a13_count_of_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years")).groupBy("years").agg(F.count(F.lit(1)).alias("meters"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def a15_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query(with_tables("slots") + "SELECT slot, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM slots GROUP BY 1")
def a18_slot_quantiles(spark, sf_dir):
    from loadscape.operators.counted import quantiles

    at = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    found = quantiles(slots(spark, sf_dir), "value", [*at.values()], ["slot"])
    return found.groupBy("slot").agg(*[F.round(F.max(F.when(F.col("level") == q, F.col("value"))), 6).alias(n) for n, q in at.items()])


@query(with_tables("slots") + """, s AS (SELECT slot, list_sort(list(value)) AS v, count(*) AS n FROM slots GROUP BY 1)
SELECT slot, lpad(CAST(lo AS VARCHAR), 2, '0') || '-' || lpad(CAST(100 - lo AS VARCHAR), 2, '0') AS band, v[CAST(round_even((n - 1) * lo / 100, 0) AS INT) + 1] AS lower, v[CAST(round_even((n - 1) * (100 - lo) / 100, 0) AS INT) + 1] AS upper
FROM s, (VALUES (5), (25), (45)) b(lo)""")
def a19_nearest_quantile_bands(spark, sf_dir):
    """Lower and upper nearest-rank quantiles of each slot, folded into symmetric bands."""
    return reshape.quantile_bands(slots(spark, sf_dir), "slot", "value", [5, 25, 45])


@query(with_tables("slots") + """, c AS (SELECT profile_id, CAST(slot // 4 AS INT) AS k, sum(value) AS v FROM slots GROUP BY 1, 2)
SELECT a.k AS i, b.k AS j, round(corr(a.v, b.v), 6) AS r FROM c a JOIN c b USING (profile_id) WHERE a.k < b.k GROUP BY 1, 2""")
def a21_slot_correlation(spark, sf_dir):
    """Correlation between the slots of all profiles, after folding four into one."""
    from loadscape.functions.features import fold

    a = profiles(spark, sf_dir).select("profile_id", F.posexplode(fold(F.col("vals"), 4)).alias("i", "x"))
    b = a.select("profile_id", F.col("i").alias("j"), F.col("x").alias("y"))
    return a.join(b, "profile_id").where("i < j").groupBy("i", "j").agg(F.round(F.corr("x", "y"), 6).alias("r"))


@query(with_tables("slots") + "SELECT cluster, slot, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM slots GROUP BY 1, 2")
def a29_cluster_envelope(spark, sf_dir):
    return slots(spark, sf_dir).groupBy("cluster", "slot").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""SELECT o_custkey, month, round(v / sum(v) OVER (PARTITION BY o_custkey), 6) AS share FROM (SELECT o_custkey, month(o_orderdate) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)""")
def a30_monthly_share(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return m.select("o_custkey", "month", F.round(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("o_custkey"))), 6).alias("share"))


@query("SELECT o_custkey FROM (SELECT o_custkey, md5('split:' || o_custkey) AS h FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE h < 'b3333333'")
def o4_hash_split(spark, sf_dir):
    """About seven tenths of the keys, decided by a hash of each alone."""
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().where(samplers.hash_below(F.col("o_custkey"), "split", 0.7))


@query("SELECT c_custkey, CAST(('0x' || substr(md5('fold:' || c_custkey), 1, 8))::BIGINT % 5 AS INT) AS fold FROM customer")
def o6_folds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", samplers.fold_of(F.col("c_custkey"), "fold", 5).alias("fold"))


@query(with_tables("days") + """SELECT date FROM days WHERE weekofyear(date) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY year(date), weekofyear(date), isodow(date) >= 6 ORDER BY md5('day:' || strftime(date, '%Y-%m-%d'))) = 1""")
def o8_stratified_days(spark, sf_dir):
    """One weekday and one weekend day of every second ISO week."""
    d = F.col("date")
    w = Window.partitionBy(F.year(d), F.weekofyear(d), F.weekday(d) >= 5).orderBy(F.md5(F.concat(F.lit("day:"), d.cast("string")).cast("binary")))
    return days(spark, sf_dir).where(F.weekofyear(d) % 2 == 0).withColumn("k", F.row_number().over(w)).where("k = 1").select("date")


@query("SELECT c_mktsegment, c_nationkey, c_acctbal AS x FROM customer WHERE c_acctbal > 0 UNION ALL SELECT NULL, s_nationkey, s_acctbal FROM supplier")
def o11_union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("x"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("x")), allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def o13_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query(with_tables("readings") + """SELECT meter_id, CAST(ts AS DATE) AS date, round(sum(value) FILTER (hour(ts) < 6), 4) AS night, round(sum(value) FILTER (hour(ts) BETWEEN 6 AND 11), 4) AS morning,
  round(sum(value) FILTER (hour(ts) BETWEEN 12 AND 17), 4) AS afternoon, round(sum(value) FILTER (hour(ts) >= 18), 4) AS evening FROM readings GROUP BY 1, 2""")
def o14_pivot_day(spark, sf_dir):
    part = F.element_at(F.array(*map(F.lit, ("night", "morning", "afternoon", "evening"))), (F.floor(F.hour("ts") / 6) + 1).cast("int"))
    p = readings(spark, sf_dir).withColumn("part", part).groupBy("meter_id", F.to_date("ts").alias("date")).pivot("part", ["night", "morning", "afternoon", "evening"])
    return p.agg(F.round(F.sum("value"), 4))


@query(with_tables("profiles") + """SELECT profile_id, CAST(d AS INT) AS day, list_sum(vals[d * 16 + 1 : d * 16 + 16]) IS NOT NULL AS known, vals[d * 16 + 1] AS first, vals[d * 16 + 16] AS last FROM profiles, (SELECT unnest(range(4)) AS d)""")
def o18_long_to_daily(spark, sf_dir):
    """A long profile cut into equal days."""
    out = reshape.split_days(profiles(spark, sf_dir), "vals", 16)
    return out.select("profile_id", "day", (F.size("day_values") > 0).alias("known"), F.col("day_values")[0].alias("first"), F.col("day_values")[15].alias("last"))


@query(with_tables("slots") + "SELECT profile_id, CAST(slot // 4 AS INT) AS chunk, round(sum(value), 6) AS total FROM slots GROUP BY 1, 2")
def a6_fold_slots(spark, sf_dir):
    from loadscape.functions.features import fold

    return profiles(spark, sf_dir).select("profile_id", F.posexplode(fold(F.col("vals"), 4)).alias("chunk", "t")).select("profile_id", "chunk", F.round("t", 6).alias("total"))


@query(with_tables("profiles") + """, q AS (SELECT profile_id AS test, (profile_id * 7) % 10 AS c1, (profile_id * 3 + 1) % 10 AS c2 FROM profiles WHERE profile_id % 20 = 0),
probs AS (SELECT test, cluster, sum(p) AS p FROM (SELECT test, c1 AS cluster, 0.75::DOUBLE AS p FROM q UNION ALL SELECT test, c2, 0.25::DOUBLE FROM q) GROUP BY 1, 2)
SELECT test, profile_id, p / n AS p FROM probs JOIN (SELECT profile_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM profiles) USING (cluster)""")
def m1_cluster_to_sample_probabilities(spark, sf_dir):
    """Cluster probabilities shared equally by the cluster's members."""
    rows = profiles(spark, sf_dir)
    q = rows.where("profile_id % 20 = 0").select(F.col("profile_id").alias("test"), F.explode(F.array(F.struct(((F.col("profile_id") * 7) % 10).alias("c"), F.lit(0.75).alias("p")), F.struct(((F.col("profile_id") * 3 + 1) % 10).alias("c"), F.lit(0.25).alias("p")))).alias("x"))
    probs = q.groupBy("test", F.col("x.c").alias("cluster")).agg(F.sum("x.p").alias("p"))
    return samplers.share_out(probs, rows.select("profile_id", "cluster"), "cluster")


@query("""WITH c AS (SELECT c_mktsegment AS cluster, avg(c_acctbal) AS centre FROM customer GROUP BY 1),
hit AS (SELECT c_custkey AS test, cluster FROM customer, c QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - centre), cluster) = 1),
n AS (SELECT c_mktsegment AS cluster, count(*) AS n FROM customer GROUP BY 1)
SELECT test, cluster, 1 / CAST(n AS DOUBLE) AS p FROM hit JOIN n USING (cluster)""")
def m2_metadata_sampler(spark, sf_dir):
    """The nearest centroid's cluster; each of its members is as likely."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("x"))
    return samplers.nearest_centroid(rows, rows, "x")


@query("""SELECT t AS test, c_custkey AS pick, 1 / 10::DOUBLE AS p FROM customer, (SELECT c_custkey AS t FROM customer WHERE c_custkey % 20 = 0)
QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5('pick:' || t || ':' || c_custkey)) <= 10""")
def m5_random_sampler(spark, sf_dir):
    """Ten members of the whole training set for each query, drawn by hash, without replacement."""
    c = table(spark, sf_dir, "customer")
    return samplers.draw(c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("test")), c.select(F.col("c_custkey").alias("pick")), 10, "pick")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), f AS (SELECT c_custkey AS test, greatest(n - 10, 0) AS j, CAST([] AS BIGINT[]) AS s, n FROM customer, n WHERE c_custkey % 20 = 0 UNION ALL
  SELECT test, j + 1, list_append(s, CASE WHEN list_contains(s, t) THEN j ELSE t END), n FROM (SELECT *, CAST(floor(CAST(('0x' || substr(md5('number:' || test || ':' || j), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE * (j + 1)) AS BIGINT) AS t FROM f WHERE j < n)),
r AS (SELECT c_custkey AS pick, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer)
SELECT test, pick, p FROM (SELECT test, 1 / CAST(len(s) AS DOUBLE) AS p, unnest(s) AS k FROM f WHERE j = n) JOIN r USING (k)""")
def m5_numbered_draws(spark, sf_dir):
    """Ten members of the whole training set for each query, drawn by number, so that no query meets all rows."""
    c = table(spark, sf_dir, "customer")
    return samplers.numbered_draws(c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("test")), c.select(F.col("c_custkey").alias("pick")), 10, "number")


@query(with_tables("days") + """, kinds AS (SELECT date, year(date) AS y, CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'spring' WHEN month(date) BETWEEN 6 AND 8 THEN 'summer' WHEN month(date) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season,
  CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind FROM days)
SELECT q.date AS test, count(*) AS days, 1 / CAST(count(*) AS DOUBLE) AS p FROM kinds q JOIN kinds t ON q.season = t.season AND q.kind = t.kind WHERE q.y = 2000 AND t.y <> 2000 GROUP BY 1""")
def m10_day_type_sampler(spark, sf_dir):
    """Days of every other year of the same season and day type, equally likely, for the days of 2000."""
    d = F.col("date")
    kinds = days(spark, sf_dir).select("date", F.year(d).alias("y"), cal.meteorological_season(d).alias("season"), cal.day_type(d, holidays=False).alias("kind"))
    q = kinds.where("y = 2000").select(F.col("date").alias("test"), "season", "kind")
    picks = samplers.by_key(q, kinds.where("y <> 2000").select(d.alias("pick"), "season", "kind"), ["season", "kind"])
    return picks.groupBy("test").agg(F.count(F.lit(1)).alias("days"), F.first("p").alias("p"))
