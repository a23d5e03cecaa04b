"""Queries on models, decompositions, splits and remaining profile operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadscape.functions.features import fold
from loadscape.operators import blocks, distance, matching, models
from loadscape.operators import sequences as seq
from loadscape.plans.quality import _HOLES, _holes
from loadscape.plans.registry import query
from loadscape.plans.series import HOURLY, hourly
from loadscape.sources.tables import meters, profiles, readings, slots, table, with_tables


@query()
def c8_pre_clustering(spark, sf_dir):
    return models.pre_clustering(profiles(spark, sf_dir), "profile_id", "vals", 30, 5)


@query()
def m3_consumption_sampler(spark, sf_dir):
    """Attributes are the means of the profile's quarters."""
    p = profiles(spark, sf_dir).withColumn("q", fold(F.col("vals"), 16))
    p = p.select("profile_id", "vals", *[F.col("q")[i].alias(f"x{i}") for i in range(4)])
    return models.classified_sampler(p.where("profile_id % 20 <> 0"), p.where("profile_id % 20 = 0"), "profile_id", "vals", [f"x{i}" for i in range(4)], 8)


@query()
def g12_principal_components(spark, sf_dir):
    return models.pca(profiles(spark, sf_dir), "vals", 2).select("profile_id", "components")


@query()
def g13_real_or_made(spark, sf_dir):
    """Copula scenarios against the profiles that they imitate."""
    from loadscape.operators.generators import gaussian_copula
    from loadscape.operators.reshape import to_array

    real = profiles(spark, sf_dir).select(fold(F.col("vals"), 4).alias("vals"))
    made = to_array(gaussian_copula(real, "vals", 16, 500, seed=1), ["s"], "slot", "value", "vals")
    return models.real_or_made(real, made, "vals")


@query(with_tables("profiles") + ", " + _HOLES + """, f AS (SELECT profile_id, cluster, list_transform(vals, lambda x: coalesce(x, list_avg(vals))) AS v FROM holes)
SELECT a.profile_id AS i, b.profile_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d FROM f a JOIN f b ON a.cluster = b.cluster AND a.profile_id < b.profile_id""")
def d3_distance_after_fill(spark, sf_dir):
    p = _holes(spark, sf_dir).withColumn("vals", distance.fill_mean(F.col("vals")))
    return distance.pairs_within(p, "cluster", "profile_id", "vals", distance.euclidean, 6, grouped=False)


@query(HOURLY + """, d AS (SELECT meter_id, pos, coalesce(value, 0) AS v, pos % 24 AS phase FROM hourly),
t AS (SELECT *, CASE WHEN pos BETWEEN 12 AND 707 THEN avg(v) OVER (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) END AS trend FROM d),
s AS (SELECT *, avg(v - trend) OVER (PARTITION BY meter_id, phase) AS season FROM t)
SELECT meter_id, pos, round(trend, 5) AS trend, round(season, 5) AS season, round(v - trend - season, 5) AS rest FROM s""")
def w15_seasonal_decomposition(spark, sf_dir):
    """Trend by a centred day, season by the mean of what is left at each hour, and the rest."""
    rows = hourly(spark, sf_dir).select("meter_id", "pos", F.coalesce("value", F.lit(0.0)).alias("v"))
    out = seq.decompose(rows, ["meter_id"], "pos", "v", 24, 720)
    return out.select("meter_id", "pos", *[F.round(c, 5).alias(c) for c in ("trend", "season", "rest")])


@query(HOURLY + """, d AS (SELECT meter_id, pos, coalesce(value, 0) AS v, pos % 24 AS phase FROM hourly),
t AS (SELECT *, CASE WHEN pos BETWEEN 12 AND 707 THEN median(v) OVER (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) END AS trend FROM d),
s AS (SELECT meter_id, phase, median(v - trend) AS season FROM t GROUP BY 1, 2)
SELECT meter_id, pos, round(trend, 5) AS trend, round(season, 5) AS season, round(v - trend - season, 5) AS rest FROM t JOIN s USING (meter_id, phase)""")
def w15_robust_decomposition(spark, sf_dir):
    """Trend by the median of a centred day, season by the median of what is left at each hour, and the rest."""
    rows = hourly(spark, sf_dir).select("meter_id", "pos", F.coalesce("value", F.lit(0.0)).alias("v"))
    out = seq.decompose_robust(rows, ["meter_id"], "pos", "v", 24, 720)
    return out.select("meter_id", "pos", *[F.round(c, 5).alias(c) for c in ("trend", "season", "rest")])


@query(HOURLY + """, h AS (SELECT meter_id, pos // 24 AS day, pos % 24 AS hour, value FROM hourly), m AS (SELECT meter_id, day, hour, value FROM h WHERE value IS NOT NULL),
pairs AS (SELECT a.meter_id, a.day, a.hour, b.day AS other, abs(a.value - b.value) AS gap, b.value AS v FROM m a JOIN m b ON a.meter_id = b.meter_id AND a.hour = b.hour AND a.day <> b.day AND abs(a.day - b.day) <= 25),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY meter_id, day, hour ORDER BY gap, other) <= 5)
SELECT meter_id, CAST(day AS BIGINT) AS day, hour, count(*) AS n, round(avg(CASE WHEN gap <= 10 THEN 1.0 ELSE 0 END), 6) AS alike, avg(CASE WHEN gap <= 10 THEN 1.0 ELSE 0 END) >= 0.8 AS real FROM near GROUP BY 1, 2, 3""")
def q13_context_vote(spark, sf_dir):
    """Share of the five most alike values at the same hour within 25 days that are close; real from four in five."""
    m = hourly(spark, sf_dir).where("value is not null").select("meter_id", F.floor(F.col("pos") / 24).alias("day"), (F.col("pos") % 24).alias("hour"), "value")
    near = seq.context(m, ["meter_id", "hour"], "day", "value", reach=25, k=5)
    share = F.avg((F.col("gap") <= 10).cast("double"))
    return near.groupBy("meter_id", "day", "hour").agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("alike"), (share >= 0.8).alias("real"))


@query("SELECT c_custkey FROM customer QUALIFY row_number() OVER (ORDER BY md5('hold:' || c_custkey), c_custkey) <= 50")
def o5_holdout(spark, sf_dir):
    """The fifty keys with the smallest hash: a top-k, not a global window."""
    key = F.md5(F.concat(F.lit("hold:"), F.col("c_custkey").cast("string")).cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy(key, "c_custkey").limit(50)


@query("SELECT n_name AS name, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment <> 'BUILDING') AS other FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def o20_transposed_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.col("c_mktsegment") == "BUILDING"
    return c.groupBy(F.col("n_name").alias("name")).agg(F.count_if(b).alias("building"), F.count_if(~b).alias("other"))


@query(with_tables("slots") + ", m AS (SELECT cluster, slot, avg(value) AS v FROM slots GROUP BY 1, 2) SELECT cluster, round(list_sum(list(v ORDER BY slot)), 6) AS total, round(max(v) FILTER (slot = 0), 6) AS first FROM m GROUP BY 1")
def a25_mean_profiles(spark, sf_dir):
    m = slots(spark, sf_dir).groupBy("cluster", "slot").agg(F.avg("value").alias("v"))
    return m.groupBy("cluster").agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.max(F.when(F.col("slot") == 0, F.col("v"))), 6).alias("first"))


@query("SELECT c_custkey, round(c_acctbal / (SELECT max(c_acctbal) FROM customer), 9) AS share FROM customer")
def a26_share_of_maximum(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    top = F.broadcast(c.agg(F.max("c_acctbal").alias("top")))
    return c.join(top).select("c_custkey", F.round(F.col("c_acctbal") / F.col("top"), 9).alias("share"))


@query("""SELECT event_id, value * value AS i2, value * (event_id % 30) AS it, CAST(user_id % 3 = 0 AS INT) AS zone_1, CAST(user_id % 3 = 1 AS INT) AS zone_2, CAST(user_id % 3 = 2 AS INT) AS zone_3 FROM events WHERE hour(ts) BETWEEN 4 AND 19""")
def f12_solar_features(spark, sf_dir):
    """Squares and products of weather values with a zone's one-hot code; night hours are left out."""
    e = table(spark, sf_dir, "events").where(F.hour("ts").between(4, 19))
    zone = [(F.col("user_id") % 3 == k).cast("int").alias(f"zone_{k + 1}") for k in range(3)]
    return e.select("event_id", (F.col("value") * F.col("value")).alias("i2"), (F.col("value") * (F.col("event_id") % 30)).alias("it"), *zone)


@query(with_tables("slots") + """, c AS (SELECT profile_id, cluster, CAST(slot // 8 AS INT) AS k, sum(value) AS v FROM slots GROUP BY 1, 2, 3), r AS (SELECT a.cluster, a.k AS i, b.k AS j, corr(a.v, b.v) AS r FROM c a JOIN c b ON a.profile_id = b.profile_id AND a.k < b.k GROUP BY 1, 2, 3)
SELECT i, j, round(avg(r), 6) AS mean, round(avg(abs(r)), 6) AS mean_abs FROM r GROUP BY 1, 2""")
def a22_mean_correlation(spark, sf_dir):
    """Slot correlations of each cluster, averaged over clusters."""
    c = profiles(spark, sf_dir).select("profile_id", "cluster", F.posexplode(fold(F.col("vals"), 8)).alias("i", "x"))
    b = c.select("profile_id", F.col("i").alias("j"), F.col("x").alias("y"))
    r = c.join(b, "profile_id").where("i < j").groupBy("cluster", "i", "j").agg(F.corr("x", "y").alias("r"))
    return r.groupBy("i", "j").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg(F.abs("r")), 6).alias("mean_abs"))


@query(with_tables("readings", "meters") + "SELECT CAST(fold AS INT) AS fold, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT meter_id, CAST(('0x' || substr(md5('fold:' || meter_id), 1, 8)) AS BIGINT) % 5 AS fold, avg(value) AS m FROM readings GROUP BY 1, 2) GROUP BY 1")
def a16_fold_statistics(spark, sf_dir):
    from loadscape.operators.samplers import fold_of

    m = readings(spark, sf_dir).groupBy("meter_id").agg(F.avg("value").alias("m")).withColumn("fold", fold_of(F.col("meter_id"), "fold", 5))
    return m.groupBy("fold").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


@query(with_tables("meters") + "SELECT location_id, count(*) AS n, max(yearly) AS hi, round(sum(yearly), 2) AS total, min(meter_id) AS first FROM meters GROUP BY 1")
def a2_master_by_location(spark, sf_dir):
    return meters(spark, sf_dir).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.max("yearly").alias("hi"), F.round(F.sum("yearly"), 2).alias("total"), F.min("meter_id").alias("first"))


@query(with_tables("readings") + "SELECT date_trunc('hour', ts) AS ts, round(avg(value) + 1e-9, 5) AS mean FROM readings GROUP BY 1")
def a3_mean_over_meters(spark, sf_dir):
    return readings(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("value") + 1e-9, 5).alias("mean"))


@query(with_tables("readings") + "SELECT meter_id, round(v, 6) AS v FROM (SELECT meter_id, arg_min(value, row_id) AS v FROM readings GROUP BY 1)")
def o2_first_row_per_meter(spark, sf_dir):
    w = Window.partitionBy("meter_id").orderBy("row_id")
    return readings(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("meter_id", F.round("value", 6).alias("v"))


@query()
def d13_direction_similarity(spark, sf_dir):
    """Principal directions of each query profile (ids divisible by 20) against those of all other profiles."""
    p = matching.principal_directions(profiles(spark, sf_dir), "vals", 8, 2, "v").select("profile_id", F.flatten("v").alias("v"))
    return blocks.with_queries(p, p.where("profile_id % 20 = 0"), "profile_id", "v", blocks.shared_directions(8, 2)).withColumnRenamed("d", "similarity")


@query()
def c9_power_iteration(spark, sf_dir):
    return models.power_iteration_within(profiles(spark, sf_dir), "cluster", "profile_id", "vals", 3, 1.0)


@query()
def m15_validated_tree(spark, sf_dir):
    """Clusters predicted from the means of the profile's quarters, by the tree depth that does best on held-out rows."""
    from loadscape.operators.samplers import fold_of

    p = profiles(spark, sf_dir).withColumn("q", fold(F.col("vals"), 16)).withColumn("fold", fold_of(F.col("profile_id"), "tree", 5))
    p = p.select("profile_id", F.col("cluster").cast("double").alias("y"), "fold", *[F.col("q")[i].alias(f"x{i}") for i in range(4)])
    info = [f"x{i}" for i in range(4)]
    model, loss = models.validated_tree(p.where("fold > 0"), p.where("fold = 0"), info, "y", [2, 4, 6])
    return spark.createDataFrame([(model.depth, loss)], "depth int, log_loss double")


@query()
def m15_pruned_tree(spark, sf_dir):
    """The weakest-link subtrees of a tree of clusters by the means of the profile's quarters, judged on held-out rows."""
    from loadscape.operators.samplers import fold_of

    p = profiles(spark, sf_dir).withColumn("q", fold(F.col("vals"), 16)).withColumn("fold", fold_of(F.col("profile_id"), "tree", 5))
    info = [f"x{i}" for i in range(4)]
    p = p.select("profile_id", F.col("cluster").cast("double").alias("y"), "fold", *[F.col("q")[i].alias(c) for i, c in enumerate(info)])
    _, _, steps, best = models.pruned_tree(p.where("fold > 0"), p.where("fold = 0"), info, "y")
    return spark.createDataFrame([(alpha, n, loss, i == best) for i, (alpha, n, loss, _) in enumerate(steps)], "alpha double, leaves int, log_loss double, chosen boolean")
