"""Queries on two-level samplers, draws, scenario generators, matching distances and k-medoids."""

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators import blocks, densities, generators, matching, samplers
from loadscape.operators.distance import meet
from loadscape.plans.registry import query
from loadscape.sources.tables import days, profiles, readings, slots, table, with_tables

_DRAW = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("""WITH train AS (SELECT c_custkey AS pick, c_mktsegment AS g, 1 + c_nationkey AS w FROM customer), t AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY pick) AS hi, sum(w) OVER (PARTITION BY g) AS total FROM train),
u AS (SELECT s_suppkey AS test, n.n, ['BUILDING', 'MACHINERY', 'AUTOMOBILE'][s_nationkey % 3 + 1] AS g, """ + _DRAW.format("'draw:' || s_suppkey || ':' || n.n") + """ AS u FROM supplier, (SELECT unnest(range(5)) AS n) n)
SELECT test, CAST(n AS INT) AS n, pick FROM u JOIN t ON u.g = t.g AND u.u * total >= hi - w AND u.u * total < hi""")
def o9_weighted_draws(spark, sf_dir):
    """Five draws with replacement per query from its group, by weight, decided by hash."""
    train = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pick"), F.col("c_mktsegment").alias("g"), (1 + F.col("c_nationkey")).alias("w"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("test"), F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "AUTOMOBILE"))), F.col("s_nationkey") % 3 + 1).alias("g"))
    return samplers.weighted_draws(q, train, "g", "w", 5, "draw")


@query(with_tables("profiles") + """, q AS (SELECT profile_id AS test, cluster FROM profiles WHERE profile_id % 20 = 0), yearly AS (SELECT test, c AS cluster, CASE WHEN c = cluster THEN 0.7::DOUBLE ELSE 0.3 END AS p FROM q, LATERAL (SELECT unnest([cluster, (cluster + 1) % 10]) AS c)),
daily AS (SELECT cluster, profile_id AS pick, 1 / CAST(count(*) OVER (PARTITION BY cluster, profile_id % 2) AS DOUBLE) AS p2, profile_id % 2 AS kind FROM profiles)
SELECT y.test, d.pick, round(y.p * d.p2, 9) AS p FROM yearly y JOIN daily d ON d.cluster = y.cluster AND d.kind = (y.test // 20) % 2""")
def m6_two_level_sampler(spark, sf_dir):
    """Cluster probabilities times each cluster's own distribution over members of the query's kind."""
    p = profiles(spark, sf_dir).withColumn("kind", F.col("profile_id") % 2)
    q = p.where("profile_id % 20 = 0").select(F.col("profile_id").alias("test"), (F.floor(F.col("profile_id") / 20) % 2).alias("kind"), "cluster")
    yearly = q.select("test", "kind", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(0.7).alias("p")), F.struct(((F.col("cluster") + 1) % 10).alias("c"), F.lit(0.3).alias("p")))).alias("x"))
    return samplers.two_level(yearly.select("test", "kind", F.col("x.c").alias("cluster"), F.col("x.p").alias("p")), p.select("cluster", "kind", F.col("profile_id").alias("pick")), "cluster", ["kind"]).select("test", "pick", F.round("p", 9).alias("p"))


@query("""WITH y AS (SELECT o_custkey AS test, year(o_orderdate) AS year, o_totalprice AS p FROM orders) SELECT test, year, p / sum(p) OVER (PARTITION BY test, year) / n AS p, n FROM (SELECT test, year, sum(p) AS p, count(*) OVER (PARTITION BY test) AS n FROM y GROUP BY 1, 2)""")
def m8_renormalise_years(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("test"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("p"))
    n = F.count(F.lit(1)).over(Window.partitionBy("test"))
    return y.withColumn("n", n).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("test", "year")) / F.col("n"))


@query(with_tables("days") + """, t AS (SELECT date, year(date) AS y, dayofyear(date) % 40 AS t FROM days),
c AS (SELECT q.date AS test, p.date AS pick, abs(q.t - p.t) AS d FROM t q JOIN t p ON p.y <> q.y WHERE dayofyear(q.date) % 20 = 0)
SELECT test, pick FROM c QUALIFY row_number() OVER (PARTITION BY test ORDER BY d, pick) <= 5""")
def j14_similar_days(spark, sf_dir):
    """The five days of all other years nearest in temperature to each query day (days of the year divisible by 20)."""
    t = days(spark, sf_dir).select("date", F.year("date").alias("y"), (F.dayofyear("date") % 40).alias("t"))
    q = t.where(F.dayofyear("date") % 20 == 0).select(F.col("date").alias("test"), F.col("y").alias("yq"), F.col("t").alias("tq"))
    c = meet(t.withColumnRenamed("date", "pick"), q).where("y <> yq").withColumn("d", F.abs(F.col("t") - F.col("tq")))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("test").orderBy("d", "pick"))).where("k <= 5").select("test", "pick")


@query("""SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def j10_left_with_other_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query(with_tables("profiles") + """, pairs AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM profiles) AS i, l_partkey % (SELECT count(*) FROM profiles) AS j FROM lineitem)
SELECT i, j, round(sqrt(list_sum(list_transform(list_zip(a.vals, b.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d FROM pairs JOIN profiles a ON a.profile_id = i JOIN profiles b ON b.profile_id = j WHERE i <> j""")
def j16_listed_pairs(spark, sf_dir):
    """Distances of listed pairs only; a profile goes to a block of others once with all its pairs there."""
    p = profiles(spark, sf_dir)
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    pairs = table(spark, sf_dir, "lineitem").join(n).select((F.col("l_orderkey") % F.col("n")).alias("i"), (F.col("l_partkey") % F.col("n")).alias("j")).distinct().where("i <> j")
    return blocks.listed(pairs, p, "profile_id", "vals").select("i", "j", F.round("d", 6).alias("d"))


@query(with_tables("slots") + """, d AS (SELECT profile_id, cluster, slot // 16 AS day, slot % 16 AS k, value FROM slots), q AS (SELECT * FROM d WHERE profile_id % 20 = 0),
c AS (SELECT q.profile_id AS query, d.profile_id AS other, d.day, sqrt(sum((q.value - d.value) * (q.value - d.value))) AS c FROM q JOIN d ON q.day = d.day AND q.k = d.k AND q.profile_id <> d.profile_id WHERE d.day >= 1 GROUP BY 1, 2, 3)
SELECT query, other, round(sum(c), 6) AS d FROM c GROUP BY 1, 2""")
def d8_one_to_one_days(spark, sf_dir):
    """Days matched by ordinal, the first left out as in the source, summed; queries (ids divisible by 20) against all."""
    p = profiles(spark, sf_dir)
    return matching.one_to_one(p.where("profile_id % 20 = 0"), p, "profile_id", "vals", 16, places=6)


_MATCHINGS = ", ".join(" + ".join(f"max(c) FILTER (i = {i} AND j = {j})" for i, j in enumerate(p)) for p in permutations(range(4)))


@query(with_tables("slots") + """, d AS (SELECT profile_id, slot // 16 AS day, slot % 16 AS k, value FROM slots),
c AS (SELECT q.profile_id AS query, d.profile_id AS other, q.day AS i, d.day AS j, sqrt(sum((q.value - d.value) * (q.value - d.value))) AS c FROM d q JOIN d ON q.k = d.k AND q.profile_id <> d.profile_id WHERE q.profile_id % 20 = 0 GROUP BY 1, 2, 3, 4)
SELECT query, other, round(least(""" + _MATCHINGS + """), 6) AS d FROM c GROUP BY 1, 2""")
def d6_assigned_days(spark, sf_dir):
    """Days matched at least total cost, of query profiles (ids divisible by 20) with all others, batches of pairs at once."""
    p = profiles(spark, sf_dir)
    return matching.assigned(p.where("profile_id % 20 = 0"), p, "profile_id", "vals", 16, places=6)


@query(with_tables("slots") + """, d AS (SELECT profile_id, slot // 16 AS day, slot % 16 AS k, value FROM slots),
c AS (SELECT q.profile_id AS query, d.profile_id AS other, q.day AS i, d.day AS j, sqrt(sum((q.value - d.value) * (q.value - d.value))) AS c FROM d q JOIN d ON q.k = d.k AND q.profile_id <> d.profile_id WHERE q.profile_id % 20 = 0 GROUP BY 1, 2, 3, 4)
SELECT query, other, round(365 / 4::DOUBLE * least(""" + _MATCHINGS + """), 6) AS d FROM c GROUP BY 1, 2""")
def d6_assigned_days_of_a_year(spark, sf_dir):
    """The same scaled to a year: times 365 over the days of the profile that has fewer."""
    p = profiles(spark, sf_dir)
    return matching.assigned(p.where("profile_id % 20 = 0"), p, "profile_id", "vals", 16, year=365.0, places=6)


@query(with_tables("slots") + """, e AS (SELECT min(value) AS a, max(value) AS b FROM slots), h AS (SELECT cluster, least(CAST(floor((value - a) / (b - a) * 10) AS INT), 9) AS bin, count(*) AS n FROM slots, e GROUP BY 1, 2),
s AS (SELECT c.cluster, b.bin, coalesce(h.n, 0) / CAST(sum(coalesce(h.n, 0)) OVER (PARTITION BY c.cluster) AS DOUBLE) AS w FROM (SELECT DISTINCT cluster FROM slots) c CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS bin) b LEFT JOIN h ON h.cluster = c.cluster AND h.bin = b.bin),
f AS (SELECT cluster, bin, sum(w) OVER (PARTITION BY cluster ORDER BY bin) AS f FROM s)
SELECT x.cluster AS i, y.cluster AS j, round(sum(abs(x.f - y.f)) + 1e-9, 6) AS emd FROM f x JOIN f y ON x.bin = y.bin AND x.cluster < y.cluster GROUP BY 1, 2""")
def d10_histogram_emd(spark, sf_dir):
    """Earth mover's distance between the clusters' histograms of ten bins: the gap of their running sums."""
    return matching.histogram_emd(slots(spark, sf_dir), "cluster", "value", 10).select("i", "j", F.round(F.col("emd") + 1e-9, 6).alias("emd"))


@query()
def c2_k_medoids(spark, sf_dir):
    """Three medoids within each cluster, chosen on a bounded sample by alternating assignment and update; all rows are assigned."""
    return matching.k_medoids(profiles(spark, sf_dir), "cluster", "profile_id", "vals", 3)


@query(with_tables("profiles") + """, n AS (SELECT cluster, count(*) AS n FROM profiles GROUP BY 1), r AS (SELECT cluster, profile_id, row_number() OVER (PARTITION BY cluster ORDER BY profile_id) - 1 AS k FROM profiles)
SELECT cluster AS day, CAST(s AS INT) AS s, profile_id AS pick FROM (SELECT cluster, n, s, CAST(floor(n * """ + _DRAW.format("'rand:' || cluster || ':' || s") + """) AS BIGINT) AS k FROM n, (SELECT unnest(range(20)) AS s)) JOIN r USING (cluster, k)""")
def h1_random_scenarios(spark, sf_dir):
    """Twenty profiles of each cluster, drawn with replacement by hash."""
    return generators.random_scenarios(profiles(spark, sf_dir), "cluster", "profile_id", 20, "rand")


@query()
def h2_gaussian_copula(spark, sf_dir):
    """A hundred scenarios of 16 folded slots with the training correlation and marginals."""
    from loadscape.functions.features import fold

    return generators.gaussian_copula(profiles(spark, sf_dir).select(fold(F.col("vals"), 4).alias("vals")), "vals", 16, 100, seed=1)


@query("SELECT CAST(k AS BIGINT) AS i, round(cos(k * 0.01) * (1 + k % 3), 9) AS x, round(sin(k * 0.01) * (1 + k % 3), 9) AS y FROM (SELECT unnest(range(3000)) AS k)")
def s24_toy_rings(spark, sf_dir):
    return generators.rings(spark, 3000, 3).select("i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(with_tables("slots") + "SELECT cluster, slot, round(greatest(least(max(value), 0.4), 0.0), 6) AS value FROM slots WHERE slot >= 8 GROUP BY 1, 2 UNION ALL SELECT DISTINCT cluster, slot, 0.0 FROM slots WHERE slot < 8")
def f26_clip_and_pad(spark, sf_dir):
    """Scenario values clipped to [0, 0.4]; slots that were removed come back as 0."""
    s = slots(spark, sf_dir)
    made = s.where("slot >= 8").groupBy("cluster", "slot").agg(F.max("value").alias("value"))
    return generators.clip_and_pad(made, s.select("cluster").distinct(), "cluster", 64, 0.4).select("cluster", "slot", F.round("value", 6).alias("value"))


@query(with_tables("readings") + """, h AS (SELECT meter_id, hour(ts) AS h, round(sum(value), 4) AS v FROM readings GROUP BY 1, 2) SELECT h AS hour, max(v) AS hi FROM h GROUP BY 1 HAVING max(v) > 0""")
def a27_active_hours(spark, sf_dir):
    h = readings(spark, sf_dir).groupBy("meter_id", F.hour("ts").alias("hour")).agg(F.round(F.sum("value"), 4).alias("v"))
    return h.groupBy("hour").agg(F.max("v").alias("hi")).where("hi > 0")


@query("""SELECT o_custkey, isodow(o_orderdate) >= 6 AS weekend, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE month(o_orderdate) IN (1, 2, 12) GROUP BY 1, 2""")
def a31_winter_day_kinds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.month("o_orderdate").isin(1, 2, 12))
    return o.groupBy("o_custkey", (F.weekday("o_orderdate") >= 5).alias("weekend")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(with_tables("readings") + """, w AS (SELECT meter_id, weekofyear(ts) AS week, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INT) AS slot, sum(value) AS v FROM readings GROUP BY 1, 2, 3)
SELECT meter_id, week, array_to_string(list(slot ORDER BY slot), ',') AS slots, round(sum(v), 4) AS total FROM w GROUP BY 1, 2 HAVING count(*) >= 10""")
def o24_week_arrays(spark, sf_dir):
    """Weeks as arrays of their slots; weeks with too few are dropped."""
    from loadscape.operators.reshape import to_array

    w = readings(spark, sf_dir).groupBy("meter_id", F.weekofyear("ts").alias("week"), (F.weekday("ts") * 24 + F.hour("ts")).alias("slot")).agg(F.sum("value").alias("v"))
    a = to_array(w, ["meter_id", "week"], "slot", "v", "vals").where(F.size("vals") >= 10)
    s = to_array(w.withColumn("k", F.col("slot").cast("string")), ["meter_id", "week"], "slot", "k", "names")
    return a.join(s, ["meter_id", "week"]).select("meter_id", "week", F.array_join("names", ",").alias("slots"), F.round(F.aggregate("vals", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o, round((coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0) + coalesce(avg(l_quantity) FILTER (l_linestatus = 'O'), 0)) / (count(DISTINCT l_linestatus)), 6) AS average FROM lineitem GROUP BY 1")
def o17_unstack_with_average(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    known = F.filter(F.array("F", "O"), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return wide.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"), F.round(mean, 6).alias("average"))


def _u(k):
    return f"(CAST(('0x' || substr(md5('toy:0:' || i || ':{k}'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


def _g(k):
    return f"(sqrt(-2 * ln(1 - {_u(k)})) * cos(2 * pi() * {_u(k + 1)}))"


_TOY = {
    "1normal": (f"2 + 0.5 * {_g(0)}",),
    "4gaussians": tuple(f"[{', '.join(str(c[k]) for c in densities.FOUR)}][CAST(floor({_u(0)} * 4) AS INT) + 1] + 0.75 * {_g(1 + 2 * k)}" for k in (0, 1)),
    "checkerboard": (f"2 * ({_u(0)} * 4 - 2)", f"2 * ({_u(1)} - 2 * floor(2 * {_u(2)}) + (floor({_u(0)} * 4 - 2) + 4) % 2)"),
    "cos": (f"{_u(0)} * 6 - 3", f"sin(({_u(0)} * 6 - 3) * 5) * 2.5 + 0.3 * {_g(1)}"),
    "line-noisy": (f"{_u(0)} * 5 - 2.5", f"{_u(0)} * 5 - 2.5 + {_g(1)}"),
    "moons": (
        f"2 * (CASE WHEN {_u(1)} < 0.5 THEN cos(pi() * {_u(0)}) ELSE 1 - cos(pi() * {_u(0)}) END + 0.1 * {_g(2)}) - 1",
        f"2 * (CASE WHEN {_u(1)} < 0.5 THEN sin(pi() * {_u(0)}) ELSE 0.5 - sin(pi() * {_u(0)}) END + 0.1 * {_g(4)}) - 0.2",
    ),
}


@query("WITH ids AS (SELECT unnest(range(500)) AS i) " + " UNION ALL ".join(f"SELECT '{name}' AS density, i, {k} AS k, round({x}, 6) AS value FROM ids" for name, xs in _TOY.items() for k, x in enumerate(xs)))
def s24_toy_densities(spark, sf_dir):
    """Five hundred points of each of six densities, one row a coordinate."""
    made = [densities.points(spark, name, 500).select(F.lit(name).alias("density"), "i", F.posexplode("point").alias("k", "value")) for name in _TOY]
    return reduce(DataFrame.unionByName, made).select("density", "i", "k", F.round("value", 6).alias("value"))
