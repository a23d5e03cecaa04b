"""Queries on profile distances and clusterings."""

from pyspark.sql import functions as F

from loadscape.functions import features as feat
from loadscape.operators import clustering, distance
from loadscape.plans.registry import query
from loadscape.sources.tables import profiles, slots, with_tables

_PAIRS = with_tables("profiles") + """, pairs AS (SELECT a.cluster, a.profile_id AS i, b.profile_id AS j, sqrt(list_sum(list_transform(list_zip(a.vals, b.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
FROM profiles a JOIN profiles b ON a.cluster = b.cluster AND a.profile_id < b.profile_id), sym AS (SELECT cluster, i, j, d FROM pairs UNION ALL SELECT cluster, j, i, d FROM pairs)"""


def _pairs(spark, sf_dir, d=distance.euclidean, places=None, grouped=True):
    return distance.pairs_within(profiles(spark, sf_dir), "cluster", "profile_id", "vals", d, places, grouped)


@query(_PAIRS + "SELECT cluster, i, j, round(d, 6) AS d FROM pairs")
def j15_distances_within_clusters(spark, sf_dir):
    """The lower triangle of every cluster's distance matrix."""
    return _pairs(spark, sf_dir, places=6).select("cluster", "i", "j", "d")


@query(with_tables("profiles") + """
SELECT q.profile_id AS query, p.profile_id AS other, row_number() OVER (PARTITION BY q.profile_id ORDER BY list_sum(list_transform(list_zip(q.vals, p.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), p.profile_id) AS rank
FROM profiles q JOIN profiles p ON p.profile_id <> q.profile_id WHERE q.profile_id % 20 = 0 QUALIFY rank <= 5""")
def j13_nearest_profiles(spark, sf_dir):
    """The five nearest of all profiles to each query profile (ids divisible by 20)."""
    p = profiles(spark, sf_dir)
    return distance.nearest_to_queries(p, p.where("profile_id % 20 = 0"), "profile_id", "vals", distance.squared, 5).select("query", "other", "rank")


@query(with_tables("profiles") + """, m AS (SELECT profile_id, cluster, list_transform(vals, lambda x: CASE WHEN x > 0.25 THEN NULL ELSE x END) AS v FROM profiles)
SELECT a.profile_id AS i, b.profile_id AS j, round(list_avg(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM m a JOIN m b ON a.cluster = b.cluster AND a.profile_id < b.profile_id""")
def d2_missing_aware_distance(spark, sf_dir):
    """Mean squared difference over slots that both profiles have; large values are taken as missing."""
    p = profiles(spark, sf_dir).withColumn("vals", F.transform("vals", lambda x: F.when(x <= 0.25, x)))
    return distance.pairs_within(p, "cluster", "profile_id", "vals", distance.missing_aware, 6, grouped=False)


@query(with_tables("profiles") + """
SELECT a.profile_id AS i, b.profile_id AS j, round(list_avg(list_transform(list_zip(list_sort(a.vals), list_sort(b.vals)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 8) AS d FROM profiles a JOIN profiles b ON a.cluster = b.cluster AND a.profile_id < b.profile_id""")
def d9_wasserstein(spark, sf_dir):
    return _pairs(spark, sf_dir, distance.wasserstein_1d, 8, grouped=False)


@query()
def d4_dynamic_time_warping(spark, sf_dir):
    """Banded DTW between each query profile (ids divisible by 20) and all other profiles."""
    p = profiles(spark, sf_dir)
    return distance.pairs_with_queries(p, p.where("profile_id % 20 = 0"), "profile_id", "vals", distance.warping)


@query(_PAIRS + """, sums AS (SELECT cluster, i, round(sum(d), 6) AS total FROM sym GROUP BY 1, 2)
SELECT cluster, i AS medoid, total FROM sums QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY total, i) = 1""")
def c7_medoids(spark, sf_dir):
    return distance.medoids_within(profiles(spark, sf_dir), "cluster", "profile_id", "vals", distance.euclidean)


_MARKS = with_tables("profiles") + """, marks AS (SELECT cluster, profile_id, vals FROM profiles QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5('mark:' || profile_id), profile_id) <= 50),
near AS (SELECT p.cluster, p.profile_id AS i, m.profile_id AS j, sqrt(list_sum(list_transform(list_zip(p.vals, m.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM profiles p JOIN marks m ON p.cluster = m.cluster AND p.profile_id <> m.profile_id)"""


def _near_landmarks(spark, sf_dir):
    p = profiles(spark, sf_dir)
    return distance.pairs_with_landmarks(p, distance.landmarks(p, "cluster", "profile_id", 50, "mark"), "cluster", "profile_id", "vals", distance.euclidean)


@query(_MARKS + """, sums AS (SELECT cluster, j, round(sum(d), 6) AS total FROM near GROUP BY 1, 2)
SELECT cluster, j AS medoid, total FROM sums QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY total, j) = 1""")
def c7_landmark_medoids(spark, sf_dir):
    """The best of fifty candidates of each cluster, judged by all its members."""
    return distance.landmark_medoids(_near_landmarks(spark, sf_dir), "cluster")


@query(with_tables("profiles", "slots") + """, c AS (SELECT cluster AS k, slot, avg(value) AS m FROM slots GROUP BY 1, 2), d AS (SELECT profile_id AS id, cluster AS own, k, sqrt(sum((value - m) * (value - m))) AS d FROM slots JOIN c USING (slot) GROUP BY 1, 2, 3),
ab AS (SELECT id, max(d) FILTER (own = k) AS a, min(d) FILTER (own <> k) AS b FROM d GROUP BY 1) SELECT id, round((b - a) / greatest(a, b), 6) AS s FROM ab""")
def c11_centroid_silhouette(spark, sf_dir):
    """Silhouette from distances to cluster centroids, so the work grows with profiles times clusters."""
    s = slots(spark, sf_dir)
    c = F.broadcast(s.groupBy(F.col("cluster").alias("k"), "slot").agg(F.avg("value").alias("m")))
    d = s.join(c, "slot").groupBy(F.col("profile_id").alias("id"), F.col("cluster").alias("own"), F.col("k").alias("cluster")).agg(F.sqrt(F.sum((F.col("value") - F.col("m")) * (F.col("value") - F.col("m")))).alias("d"))
    return clustering.silhouette(d).select("id", F.round("s", 6).alias("s"))


@query()
def c11_silhouette_search(spark, sf_dir):
    """Mean silhouettes of k-means for two to eight clusters of all profiles, the best marked."""
    return clustering.silhouette_search(profiles(spark, sf_dir), "vals", range(2, 9)).select("k", F.round("silhouette", 6).alias("silhouette"), "chosen")


@query(_PAIRS + """, r AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY cluster, i ORDER BY d, j) <= 5), kd AS (SELECT i, max(d) AS kd FROM r GROUP BY 1),
lrd AS (SELECT r.i, 1 / avg(greatest(d, kd)) AS lrd FROM r JOIN kd ON kd.i = r.j GROUP BY 1)
SELECT r.cluster, r.i, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM r JOIN lrd b ON b.i = r.j JOIN lrd a ON a.i = r.i GROUP BY 1, 2""")
def c12_local_outlier_factor(spark, sf_dir):
    return clustering.local_outlier_factors(profiles(spark, sf_dir), "cluster", "profile_id", "vals", 5).select("cluster", "i", F.round("lof", 6).alias("lof"))


@query(_MARKS + """, r AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY cluster, i ORDER BY d, j) <= 5), kd AS (SELECT cluster, i, max(d) AS kd FROM r GROUP BY 1, 2),
lrd AS (SELECT r.cluster, r.i, 1 / greatest(avg(greatest(d, kd)), 1e-10) AS lrd FROM r JOIN kd ON kd.i = r.j AND kd.cluster = r.cluster GROUP BY 1, 2)
SELECT r.cluster, r.i, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM r JOIN lrd b ON b.i = r.j AND b.cluster = r.cluster JOIN lrd a ON a.i = r.i AND a.cluster = r.cluster GROUP BY 1, 2""")
def c12_landmark_outlier_factor(spark, sf_dir):
    """Every profile's outlier factor among fifty landmarks of its cluster."""
    return clustering.outlier_factors(_near_landmarks(spark, sf_dir), "cluster", 5).select("cluster", "i", F.round("lof", 6).alias("lof"))


@query("""WITH l AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM l),
i AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM l GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM l GROUP BY b))
SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 9) AS ari FROM ij, i, j""")
def c15_adjusted_rand(spark, sf_dir):
    p = profiles(spark, sf_dir).withColumn("other", F.col("profile_id") % 10)
    return clustering.adjusted_rand(p, "cluster", "other").select(F.round("ari", 9).alias("ari"))


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def c16_cluster_sizes(spark, sf_dir):
    return profiles(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id AS profile_id, CASE WHEN n < (SELECT avg(n) FROM n) THEN -1 ELSE label END AS kept FROM embeddings JOIN n USING (label)""")
def c14_mark_small_clusters(spark, sf_dir):
    """Clusters below the mean size become outliers."""
    p = profiles(spark, sf_dir).select("profile_id", "cluster")
    least = p.groupBy("cluster").count().agg(F.avg("count")).first()[0]
    return clustering.mark_small(p, "cluster", least, "kept").select("profile_id", "kept")


@query()
def c5_knee(spark, sf_dir):
    """The knee of k-means fitted to the profiles for every k, the best of two starts each."""
    curve = clustering.inertias(profiles(spark, sf_dir), "vals", [2, 4, 6, 8, 10, 12, 16])
    return clustering.knee(curve, "k", "inertia").select("k", F.round("gap", 6).alias("gap"))


@query()
def c1_kmeans(spark, sf_dir):
    return clustering.kmeans(profiles(spark, sf_dir), "vals", 10).select("profile_id", "kmeans")


@query(with_tables("profiles") + """
SELECT profile_id, round((list_max(vals) + list_min(vals)) / 2, 6) AS middle, round((list_max(vals) - list_min(vals)) / 2, 6) AS half_range,
  round(list_sum(list_transform(vals, lambda x: (x - list_min(vals)) / (list_max(vals) - list_min(vals) + 1e-4) * 2 - 1)), 5) AS scaled_sum FROM profiles""")
def f19_normalise_profiles(spark, sf_dir):
    found = feat.normalise_profile(F.col("vals"))
    total = F.aggregate(found["scaled"], F.lit(0.0), lambda a, x: a + x)
    return profiles(spark, sf_dir).select("profile_id", F.round(found["middle"], 6).alias("middle"), F.round(found["half_range"], 6).alias("half_range"), F.round(total, 5).alias("scaled_sum"))


@query("SELECT c_custkey, array_to_string(list_transform(range(1, 11), lambda i: CAST(i <= c_custkey % 11 AS INT)), '') AS flags FROM customer")
def f20_generation_flags(spark, sf_dir):
    from loadscape.sources.tables import table

    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(feat.generation_flags((F.col("c_custkey") % 11).cast("int"), 10).cast("array<string>"), "").alias("flags"))
