"""Clusterings: sizes, medoids, silhouettes, agreement, elbows, outliers, and MLlib's k-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators import blocks
from loadscape.operators.distance import both_ways

#: Least mean distance to neighbours, so that copies have a density.
LEAST_REACH = 1e-10


def kmeans(df: DataFrame, vals: str, k: int, seed: int = 1) -> DataFrame:
    """``df`` with a cluster number from 0."""
    vectors = df.withColumn("_v", array_to_vector(vals))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="kmeans").fit(vectors)
    return model.transform(vectors).drop("_v")


def inertias(df: DataFrame, vals: str, ks: Sequence[int], repeats: int = 2, seed: int = 1) -> DataFrame:
    """(k, inertia): k-means fitted for every k, the best of ``repeats`` starts by sum of squared distances to the centres.

    No k above the number of rows is tried. One row a k reaches the driver; the fits are distributed.
    """
    vectors = df.select(array_to_vector(vals).alias("_v")).persist()
    n, found = vectors.count(), []
    for k in (k for k in ks if k <= n):
        if k == 1:
            spread = vectors.agg(Summarizer.variance(F.col("_v")).alias("s")).first().s
            found.append((1, float(sum(spread) * (n - 1))))
            continue
        fits = (KMeans(k=k, seed=seed + r, featuresCol="_v", initSteps=2, maxIter=20).fit(vectors) for r in range(repeats))
        found.append((k, min(float(m.summary.trainingCost) for m in fits)))
    vectors.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, inertia double")


def silhouette_search(df: DataFrame, vals: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """(k, silhouette, chosen): k-means for every k from 2, the mean silhouette over squared distances, the best k chosen.

    The mean distance of a row to a cluster follows from the cluster's sums, so no pairs are made. Ties go to the smaller k;
    no k above the number of different rows is tried. One row a k reaches the driver.
    """
    vectors = df.where(F.col(vals).isNotNull()).select(array_to_vector(vals).alias("features"))
    most = vectors.select(vector_to_array("features").alias("x")).distinct().count()
    found = []
    for k in sorted({k for k in ks if 2 <= k <= most}):
        fitted = KMeans(k=k, seed=seed).fit(vectors).transform(vectors)
        found.append((k, float(ClusteringEvaluator(metricName="silhouette").evaluate(fitted))))
    best = max(found, key=lambda x: (x[1], -x[0]))[0] if found else None
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in found], "k int, silhouette double, chosen boolean")


def standardised(df: DataFrame, col: str) -> DataFrame:
    """A short curve's column less its mean over its population deviation."""
    s = F.broadcast(df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s")))
    return df.join(s).withColumn(col, F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def silhouette(means: DataFrame) -> DataFrame:
    """(id, s) from means (id, own, cluster, d): the mean distance of each member to each cluster, its own without itself."""
    a, b = F.max(F.when(F.col("own") == F.col("cluster"), F.col("d"))), F.min(F.when(F.col("own") != F.col("cluster"), F.col("d")))
    return means.groupBy("id").agg(a.alias("a"), b.alias("b")).select("id", ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("t"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("i"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("j"))
    all_ = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("i") * F.col("j") / all_
    return both.join(rows).join(cols).select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def knee(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, gap) of the knee of a convex decreasing curve: where the normalised curve lies furthest below its chord."""
    w = Window.partitionBy(F.lit(0))
    nx = (F.col(x) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w))
    ny = (F.col(y) - F.min(y).over(w)) / (F.max(y).over(w) - F.min(y).over(w))
    gaps = df.select(x, (1 - ny - nx).alias("gap"))
    return gaps.orderBy(F.desc("gap"), x).limit(1)


def mark_small(df: DataFrame, label: str, least: int, out: str) -> DataFrame:
    """Members of clusters of fewer than ``least`` are outliers (-1). Sizes are joined, so a large cluster stays spread."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, label).withColumn(out, F.when(F.col("_n") < least, -1).otherwise(F.col(label))).drop("_n")


def local_outlier_factor(pairs: DataFrame, group: str, k: int) -> DataFrame:
    """(group, i, lof) from all pairs within groups: neighbours' density over the member's own, by k-th distances."""
    return outlier_factors(both_ways(pairs, group), group, k)


def local_outlier_factors(df: DataFrame, group: str, key: str, vals: str, k: int) -> DataFrame:
    """As ``local_outlier_factor`` by Euclidean distance; of all pairs, each two blocks keep a row's k nearest only."""
    return outlier_factors(blocks.within(df, group, key, vals, blocks.euclidean, k), group, k)


def outlier_factors(pairs: DataFrame, group: str, k: int) -> DataFrame:
    """(group, i, lof) from pairs (group, i, j, d) of each row with those that may be its neighbours, each of which is an i too.

    Neighbours that are all copies of a row lie LEAST_REACH away, so copies have factor 1.
    """
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(group, "i").orderBy(F.asc_nulls_last("d"), "j"))).where(F.col("_r") <= k)
    reach = ranked.groupBy(group, "i").agg(F.max("d").alias("kd"))
    named = reach.select(group, F.col("i").alias("j"), F.col("kd").alias("kd_j"))
    density = ranked.join(named, [group, "j"]).groupBy(group, "i").agg((1 / F.greatest(F.avg(F.greatest("d", "kd_j")), F.lit(LEAST_REACH))).alias("lrd"))
    near = density.select(group, F.col("i").alias("j"), F.col("lrd").alias("lrd_j"))
    return ranked.join(near, [group, "j"]).join(density, [group, "i"]).groupBy(group, "i").agg((F.avg("lrd_j") / F.first("lrd")).alias("lof"))


def chord_elbow(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, d): the point furthest from the line between the first and the last point of a curve."""
    ends = df.agg(F.min_by(F.struct(x, y), x).alias("a"), F.max_by(F.struct(x, y), x).alias("b"))
    x1, y1, x2, y2 = F.col("a")[x], F.col("a")[y], F.col("b")[x], F.col("b")[y]
    d = F.abs((y2 - y1) * F.col(x) - (x2 - x1) * F.col(y) + x2 * y1 - y2 * x1) / F.sqrt(F.pow(y2 - y1, F.lit(2)) + F.pow(x2 - x1, F.lit(2)))
    return df.join(F.broadcast(ends)).select(x, d.alias("d")).orderBy(F.desc("d"), x).limit(1)
