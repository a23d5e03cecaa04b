"""Metrics, samplers and clusterings by name, and a preprocessing made of named steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.operators import cleaning, clustering, distance, matching

Metric = Callable[[Column, Column], Column]
METRICS: dict[str, Metric] = {
    "euclidean": distance.euclidean,
    "squared": distance.squared,
    "missing_aware": distance.missing_aware,
    "wasserstein": distance.wasserstein_1d,
    "warping": distance.warping,
}


def nearest_by(df: DataFrame, queries: DataFrame, key: str, vals: str, metric: str, k: int) -> DataFrame:
    """(query, other, d, rank): the k nearest of all rows to each query by a metric of METRICS."""
    return distance.nearest_to_queries(df, queries, key, vals, METRICS[metric], k)


@dataclass(frozen=True)
class Fitted:
    """labels: (key, cluster). centers: (cluster, center)."""

    labels: DataFrame
    centers: DataFrame


def _kmeans(df: DataFrame, key: str, vals: str, k: int) -> Fitted:
    labels = clustering.kmeans(df.select(key, vals), vals, k).withColumnRenamed("kmeans", "cluster")
    slots = labels.select("cluster", F.posexplode(vals).alias("slot", "x")).groupBy("cluster", "slot").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "x")))
    return Fitted(labels.select(key, "cluster"), slots.groupBy("cluster").agg(F.transform(ordered, lambda s: s["x"]).alias("center")))


def _k_medoids(df: DataFrame, key: str, vals: str, k: int) -> Fitted:
    labels = matching.k_medoids(df.select(key, vals).withColumn("_g", F.lit(0)), "_g", key, vals, k).select(key, F.col("medoid").alias("cluster"))
    centers = labels.select("cluster").distinct().join(df.select(F.col(key).alias("cluster"), F.col(vals).alias("center")), "cluster")
    return Fitted(labels, centers)


ESTIMATORS: dict[str, Callable[[DataFrame, str, str, int], Fitted]] = {"kmeans": _kmeans, "k_medoids": _k_medoids}


@dataclass(frozen=True)
class Preprocessing:
    """Steps on readings (key, value, ...), set one by one; ``apply`` runs those that are set, in this order."""

    key: str
    value: str
    clipped: bool = False
    most: float | None = None
    share_of_total: bool = False

    def clip(self) -> Preprocessing:
        """Negative values become 0."""
        return replace(self, clipped=True)

    def at_most(self, total: float) -> Preprocessing:
        """Keys whose values sum to more go."""
        return replace(self, most=total)

    def as_share(self) -> Preprocessing:
        """Values become shares of their key's total."""
        return replace(self, share_of_total=True)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.clipped:
            df = df.withColumn(self.value, cleaning.clip_negative(F.col(self.value)))
        if self.most is not None:
            df = cleaning.drop_over(df, df.groupBy(self.key).agg(F.sum(self.value).alias("_total")), self.key, "_total", self.most)
        if self.share_of_total:
            total = df.groupBy(self.key).agg(F.sum(self.value).alias("_total"))
            df = df.join(total, self.key).withColumn(self.value, F.try_divide(F.col(self.value), F.col("_total"))).drop("_total")
        return df
