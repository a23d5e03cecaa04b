"""Scenario generators: random days, a Gaussian copula, toy densities, and repairs of made scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.operators.counted import quantiles as exact_quantiles
from loadscape.operators.counted import running


def random_scenarios(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """(day, s, pick): n members of each group drawn with replacement, decided by hash. Members are numbered range by range."""
    members = running(df.select(F.col(group).alias("day"), F.col(key).alias("pick"), F.lit(1).alias("_one")), "pick", ["_one"], ["day"])
    members = members.select("day", "pick", F.col("_one_below").alias("k"))
    sizes = df.groupBy(F.col(group).alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.select("day", "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("day").cast("string"), F.lit(":"), F.col("s").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return draws.withColumn("k", F.floor(F.col("_n") * u)).join(members, ["day", "k"]).select("day", "s", "pick")


def gaussian_copula(df: DataFrame, vals: str, width: int, n: int, seed: int, levels: int = 101) -> DataFrame:
    """(s, slot, value): n scenarios with the slots' correlation and their marginals at ``levels`` quantiles.

    What reaches the driver is one correlation matrix and a table of quantiles, whatever the number of profiles.
    """
    x = [F.col(vals)[i] for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i)]
    found = df.agg(*[F.corr(x[i], x[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(width)
    for (i, j), c in zip(pairs, found):
        r[i, j] = r[j, i] = c or 0.0
    grid = np.linspace(0, 1, levels)
    long = df.select(F.posexplode(F.array(*x)).alias("slot", "value"))
    quantiles = np.zeros((width, levels))
    for slot, level, value in exact_quantiles(long, "value", grid.tolist(), ["slot"]).collect():
        quantiles[slot, round(level * (levels - 1))] = value
    values, vectors = np.linalg.eigh(r)
    root = vectors * np.sqrt(np.maximum(values, 0))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from math import erf, sqrt

        cdf = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))))
        for pdf in batches:
            z = np.array([np.random.default_rng((seed, s)).normal(size=width) for s in pdf["id"]]).reshape(-1, width) @ root.T
            u = cdf(z) if len(z) else z
            out = np.column_stack([np.interp(u[:, k], grid, quantiles[k]) for k in range(width)]) if len(z) else z
            yield pd.DataFrame({"s": np.repeat(pdf["id"].to_numpy(), width), "slot": np.tile(np.arange(width, dtype=np.int32), len(pdf)), "value": out.ravel()})

    return df.sparkSession.range(n).mapInPandas(make, "s bigint, slot int, value double")


def rings(spark: SparkSession, n: int, count: int) -> DataFrame:
    """(i, x, y): points on concentric rings."""
    i = F.col("id")
    radius = 1 + i % count
    return spark.range(n).select(i.alias("i"), (F.cos(i * 0.01) * radius).alias("x"), (F.sin(i * 0.01) * radius).alias("y"))


def clip_and_pad(df: DataFrame, keys: DataFrame, key: str, width: int, top: float) -> DataFrame:
    """Values clipped to [0, top], over every slot of every key; slots without a value are 0."""
    grid = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("slot"))
    value = F.greatest(F.least("value", F.lit(top)), F.lit(0.0))
    return grid.join(df, [key, "slot"], "left").select(key, "slot", F.when(F.col("value").isNull(), 0.0).otherwise(value).alias("value"))
