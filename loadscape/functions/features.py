"""Scalar features: wind, scaling, encoding, per-profile normalisation, generation flags, logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.operators.counted import numbered


def wind(u: Column, v: Column) -> dict[str, Column]:
    """speed, energy (half its cube) and direction in degrees of a wind vector."""
    speed = F.sqrt(u * u + v * v)
    return {"speed": speed, "energy": 0.5 * F.pow(speed, F.lit(3.0)), "direction": F.degrees(F.atan2(u, v))}


def one_hot(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """A 0/1 column named col_value for each value."""
    return df.withColumns({f"{col}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in values})


def ordinal(df: DataFrame, col: str, out: str) -> DataFrame:
    """Categories numbered from 0 in their order, range by range; Spark sends the codes to all tasks if they are few."""
    codes = numbered(df, col).select(F.col("value").alias("_c"), F.col("number").cast("int").alias(out))
    return df.join(codes, F.col(col) == F.col("_c"), "left").drop("_c")


def standardise(df: DataFrame, fit_on: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, both from ``fit_on``; a constant column becomes NULL."""
    stats = fit_on.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols}).select(*df.columns)


def min_max(df: DataFrame, fit_on: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min), both from ``fit_on``; a constant column becomes 0."""
    stats = fit_on.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("a", F.min), ("b", F.max))])
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}")), F.lit(0.0)) for c in cols}
    return df.join(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def normalise_profile(vals: Column, eps: float = 1e-4) -> dict[str, Column]:
    """A profile scaled to [-1, 1] by its own range, and the middle and half range that undo it."""
    lo, hi = F.array_min(vals), F.array_max(vals)
    scaled = F.transform(vals, lambda x: (x - lo) / (hi - lo + eps) * 2 - 1)
    return {"scaled": scaled, "middle": (hi + lo) / 2, "half_range": (hi - lo) / 2}


def generation_flags(length: Column, width: int) -> Column:
    """1 for every step of a sequence and 0 for the padding up to ``width``."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= length).cast("int"))


def logit(y: Column, alpha: float = 1e-6) -> Column:
    z = alpha + (1 - 2 * alpha) * y
    return F.ln(z / (1 - z))


def sigmoid(x: Column, alpha: float = 1e-6) -> Column:
    return (1 / (1 + F.exp(-x)) - alpha) / (1 - 2 * alpha)


def log_sum_exp(value: str) -> Column:
    """Aggregate; two-pass stability is left to the caller's scale."""
    return F.ln(F.sum(F.exp(value)))


def fold(vals: Column, k: int) -> Column:
    """An array summed in chunks of k."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(vals) / k).cast("int") - 1), lambda i: F.aggregate(F.slice(vals, i * k + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + x))
