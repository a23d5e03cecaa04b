"""Reshaping between long rows, arrays and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators.counted import nearest_quantiles, running


def split_days(df: DataFrame, vals: str, width: int) -> DataFrame:
    """One row per day: an array cut into pieces of ``width``."""
    days = F.transform(F.sequence(F.lit(0), F.floor(F.size(vals) / width).cast("int") - 1), lambda d: F.slice(F.col(vals), d * width + 1, F.lit(width)))
    return df.select("*", F.posexplode(days).alias("day", "day_values"))


def to_array(df: DataFrame, keys: Sequence[str], slot: str, value: str, out: str) -> DataFrame:
    """Long rows gathered into an array in slot order."""
    pairs = F.array_sort(F.collect_list(F.struct(slot, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def in_parts(df: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """(group, part, members): the keys of each group in order, joined by commas, ``size`` a part from 0.

    Keys are unique; places come range by range, so neither a task nor a row holds a whole group. Null keys are left out,
    rows without a group are one.
    """
    rows = running(df.select(group, key, F.lit(1).alias("_one")).where(F.col(key).isNotNull()), key, ["_one"], [group])
    part = F.floor(F.col("_one_below") / size).alias("part")
    members = F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",")
    return rows.groupBy(group, part).agg(members.alias("members"))


def quantile_bands(df: DataFrame, key: str, value: str, lowers: Sequence[int]) -> DataFrame:
    """(key, band, lower, upper) with nearest-rank quantiles of lo and 100 - lo percent."""
    found = nearest_quantiles(df, value, sorted({p for lo in lowers for p in (lo, 100 - lo)}), [key])
    rows = found.withColumn("lo", F.explode(F.filter(F.array(*map(F.lit, lowers)), lambda lo: F.col("percent").isin(lo, 100 - lo))))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    band = F.concat(two(F.col("lo")), F.lit("-"), two(100 - F.col("lo")))
    at = lambda p: F.max(F.when(F.col("percent") == p, F.col("value")))
    return rows.groupBy(key, "lo").agg(at(F.col("lo")).alias("lower"), at(100 - F.col("lo")).alias("upper")).select(key, band.alias("band"), "lower", "upper")
