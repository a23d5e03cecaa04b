"""Cleaning of readings: parsing, de-duplication, grid completion, clipping, thresholds, outliers, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.counted import numbered, quantiles


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN becomes NULL, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def decimal_comma(value: Column) -> Column:
    """A number written with a decimal comma; a slash or anything unreadable is NULL."""
    return F.replace(F.nullif(F.trim(value), F.lit("/")), F.lit(","), F.lit(".")).try_cast("double")


def swap_day_month(ts: Column) -> Column:
    """Day and month exchanged where the day could be a month."""
    swapped = F.make_timestamp_ntz(F.year(ts), F.dayofmonth(ts), F.month(ts), F.hour(ts), F.minute(ts), F.second(ts).cast("decimal(8,6)"))
    return F.when(F.dayofmonth(ts) <= 12, swapped).otherwise(ts)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def net(offtake: Column, injection: Column) -> Column:
    """Consumption: offtake less injection, missing sides as 0, rounded half-even to 4 places."""
    return F.bround(F.coalesce(offtake, F.lit(0.0)) - F.coalesce(injection, F.lit(0.0)), 4)


def clip_negative(value: Column) -> Column:
    """Negative to 0; NULL stays NULL."""
    return F.when(value < 0, 0.0).otherwise(value)


def signed(value: Column, is_injection: Column) -> Column:
    return F.when(is_injection & (value > 0), -value).otherwise(value)


def drop_over(df: DataFrame, limits: DataFrame, key: str, limit_col: str, most: float) -> DataFrame:
    """Rows of keys whose limit column is above ``most`` go."""
    return df.join(limits.where(F.col(limit_col) > most).select(key), key, "left_anti")


def drop_by_count(df: DataFrame, key: str, flag: Column, most: int) -> DataFrame:
    """Rows of keys with more than ``most`` flagged rows go."""
    over = df.groupBy(key).agg(F.count_if(flag).alias("_n")).where(F.col("_n") > most).select(key)
    return df.join(over, key, "left_anti")


def complete_grid(df: DataFrame, key: str, ts: str, start: str, end: str, step: str) -> DataFrame:
    """Every key with every step from start to end inclusive, and what was read then.

    Each row gives the steps up to the next row of its key, so only what was read is shuffled and the grid is made where it
    is needed: a join of the grid would shuffle all of it, or send it to all tasks, as Spark takes it to be no larger than
    the keys.
    """
    all_ = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))
    others = [c for c in df.columns if c not in (key, ts)]
    steps = df.sparkSession.range(1).select(F.posexplode(all_).alias("_at", "_ts"))
    rows = df.join(F.broadcast(steps), F.col(ts) == F.col("_ts"), "left")
    # -1: a row without a place in the grid, which only tells that its key is there
    rows = rows.withColumn("_at", F.when(F.col(key).isNotNull() & F.col("_at").isNotNull(), F.col("_at")).otherwise(-1))
    w = Window.partitionBy(key).orderBy("_at")
    first = F.lag(F.lit(1)).over(w).isNull()
    rows = rows.withColumn("_to", F.greatest(F.coalesce(F.lead("_at").over(w), F.size(all_)) - 1, F.col("_at"))).withColumn("_from", F.when(first, 0).otherwise(F.greatest("_at", F.lit(0))))
    rows = rows.where("_to >= _from").select(key, *others, "_at", F.explode(F.sequence("_from", "_to")).alias("_i"))
    return rows.select(key, F.element_at(all_, F.col("_i") + 1).alias(ts), *[F.when(F.col("_i") == F.col("_at"), F.col(c)).alias(c) for c in others])


def between_percentiles(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Outliers go column by column; each column's limits are taken from what the ones before left.

    Two numbers a column reach the driver, so the filters of all columns are pushed to the scan.
    """
    for c in cols:
        limit = {r.level: r.value for r in quantiles(df, c, [low, high]).collect()}
        df = df.where(F.col(c).between(F.lit(limit.get(low)), F.lit(limit.get(high))))
    return df


def ordinal_ids(df: DataFrame, key: str, out: str, prefix: str) -> DataFrame:
    """Keys renamed prefix0, prefix1, ... in their order; distinct keys are numbered range by range."""
    ids = numbered(df, key).select(F.col("value").alias(key), F.concat(F.lit(prefix), F.col("number").cast("string")).alias(out))
    return df.join(ids, key)


def without_leap_day(df: DataFrame, ts: str, year: int) -> DataFrame:
    """29 February goes; other timestamps move to ``year``."""
    t = F.col(ts)
    moved = F.make_timestamp_ntz(F.lit(year), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t).cast("decimal(8,6)"))
    return df.where(~((F.month(t) == 2) & (F.dayofmonth(t) == 29))).withColumn(ts, moved)


def known_counts(df: DataFrame) -> DataFrame:
    """(name, known): the number of values of each column, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "name", "known")
