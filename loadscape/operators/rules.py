"""Rules on gaps and what surrounds them. Verdicts: TRUE an error, FALSE normal, NULL unknown."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.sequences import neighbours


def sign_change(length: Column, before: Column, after: Column) -> Column:
    """Normal: a single zero between values of opposite sign."""
    return F.when((length == 1) & (F.signum(before) == -F.signum(after)), False)


def low_sides(before: Column, after: Column, low: float) -> Column:
    """Normal: low values on both sides."""
    return F.when((F.abs(before) < low) & (F.abs(after) < low), False)


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, _q1, _q3)."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(0.25)).alias("_q1"), F.percentile(value, F.lit(0.75)).alias("_q3"))


def holds_more(v0: Column, v1: Column, q1: Column, q3: Column, capacity: float, multiplier: float = 1.5, least_iqr: float = 0.25) -> Column:
    """Whether the value after a gap holds what was not read: above capacity it does, below the next value it does not,
    outside the box plot it does."""
    reach = multiplier * F.greatest(q3 - q1, F.lit(least_iqr))
    return F.when(v0 > capacity, True).when(v0 < v1, False).when((v0 > q3 + reach) | (v0 < q1 - reach), True)


def cumulative(df: DataFrame, found: DataFrame, key: str, pos: str, value: str, capacity: float, multiplier: float = 1.5, least_iqr: float = 0.25) -> DataFrame:
    """Adds ``cumulative``: does the value after a gap hold what was not read before it?

    Above capacity it does; else not if the next value is higher still; else if it lies outside the box plot. Intervals that
    come with value_after and second_after (``runs_of_kinds``) need no look at their neighbours.
    """
    if not {"value_after", "second_after"} <= {*found.columns}:
        found = neighbours(df, found, [key], pos, value)
    verdict = holds_more(F.col("value_after"), F.col("second_after"), F.col("_q1"), F.col("_q3"), capacity, multiplier, least_iqr)
    return found.join(quartiles(df, key, value), key).select(key, "start", "end", verdict.alias("cumulative"))


def outside_normal(df: DataFrame, key: str, value: str, z: float) -> DataFrame:
    """Adds ``outside``: further from the key's mean than z population deviations."""
    fit = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(fit, key).withColumn("outside", F.abs(F.col(value) - F.col("_m")) > z * F.col("_s")).drop("_m", "_s")


def run_then_break(df: DataFrame, key: str, order: str, flag: Column, k: int) -> DataFrame:
    """(key, hit): whether k flagged rows in a row are followed at once by an unflagged one."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-k, -1)
    rows = df.withColumn("_z", flag)
    rows = rows.withColumn("_run", F.sum(F.col("_z").cast("int")).over(before) == k)
    return rows.groupBy(key).agg(F.max(F.coalesce(F.col("_run"), F.lit(False)) & ~F.col("_z")).alias("hit"))


def after_gap(df: DataFrame, found: DataFrame, key: str, pos: str, value: str, width: int) -> DataFrame:
    """(key, start, gap, v1, v2, mean, hi) from the ``width`` positions after each gap; mean and hi leave out the first."""
    wanted = found.select(key, "start", (F.col("end") - F.col("start")).alias("gap"), F.posexplode(F.sequence(F.col("end").cast("int"), (F.col("end") + width - 1).cast("int"))).alias("_k", pos))
    rows = wanted.join(df.select(key, pos, value), [key, pos])
    at = lambda c: F.max(F.when(c, F.col(value)))
    rest = F.when(F.col("_k") > 0, F.col(value))
    return rows.groupBy(key, "start", "gap").agg(at(F.col("_k") == 0).alias("v1"), at(F.col("_k") == 1).alias("v2"), F.round(F.avg(rest), 4).alias("mean"), F.max(rest).alias("hi"))


def after_null_runs(df: DataFrame, key: str, pos: str, value: str, width: int) -> DataFrame:
    """As ``after_gap`` for all runs of nulls at consecutive positions, in one pass over each key's positions, without a join.

    The last row of a run sees the ``width`` positions after it; a run without any row there gives none.
    """
    w = Window.partitionBy(key).orderBy(pos)
    none, step = F.col(value).isNull(), F.col(pos)
    begins = none & F.coalesce((F.lag(pos).over(w) != step - 1) | F.lag(value).over(w).isNotNull(), F.lit(True))
    ends = none & F.coalesce((F.lead(pos).over(w) != step + 1) | F.lead(value).over(w).isNotNull(), F.lit(True))
    ahead = lambda a, b: w.rangeBetween(a, b)
    rest = F.when(F.lit(width > 1), F.avg(value).over(ahead(2, max(2, width)))), F.when(F.lit(width > 1), F.max(value).over(ahead(2, max(2, width))))
    seen = {"v1": F.max(value).over(ahead(1, 1)), "v2": F.when(F.lit(width > 1), F.max(value).over(ahead(2, 2))), "mean": F.round(rest[0], 4), "hi": rest[1], "_rows": F.count(F.lit(1)).over(ahead(1, width))}
    rows = df.select(key, pos, F.when(begins, step).alias("_start"), ends.alias("_ends"), *[c.alias(n) for n, c in seen.items()])
    rows = rows.withColumn("_start", F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where(F.col("_ends") & (F.col("_rows") > 0) & F.col(key).isNotNull())
    return found.select(key, F.col("_start").alias("start"), (step + 1 - F.col("_start")).alias("gap"), "v1", "v2", "mean", "hi")


def rare_values(df: DataFrame, key: str, value: str, width: float, least: float) -> DataFrame:
    """Adds ``rare``: the value's histogram cell holds less than a share ``least`` of its key's values.

    Densities come from counts of cells, which are combined before the shuffle.
    """
    cell = F.floor(F.col(value) / width)
    counts = df.groupBy(key, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(key))).drop("_n")
    return df.withColumn("_cell", cell).join(share, [key, "_cell"]).withColumn("rare", F.col("_share") < least).drop("_cell", "_share")


def density_region(df: DataFrame, key: str, value: str, width: float, bandwidth: float, reach: int, mass: float) -> DataFrame:
    """(key, _cell, outside) of the cells of ``width`` in which values lie, see ``outside_density``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.floor(F.col(value) / width).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_o")
    given = counts.select(key, "_cell", "_n", offset).select(key, (F.col("_cell") + F.col("_o")).alias("_cell"), (F.col("_n") * F.exp(-0.5 * F.pow(F.col("_o") * width / bandwidth, F.lit(2)))).alias("_k"))
    density = counts.join(given, [key, "_cell"]).groupBy(key, "_cell", "_n").agg(F.round(F.sum("_k"), 6).alias("_f"))
    by = Window.partitionBy(key)
    denser = F.sum("_n").over(by.orderBy(F.desc("_f"), "_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return density.select(key, "_cell", (denser >= mass * F.sum("_n").over(by)).alias("outside"))


def outside_density(df: DataFrame, key: str, value: str, width: float, bandwidth: float, reach: int, mass: float) -> DataFrame:
    """Adds ``outside``: the value lies outside its key's densest cells, which together hold a share ``mass`` of its values.

    Density is a Gaussian kernel over cells of ``width``, cut off ``reach`` cells away. Cells are counted before they meet
    their neighbours, so the work grows with cells, not with pairs of values.
    """
    region = density_region(df, key, value, width, bandwidth, reach, mass)
    return df.withColumn("_cell", F.floor(F.col(value) / width)).join(region, [key, "_cell"]).drop("_cell")


def real_or_cumulative(df: DataFrame, found: DataFrame, key: str, pos: str, value: str, period: int, days: int) -> DataFrame:
    """(key, start, end, cumulative): is the value after a gap more like that hour on a day nearby, or like its sum?

    For each of the ``days`` days before and after, the value is held against the same hour and against the sum of the
    gap's hours and that hour; unread hours count as 0 in the sum. NULL where nothing can be compared. A key's values and
    its intervals meet as arrays, so hours are not multiplied by days; a batch of keys is judged at a time.
    """
    offsets = np.array([d * period for d in range(-days, days + 1) if d])

    def verdicts(at: np.ndarray, v: np.ndarray, known: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        at, v, known = at[order], np.append(np.where(known, v, 0.0)[order], 0.0), np.append(known[order], False)
        place = lambda p: np.searchsorted(at, p)
        has = lambda i, p: (i < len(at)) & (at[np.minimum(i, len(at) - 1)] == p)
        own = place(end)
        asked = has(own, end) & known[np.minimum(own, len(at))]
        lo, hi = place(start[:, None] + offsets), place(end[:, None] + offsets)
        whole = has(lo, start[:, None] + offsets) & has(hi, end[:, None] + offsets) & (hi - lo == (end - start)[:, None])
        lo, hi = np.where(whole, lo, 0), np.where(whole, hi, 0)
        sums = np.add.reduceat(v, np.stack([lo.ravel(), hi.ravel() + 1], axis=1).ravel())[::2].reshape(lo.shape)
        this = v[np.minimum(own, len(at))][:, None]

        def least(gap: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # numbers, then NaN, then none: as pairs of a class and a number
            kind = np.where(there, np.where(np.isnan(gap), 1, 0), 2).min(axis=1)
            return kind, np.where(there & ~np.isnan(gap), gap, np.inf).min(axis=1)

        (real, a), (total, b) = least(np.round(np.abs(this - v[hi]), 6), whole & known[hi]), least(np.round(np.abs(this - np.round(sums, 6)), 6), whole)
        less = (total < real) | ((total == 0) & (real == 0) & (b < a))
        return np.where(~asked | ~whole.any(axis=1), 2, np.where(real == 2, -1, less.astype(int)))

    @F.pandas_udf("array<int>")
    def judge(at: pd.Series, v: pd.Series, known: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        whole = lambda x: np.asarray(x, np.int64)
        return pd.Series([verdicts(whole(p), np.asarray(x, float), np.asarray(k, bool), whole(a), whole(b)) for p, x, k, a, b in zip(at, v, known, start, end)], dtype=object)

    read = df.groupBy(key).agg(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v"), F.col(value).isNotNull().alias("k"))).alias("_read"))
    asked = found.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("_asked"))
    met = asked.join(read.hint("merge"), key).withColumn("_said", judge("_read.p", "_read.v", "_read.k", "_asked.start", "_asked.end"))
    rows = met.select(key, F.explode(F.arrays_zip("_asked", "_said")).alias("_x")).where("_x._said < 2")
    return rows.select(key, F.col("_x._asked.start").alias("start"), F.col("_x._asked.end").alias("end"), F.when(F.col("_x._said") >= 0, F.col("_x._said") == 1).alias("cumulative"))
