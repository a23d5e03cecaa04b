"""Interval tables and the rules that tell errors from normal readings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.sequences import runs_of_kinds


def interval_table(df: DataFrame, keys: Sequence[str], pos: str, value: str, low: Column) -> DataFrame:
    """All NULL runs (interval_value NULL) and runs where ``low`` holds (interval_value 0), with their neighbours."""
    kind = F.when(F.col(value).isNull(), 1).when(F.coalesce(low, F.lit(False)), 2)
    found = runs_of_kinds(df, keys, pos, value, kind)
    length, zero = (F.col("end") - F.col("start")).cast("int"), F.when(F.col("kind") == 2, 0.0)
    return found.withColumns({"interval_value": zero, "interval_length": length}).drop("kind")


def mask(df: DataFrame, found: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Values from the start of an interval up to its end, which is the value after it, become NULL."""
    hit = found.select(*keys, F.explode(F.sequence("start", "end")).alias(pos)).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, [*keys, pos], "left").withColumn(value, F.when(F.col("_hit").isNull(), F.col(value))).drop("_hit")


def mask_long_runs(df: DataFrame, keys: Sequence[str], pos: str, value: str, flag: Column, least: int) -> DataFrame:
    """As ``mask`` for runs of ``least`` flagged positions or more, in one pass over each key's positions.

    Positions follow each other without a gap. The number of unflagged positions so far names a run; frames grow row by
    row, so the work is in proportion to the positions.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    rows = df.withColumn("_on", F.coalesce(flag, F.lit(False)).cast("int"))
    rows = rows.withColumn("_run", F.sum(1 - F.col("_on")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_long", (F.col("_on") == 1) & (F.sum("_on").over(Window.partitionBy(*keys, "_run")) >= least))
    hit = F.col("_long") | F.coalesce(F.lag("_long").over(w), F.lit(False))
    return rows.withColumn(value, F.when(~hit, F.col(value))).drop("_on", "_run", "_long")


def boxplot_peaks(df: DataFrame, key: str, value: str, multiplier: float = 1.5, least_iqr: float = 0.25) -> DataFrame:
    """Adds is_peak: outside the quartiles by a multiple of the interquartile range, which is at least ``least_iqr``."""
    box = df.groupBy(key).agg(F.percentile(value, F.lit(0.25)).alias("_q1"), F.percentile(value, F.lit(0.75)).alias("_q3"))
    reach = multiplier * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(least_iqr))
    return df.join(box, key).withColumn("is_peak", (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)).drop("_q1", "_q3")


def over_capacity(value: Column, connection: Column, pv: Column) -> Column:
    """Beyond the connection either way, or below what the panels can feed in; unknown powers say nothing."""
    return reduce(or_, (F.coalesce(x, F.lit(False)) for x in (value > connection, value < -connection, value < -pv)))


def collective(found: DataFrame, least: int, within: int) -> DataFrame:
    """Adds ``collective``: the start is shared by ``least`` intervals and the length is near their most common one."""
    sized = found.withColumn("_n", F.col("end") - F.col("start"))
    counts = sized.groupBy("start", "_n").agg(F.count(F.lit(1)).alias("_c"))
    modal = counts.groupBy("start").agg(F.sum("_c").alias("_same"), F.max_by("_n", F.struct("_c", -F.col("_n"))).alias("_mode"))
    return sized.join(modal, "start").withColumn("collective", (F.col("_same") >= least) & (F.abs(F.col("_n") - F.col("_mode")) <= within)).drop("_n", "_same", "_mode")


def collective_rest(found: DataFrame, open_: Column, least: int, within: int) -> DataFrame:
    """Adds ``shared``: TRUE where ``collective`` holds among the intervals that are ``open_``, else NULL.

    Starts are places of a grid, so what their intervals share is small: it is sent to the intervals, which stay put.
    """
    size = F.col("end") - F.col("start")
    counts = found.where(open_).groupBy("start", size.alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    modal = counts.groupBy(F.col("start").alias("_s")).agg(F.sum("_c").alias("_same"), F.max_by("_n", F.struct("_c", -F.col("_n"))).alias("_mode")).where(F.col("_same") >= least)
    met = found.join(F.broadcast(modal), F.col("start") == F.col("_s"), "left")
    return met.withColumn("shared", F.when(open_ & (F.abs(size - F.col("_mode")) <= within), True)).drop("_s", "_same", "_mode")


def disconnected(found: DataFrame, keys: Sequence[str], least: int, within: int) -> DataFrame:
    """Adds ``disconnected``: start and end together are within so much of a pair that ``least`` intervals share.

    Intervals are counted by (start, end) first, and shared pairs are spread over the pairs near theirs, so what meets is
    different pairs, however many intervals have them.
    """
    counts = found.groupBy("start", "end").agg(F.count(F.lit(1)).alias("_c"))
    steps = [(i, j) for i in range(-within, within + 1) for j in range(-within, within + 1) if abs(i) + abs(j) <= within]
    near = F.explode(F.array(*[F.struct((F.col("start") + i).alias("s"), (F.col("end") + j).alias("e")) for i, j in steps])).alias("_x")
    hit = counts.where(F.col("_c") >= least).select(near).select(F.col("_x.s").alias("_s"), F.col("_x.e").alias("_e")).distinct()
    met = found.join(hit, (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    return met.select(*[F.col(c) for c in found.columns], F.col("_s").isNotNull().alias("disconnected"))


def combine(*verdicts: Column) -> Column:
    """Any FALSE is normal, else any TRUE is an error, else unknown."""
    no = reduce(or_, (F.coalesce(~v, F.lit(False)) for v in verdicts))
    yes = reduce(or_, (F.coalesce(v, F.lit(False)) for v in verdicts))
    return F.when(no, False).when(yes, True)


def summary(df: DataFrame, col: str) -> DataFrame:
    """(col, n, share) with NULL as a value of its own."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def wall_clock(df: DataFrame, periods: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Readings moved one hour on within their year's (start, end) period, duplicates averaged; those of a year without a
    period stay as they are, and a null timestamp stays null."""
    p = F.broadcast(periods.select(F.col("year").alias("_y"), F.col("start").cast("timestamp_ntz").alias("_s"), F.col("end").cast("timestamp_ntz").alias("_e")))
    inside = (F.col(ts) >= F.col("_s")) & (F.col(ts) < F.col("_e"))
    moved = df.join(p, F.year(ts) == F.col("_y"), "left").withColumn(ts, F.when(inside, F.col(ts) + F.expr("INTERVAL 1 HOUR")).otherwise(F.col(ts)))
    return moved.groupBy(key, ts).agg(F.avg(value).alias(value))
