"""Ranks and exact quantiles from counts of distinct values, without a task that sees all values.

Values are counted first, so what is ordered is one row a distinct value. These counts are written once in the shared folder
and read from there. They are dealt into ranges, of about RANGE_ROWS rows of the largest group, by bounds from a sample (by
hash, so reruns agree); each range is ordered on its own, and the rows of the ranges before it are added. Bounds only spread
the work: any bounds give the same result, and where one range can hold every group there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.graph import cut

#: Rows of a group that one range holds, and sampled values for each range.
RANGE_ROWS, SAMPLED = 100_000, 20


def bounds_of(rows: DataFrame, col: str, by: Sequence[str] = ()) -> list:
    """Ascending values that deal ``rows`` into as many ranges as the largest group of ``by`` asks for, one a shuffle
    partition at most. A group up to RANGE_ROWS rows asks for none."""
    n, most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(most or 0) // RANGE_ROWS))
    if parts <= 1:
        return []
    x = rows.select(F.col(col).alias("x")).where("x is not null")
    one_in = max(1, n // (SAMPLED * parts))
    hashed = F.pmod(F.xxhash64("x"), F.lit(one_in)) == 0
    found = [r[0] for r in x.where(hashed).distinct().orderBy("x").collect()]
    return sorted({found[len(found) * k // parts] for k in range(1, parts)} - {*found[:1]}) if found else []


def range_of(value: Column, bounds: list, kind) -> Column:
    """How many of the ascending ``bounds`` are at or below a value, by halving an array that is one literal of the plan."""
    if not bounds:
        return F.lit(0)
    all_ = F.array(*map(F.lit, bounds)).cast(f"array<{kind.simpleString()}>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = F.get(all_, mid) <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~low, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), len(bounds).bit_length()), start, halve, lambda s: s["lo"])


def running(rows: DataFrame, order: str, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``<m>_below`` and ``<m>_total`` for each measure: its sum over the rows of smaller ``order``, and over all.

    Within each group of ``by``. ``order`` is unique there and not null. ``rows`` are written once, and bounds and sums read
    that table. A group is dealt into ranges like everything else, so a group that holds most of the rows is ordered by many
    tasks.
    """
    rows = cut(rows)
    bounds = bounds_of(rows, order, by)
    zero = lambda m: F.lit(0).cast(rows.schema[m].dataType)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = lambda w, col, m: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero(m))
    if not bounds:
        sums = {f"{m}_below": earlier(group.orderBy(order), m, m) for m in measures} | {f"{m}_total": F.sum(m).over(group) for m in measures}
        return rows.select("*", *[c.alias(n) for n, c in sums.items()])
    dealt = rows.withColumn("_part", range_of(F.col(order), bounds, rows.schema[order].dataType))
    sums = dealt.groupBy(*by, "_part").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    starts = [earlier(group.orderBy("_part"), f"_{m}", m).alias(f"_{m}_start") for m in measures]
    totals = [F.sum(f"_{m}").over(group).alias(f"{m}_total") for m in measures]
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_own"), *starts, *totals)
    same = F.col("_part") == F.col("_own")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = {f"_{m}_inside": earlier(Window.partitionBy(*by, "_part").orderBy(order), m, m) for m in measures}
    found = dealt.withColumns(within).join(sums, same)
    below = [(F.col(f"_{m}_start") + F.col(f"_{m}_inside")).alias(f"{m}_below") for m in measures]
    return found.select(*rows.columns, *below, *[f"{m}_total" for m in measures])


def counted(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, below, total): each distinct value of ``col`` with how many rows hold it, hold less, and are there.

    Within each group of ``by``; null values are left out.
    """
    counts = df.select(*by, F.col(col).alias("value")).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "value", ["n"], by).select(*by, "value", "n", F.col("n_below").alias("below"), F.col("n_total").alias("total"))


def quantiles(df: DataFrame, col: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, level, value): exact quantiles, linear between the two nearest ranks. Nulls are left out."""
    place = lambda q: (F.col("total") - 1) * q
    here = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    all_ = F.array(*[F.lit(float(q)) for q in levels])
    met = F.filter(all_, lambda q: here(F.floor(place(q))) | here(F.ceil(place(q))))
    rows = counted(df, col, by).withColumn("level", F.explode(met))
    lo, hi = (F.max(F.when(here(f(place(F.col("level")))), F.col("value"))) for f in (F.floor, F.ceil))
    found = rows.groupBy(*by, "level").agg(lo.alias("_lo"), hi.alias("_hi"), F.max(place(F.col("level"))).alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return found.select(*by, "level", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("value"))


def nearest_quantiles(df: DataFrame, col: str, percents: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, percent, value): the value at the rank nearest to each percentile, ties to even."""
    rank = lambda p: F.bround((F.col("total") - 1) * p / F.lit(100.0))
    all_ = F.array(*map(F.lit, percents))
    met = F.filter(all_, lambda p: (F.col("below") <= rank(p)) & (rank(p) < F.col("below") + F.col("n")))
    return counted(df, col, by).select(*by, F.explode(met).alias("percent"), "value")


def numbered(df: DataFrame, col: str) -> DataFrame:
    """(value, number): the distinct values of ``col``, numbered from 0 in their order."""
    return counted(df.select(F.col(col).alias("value")).distinct(), "value").select("value", F.col("below").alias("number"))
