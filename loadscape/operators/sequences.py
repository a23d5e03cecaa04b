"""Window and sequence operators: runs, shifts, differences, load-duration curves, ranks, fills, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runs(df: DataFrame, keys: Sequence[str], pos: str, flag: Column) -> DataFrame:
    """(keys, start, end): maximal runs of consecutive positions where ``flag`` holds, the end exclusive.

    Positions must be distinct within a key. A position's distance from its rank among flagged rows names its run.
    """
    hit = df.where(F.coalesce(flag, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return hit.withColumn("_run", F.col(pos) - rank).groupBy(*keys, "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_run")


def runs_of_kinds(df: DataFrame, keys: Sequence[str], pos: str, value: str, kind: Column) -> DataFrame:
    """(keys, kind, start, end, ...): maximal runs of consecutive positions of one kind, with what ``neighbours`` adds.

    ``kind`` is null where a position is in no run. Runs and neighbours come from one pass over each key's positions.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    rows = df.select(
        *keys, pos, kind.alias("kind"), F.lag(value).over(w).alias("_before"), F.lead(value).over(w).alias("_after"), F.lead(value, 2).over(w).alias("_second"),
        F.lag(F.lit(1)).over(w).isNull().alias("_first"), F.lead(F.lit(1)).over(w).isNull().alias("_last"),
    )
    hit = rows.where("kind is not null")
    hit = hit.withColumn("_run", F.col(pos) - F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(pos)))
    ends = {"value_before": F.min_by("_before", pos), "at_start": F.min_by("_first", pos), "value_after": F.max_by("_after", pos), "second_after": F.max_by("_second", pos), "at_end": F.max_by("_last", pos)}
    return hit.groupBy(*keys, "kind", "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), *[c.alias(n) for n, c in ends.items()]).drop("_run")


def neighbours(df: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Intervals with value_before, value_after, second_after, and at_start / at_end flags (no such position)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    v = df.select(*keys, pos, F.lag(value).over(w).alias("value_before"), F.lag(F.lit(1)).over(w).isNull().alias("at_start"))
    last = df.select(*keys, (F.col(pos) + 1).alias("end"), F.lead(value).over(w).alias("value_after"), F.lead(value, 2).over(w).alias("second_after"), F.lead(F.lit(1)).over(w).isNull().alias("at_end"))
    return intervals.join(v.withColumnRenamed(pos, "start"), [*keys, "start"]).join(last, [*keys, "end"])


def shift(df: DataFrame, keys: Sequence[str], order: str, value: str, periods: int, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(value, periods).over(Window.partitionBy(*keys).orderBy(order)))


def deaccumulate(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Each value less the one before within the key, the first kept; negatives become 0."""
    step = F.col(value) - F.lag(value, 1, 0.0).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, F.greatest(step, F.lit(0.0)))


def load_duration(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """Running share of the total with values in descending order."""
    w = Window.partitionBy(*keys)
    run = F.sum(value).over(w.orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.try_divide(run, F.sum(value).over(w)))


def mean_by_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """(rank, mean): each key's values sorted descending, averaged by rank over all keys."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)))
    return ranked.groupBy("rank").agg(F.avg(value).alias("mean"))


def average_rank(partition: Sequence[str], value: Column) -> Column:
    """Rank from 1 with ties at their mean rank."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def find_pattern(df: DataFrame, keys: Sequence[str], order: str, value: str, pattern: Sequence) -> DataFrame:
    """Rows at which the pattern of values starts."""
    w = Window.partitionBy(*keys).orderBy(order)
    found = df.select("*", *[F.lead(value, i).over(w).alias(f"_v{i}") for i in range(len(pattern))])
    for i, x in enumerate(pattern):
        found = found.where(F.col(f"_v{i}") == F.lit(x))
    return found.select(*df.columns)


def interpolate(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """NULLs between two values on the straight line between them; outer NULLs stay."""
    w = Window.partitionBy(*keys).orderBy(pos)
    # what comes after is what came before in the other order: a frame up to the end would be read anew for each row
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, Window.partitionBy(*keys).orderBy(F.desc(pos))))
    known = F.when(F.col(value).isNotNull(), F.col(pos))
    p0, p1 = (F.last(known, True).over(x) for x in (back, ahead))
    v0, v1 = (F.last(value, True).over(x) for x in (back, ahead))
    line = v0 + (v1 - v0) * (F.col(pos) - p0) / (p1 - p0)
    return df.withColumn(out, F.coalesce(F.col(value), line))


def interpolate_cubic(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """NULLs between two values on the polynomial through the two known values before and the two after; outer NULLs stay.

    Near an end, where a side has only one value, the polynomial is of the degree that its points allow.
    """
    # what comes after is what came before in the other order: a frame up to the end would be read anew for each row
    known, rows, points = F.col(value).isNotNull(), df, []
    for side, order in (("b", F.asc(pos)), ("a", F.desc(pos))):
        w = Window.partitionBy(*keys).orderBy(order)
        own = {f"_{side}p": F.when(known, F.col(pos).cast("double")), f"_{side}v": F.when(known, F.col(value).cast("double"))}
        # at a known value the one before it, which no other known value lacks once one has it
        last = {f"{c}2": F.when(known, F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -1))) for c, x in own.items()}
        rows = rows.withColumns(own | last)
        rows = rows.withColumns({c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in (*own, *last)})
        near, far = ({"p": F.col(f"_{side}p{n}"), "v": F.col(f"_{side}v{n}")} for n in ("", "2"))
        points += [far, near] if side == "b" else [near, far]
    at = F.col(pos).cast("double")

    def share(x: dict[str, Column]) -> Column:
        out = F.lit(1.0)
        for y in points:
            skip = y["p"].isNull() | (y["p"] == x["p"])
            out = out * F.when(skip, 1.0).otherwise(at - y["p"]) / F.when(skip, 1.0).otherwise(x["p"] - y["p"])
        return out

    curve = F.lit(0.0)
    for x in points:
        curve = curve + F.when(x["p"].isNull(), 0.0).otherwise(x["v"] * share(x))
    inside = F.col("_bp").isNotNull() & F.col("_ap").isNotNull()
    found = rows.withColumn(out, F.coalesce(F.col(value), F.when(inside, curve)))
    return found.drop(*[f"_{side}{c}{n}" for side in "ba" for c in "pv" for n in ("", "2")])


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, True).over(w))


def seasonal_fill(df: DataFrame, keys: Sequence[str], phase: str, period: str, value: str, out: str) -> DataFrame:
    """NULLs become the mean of the nearest values of the same phase before and after; one side alone if need be."""
    w = Window.partitionBy(*keys, phase).orderBy(period)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(F.col(value), (before + after) / 2, before, after))


def seasonal_mean_fill(df: DataFrame, keys: Sequence[str], phase: str, period: str, value: str, out: str) -> DataFrame:
    """NULLs become the mean of all earlier values of the same phase, else of all of them."""
    w = Window.partitionBy(*keys, phase)
    earlier = F.avg(value).over(w.orderBy(period).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(F.col(value), earlier, F.avg(value).over(w)))


def autocorrelation(df: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """(key, lag, acf): sums of lagged products of deviations over the sum of squares; NULL for a constant series."""
    centred = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    w = Window.partitionBy(key).orderBy(order)
    products = F.array(*[F.col("_d") * F.lead("_d", k).over(w) for k in range(1, lags + 1)])
    rows = centred.select(key, (F.col("_d") * F.col("_d")).alias("_s"), products.alias("_ps")).select(key, "_s", F.posexplode("_ps").alias("_k", "_p"))
    return rows.groupBy(key, (F.col("_k") + 1).alias("lag")).agg(F.try_divide(F.sum("_p"), F.sum("_s")).alias("acf"))


def moving_average(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Running mean of all values so far."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def ema(values: Column, momentum: float) -> Column:
    """Exponential moving average over an array, starting at its first value; the last state."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda a, x: a * F.lit(momentum) + x * F.lit(1 - momentum))


def difference(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def strict_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows above both neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", F.lag(value).over(w).alias("_a"), F.lead(value).over(w).alias("_b")).where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def decompose(df: DataFrame, keys: Sequence[str], pos: str, value: str, period: int, length: int) -> DataFrame:
    """Adds trend (a centred mean of period + 1 values, NULL near the ends), season and rest of a series from 0 to length."""
    half = period // 2
    w = Window.partitionBy(*keys)
    mean = F.avg(value).over(w.orderBy(pos).rowsBetween(-half, half))
    rows = df.withColumn("trend", F.when(F.col(pos).between(half, length - half - 1), mean)).withColumn("_phase", F.col(pos) % period)
    rows = rows.withColumn("season", F.avg(F.col(value) - F.col("trend")).over(Window.partitionBy(*keys, "_phase")))
    return rows.withColumn("rest", F.col(value) - F.col("trend") - F.col("season")).drop("_phase")


def _medians(at: np.ndarray, v: np.ndarray, known: np.ndarray, period: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, whether there) of trend and season of one ordered series."""
    half, n = period // 2, len(v)
    day = lambda x, edge: np.lib.stride_tricks.sliding_window_view(np.pad(x, half, constant_values=edge), 2 * half + 1)
    inside = np.flatnonzero((at >= half) & (at <= length - half - 1) & (day(known, False).sum(axis=1) > half))
    trend, season, has = np.full(n, np.nan), np.full(n, np.nan), np.zeros((2, n), bool)
    # NaN and unknown values come last in that order, and only places among the known ones are asked for
    trend[inside], has[0, inside] = np.partition(day(np.where(known, v, np.nan), np.nan)[inside], half, axis=1)[:, half], True
    phase, used = np.fmod(at, period), np.flatnonzero(has[0] & known)
    gaps = (v - trend)[used]
    order = np.lexsort((gaps, phase[used]))
    phases, start, count = np.unique(phase[used][order], return_index=True, return_counts=True)
    if len(phases):
        middle = (gaps[order][start + (count - 1) // 2] + gaps[order][start + count // 2]) / 2
        place = np.minimum(np.searchsorted(phases, phase), len(phases) - 1)
        has[1] = phases[place] == phase
        season = middle[place]
    return [(trend, has[0]), (season, has[1])]


def decompose_robust(df: DataFrame, keys: Sequence[str], pos: str, value: str, period: int, length: int) -> DataFrame:
    """As ``decompose`` with medians instead of means, so that single peaks move neither trend nor season; period is even.

    A key's rows meet as arrays, so one shuffle brings them together and numpy takes the medians. Nulls are left out of a
    day: its trend is the same place among the known values, NULL where they are too few. Rows without a key go.
    """
    parts = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("trend", "season")])

    @F.arrow_udf(parts)
    def medians(at: pa.Array, v: pa.Array) -> pa.Array:
        ends, places, values = at.offsets.to_numpy(), at.values.to_numpy(), v.values
        known, numbers = ~values.is_null().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype(float)
        series = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        found = [_medians(places[x], numbers[y], known[y], period, length) for x, y in zip(series, (slice(a, b) for a, b in zip(v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:])))]
        whole = lambda k, c: np.concatenate([np.zeros(0, bool if c else float), *[x[k][c] for x in found]])
        columns = [pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(whole(k, 0), mask=~whole(k, 1))) for k in (0, 1)]
        return pa.StructArray.from_arrays(columns, names=parts.names)

    rest = [pos, *[c for c in df.columns if c not in (*keys, pos)]]
    series = df.where(" and ".join(f"{c} is not null" for c in keys)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_rows"))
    series = series.withColumn("_found", medians(F.col(f"_rows.{pos}").cast("array<bigint>"), F.col(f"_rows.{value}").cast("array<double>")))
    rows = series.select(*keys, F.col("_rows"), *[F.col(f"_found.{c}").alias(f"_{c}") for c in parts.names]).select(*keys, F.explode(F.arrays_zip("_rows", "_trend", "_season")).alias("_x"))
    rows = rows.select(*[F.col(c) if c in keys else F.col(f"_x._rows.{c}").alias(c) for c in df.columns], F.col("_x._trend").alias("trend"), F.col("_x._season").alias("season"))
    return rows.withColumn("rest", F.col(value) - F.col("trend") - F.col("season"))


def context(df: DataFrame, keys: Sequence[str], day: str, value: str, reach: int, k: int) -> DataFrame:
    """(keys, day, other, gap): for each row the k most alike values of its keys within ``reach`` days, ties by day.

    A row sees the days around it in one ordered pass; nothing is joined.
    """
    near = F.collect_list(F.struct(F.col(day).alias("other"), F.col(value).alias("v"))).over(Window.partitionBy(*keys).orderBy(day).rangeBetween(-reach, reach))
    gaps = F.transform(F.filter(near, lambda x: x["other"] != F.col(day)), lambda x: F.struct(F.abs(F.col(value) - x["v"]).alias("gap"), x["other"].alias("other")))
    rows = df.withColumn("_x", F.slice(F.array_sort(gaps), 1, k)).withColumn("_x", F.explode("_x"))
    return rows.select(*df.columns, F.col("_x.other").alias("other"), F.col("_x.gap").alias("gap"))
