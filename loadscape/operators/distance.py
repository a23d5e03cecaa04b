"""Distances between profiles and what is built on them: pairs, neighbours, medoids, silhouettes, outliers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscape.operators import blocks as by_blocks


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def missing_aware(a: Column, b: Column) -> Column:
    """Mean of squared differences over the places that both profiles have."""
    parts = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.size(parts))


def missing_aware_to_nine_places(a: Column, b: Column) -> Column:
    """As ``missing_aware``, rounded, so that what differs by less is a tie."""
    return F.round(missing_aware(a, b), 9)


def fill_mean(vals: Column) -> Column:
    """NULLs of a profile become its mean."""
    known = F.filter(vals, lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    return F.transform(vals, lambda x: F.coalesce(x, mean))


def wasserstein_1d(a: Column, b: Column) -> Column:
    """Transport cost, squared, between two samples of equal size: their sorted values are matched."""
    return squared(F.array_sort(a), F.array_sort(b)) / F.size(a)


def transport_1d(a: Column, b: Column) -> Column:
    """Transport cost, squared, between two samples of any sizes: their sorted values meet where their running shares do.

    In units of 1 / (n m) the shares of n values end at multiples of m, those of m values at multiples of n; between two
    such ends one value of each is moved onto the other. Nulls are left out; null where a sample is empty.
    """
    known = lambda x: F.array_sort(F.filter(x, lambda v: v.isNotNull()))
    both = F.struct(known(a).alias("x"), known(b).alias("y"))

    def cost(p: Column) -> Column:
        x, y = p["x"], p["y"]
        n, m = F.size(x).cast("bigint"), F.size(y).cast("bigint")
        ends = F.array_sort(F.array_distinct(F.concat(F.transform(x, lambda _, i: (i + 1) * m), F.transform(y, lambda _, j: (j + 1) * n))))

        def step(s: Column, end: Column) -> Column:
            gap = F.element_at(x, (s["at"] / m).cast("int") + 1) - F.element_at(y, (s["at"] / n).cast("int") + 1)
            return F.struct(end.alias("at"), (s["total"] + (end - s["at"]) * gap * gap).alias("total"))

        moved = F.aggregate(ends, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0.0).alias("total")), step, lambda s: s["total"])
        return F.when((n > 0) & (m > 0), moved / (n * m))

    return F.transform(F.array(both), cost)[0]


def bins_of_days(vals: Column, day: int, bin_: int) -> Column:
    """An array of bins, each with one sample a day: the sum of the bin's values on that day, null if one is missing."""
    n = F.floor(F.size(vals) / day).cast("int")
    add = lambda at: F.aggregate(F.slice(vals, at, F.lit(bin_)), F.lit(0.0), lambda s, x: s + x)
    days = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    samples = lambda k: F.transform(days, lambda d: add(d * day + k * bin_ + 1))
    return F.array(*[samples(k) for k in range(day // bin_)])


def binned_transport(a: Column, b: Column) -> Column:
    """The costs of the bins of two profiles (``bins_of_days``) added; a bin that one of them never has counts nothing."""
    costs = F.zip_with(a, b, transport_1d)
    return F.aggregate(costs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def banded(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """Dynamic time warping distances of the rows of x and y, all pairs at once: a step for each cell of the band."""
    n = x.shape[1]
    before = np.full((n + 1, len(x)), np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        now = np.full((n + 1, len(x)), np.inf)
        for j in range(max(1, i - window + 1), min(n, i + window - 1) + 1):
            now[j] = (x[:, i - 1] - y[:, j - 1]) ** 2 + np.minimum(np.minimum(before[j - 1], before[j]), now[j - 1])
        before = now
    return np.sqrt(before[n])


@F.pandas_udf(T.DoubleType())
def dtw(a: pd.Series, b: pd.Series, window: pd.Series) -> pd.Series:
    """Dynamic time warping distance within a band, of pairs of equal-length profiles, a batch at a time."""
    out = np.empty(len(a))
    sizes = np.array([(len(x), w) for x, w in zip(a, window)]).reshape(-1, 2)
    for n, w in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (n, w)).all(axis=1))
        out[at] = banded(*(np.stack(s.to_numpy()[at]).astype(float) for s in (a, b)), int(w))
    return pd.Series(out)


def warping(a: Column, b: Column) -> Column:
    """Dynamic time warping within a band of four."""
    return dtw(a, b, F.lit(4))


#: Distances that numpy measures block by block (``blocks``), equal to the column expression for every pair.
BLOCKWISE = {euclidean: by_blocks.euclidean, squared: by_blocks.squared, missing_aware: by_blocks.missing_aware, missing_aware_to_nine_places: by_blocks.missing_aware_to_nine_places, wasserstein_1d: by_blocks.wasserstein_1d, warping: by_blocks.warping(4)}


#: Rows of a query set up to which it is sent to all tasks; a larger one meets the rows block by block.
SENT_ROWS = 20_000


def meet(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of a stated query set.

    Up to SENT_ROWS queries are sent to the rows, which stay put. More are dealt into blocks of that size by hash, and the
    rows go once to each block, so that what a task holds stays bounded; the number of pairs is what was asked for.
    """
    blocks = -(-queries.count() // SENT_ROWS)
    if blocks <= 1:
        return df.join(F.broadcast(queries))
    q = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).cast("int"))
    return df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, "_block").drop("_block")


def pairs_with_queries(df: DataFrame, queries: DataFrame, key: str, vals: str, distance) -> DataFrame:
    """(query, other, d): a stated set of queries against all rows, block by block where ``distance`` is one of BLOCKWISE."""
    if distance in BLOCKWISE:
        return by_blocks.with_queries(df, queries, key, vals, BLOCKWISE[distance])
    q = queries.select(F.col(key).alias("query"), F.col(vals).alias("_q"))
    return meet(df, q).where(F.col("query") != F.col(key)).select("query", F.col(key).alias("other"), distance(F.col("_q"), F.col(vals)).alias("d"))


#: Least number of blocks into which the rows of a group are dealt, and rows of a block beyond that.
BLOCKS, BLOCK_ROWS = 4, 1_000


def with_blocks(df: DataFrame, shared: list[str]) -> DataFrame:
    """Adds ``_blocks``: how many blocks the row's group is dealt into, so that a block stays small whatever the group's size."""
    sizes = df.groupBy(*[F.col(c).alias(f"_{c}") for c in shared]).agg(F.greatest(F.lit(BLOCKS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("_blocks"))
    same = [df[c].eqNullSafe(sizes[f"_{c}"]) for c in shared]
    return df.join(sizes, same).drop(*[f"_{c}" for c in shared])


def block_pairs(df: DataFrame, shared: list[str], key: str, cols: dict[str, str], blocks: Column) -> DataFrame:
    """Pairs i < j of rows that agree in ``shared``; each of ``cols`` comes as name_a and name_b."""
    own, every = F.pmod(F.xxhash64(key), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    a = df.select(*shared, F.col(key).alias("i"), *[F.col(c).alias(f"{n}_a") for n, c in cols.items()], own.alias("_x"), every.alias("_y"))
    b = df.select(*shared, F.col(key).alias("j"), *[F.col(c).alias(f"{n}_b") for n, c in cols.items()], every.alias("_x"), own.alias("_y"))
    return a.join(b, [*shared, "_x", "_y"]).where("i < j")


def pairs_within(df: DataFrame, group: str, key: str, vals: str, distance, places: int | None = None, grouped: bool = True) -> DataFrame:
    """(group, i, j, d) for i < j of the same group, or (i, j, d): the lower triangle of each group's distance matrix.

    Each group is dealt into blocks by hash, as many as its size asks for, and a row goes to every pair of blocks with its
    own, so a large group's pairs are made by many tasks, each of two blocks of about BLOCK_ROWS rows. The result has a row
    for each pair, so it grows with the square of a group. Distances of BLOCKWISE are measured block by block; ``places`` are
    those of the result.
    """
    if distance in BLOCKWISE:
        return by_blocks.within(df, group, key, vals, BLOCKWISE[distance], places=places, grouped=grouped)
    pairs = block_pairs(with_blocks(df.select(group, key, vals), [group]), [group], key, {"v": vals}, F.col("_blocks"))
    d = distance(F.col("v_a"), F.col("v_b"))
    return pairs.select(*[group][:grouped], "i", "j", (d if places is None else F.round(d, places)).alias("d"))


def pairs_of_groups(df: DataFrame, group: str, key: str, vals: str, distance, blocks: int = 4 * BLOCKS) -> DataFrame:
    """(group_a, group_b, d) for every pair of rows of one sample, each pair once, dealt into blocks by hash."""
    pairs = block_pairs(df, [], key, {"group": group, "v": vals}, F.lit(blocks))
    return pairs.select(F.least("group_a", "group_b").alias("group_a"), F.greatest("group_a", "group_b").alias("group_b"), distance(F.col("v_a"), F.col("v_b")).alias("d"))


def landmarks(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each group, those with the smallest hash of their key; no task orders more than that of a group."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy(group).orderBy("_h", key)
    return df.withColumn("_h", digest).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def pairs_with_landmarks(df: DataFrame, marks: DataFrame, group: str, key: str, vals: str, distance) -> DataFrame:
    """(group, i, j, d): every row with the landmarks of its group but itself, so the work grows with rows, not their square.

    Up to SENT_ROWS landmarks are sent to the rows; more are joined by group. Rows without a group meet none.
    """
    m = marks.select(group, F.col(key).alias("j"), F.col(vals).alias("_m"))
    m = F.broadcast(m) if m.count() <= SENT_ROWS else m
    return df.join(m, group).where(F.col(key) != F.col("j")).select(group, F.col(key).alias("i"), "j", distance(F.col(vals), F.col("_m")).alias("d"))


def landmark_medoids(pairs: DataFrame, group: str) -> DataFrame:
    """(group, medoid, total) from ``pairs_with_landmarks``: the landmark with the smallest sum of distances to its whole group."""
    sums = pairs.groupBy(group, F.col("j").alias("i")).agg(F.round(F.sum("d"), 6).alias("total"))
    return sums.groupBy(group).agg(F.min(F.struct("total", "i")).alias("m")).select(group, F.col("m.i").alias("medoid"), F.col("m.total").alias("total"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each query, ties by id, null distances last."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("d"), "other"))).where(F.col("rank") <= k)


def nearest_to_queries(df: DataFrame, queries: DataFrame, key: str, vals: str, distance, k: int) -> DataFrame:
    """(query, other, d, rank): as ``nearest`` of all rows, of which each block keeps the k nearest of its own only."""
    if distance in BLOCKWISE:
        return nearest(by_blocks.with_queries(df, queries, key, vals, BLOCKWISE[distance], k), k)
    return nearest(pairs_with_queries(df, queries, key, vals, distance), k)


def both_ways(pairs: DataFrame, *keep: str) -> DataFrame:
    return pairs.select(*keep, "i", "j", "d").union(pairs.select(*keep, F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def medoids_within(df: DataFrame, group: str, key: str, vals: str, distance) -> DataFrame:
    """As ``medoids`` of all pairs within groups, whose distances are added where they are measured."""
    return _least_total(by_blocks.sums_within(df, group, key, vals, BLOCKWISE[distance]).withColumn("total", F.round("total", 6)), group)


def medoids(pairs: DataFrame, group: str) -> DataFrame:
    """(group, medoid, total): the member with the smallest sum of distances to its group, ties by id."""
    return _least_total(both_ways(pairs, group).groupBy(group, "i").agg(F.round(F.sum("d"), 6).alias("total")), group)


def _least_total(sums: DataFrame, group: str) -> DataFrame:
    return sums.groupBy(group).agg(F.min(F.struct("total", "i")).alias("m")).select(group, F.col("m.i").alias("medoid"), F.col("m.total").alias("total"))
