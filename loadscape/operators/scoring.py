"""Scores of probabilistic scenarios. Scenarios are (day, slot, s, value), observations (day, slot, y)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators import blocks
from loadscape.operators.counted import counted
from loadscape.operators.counted import quantiles as counted_quantiles
from loadscape.operators.distance import euclidean, meet


def energy_score(samples: DataFrame, observed: DataFrame) -> DataFrame:
    """(test_id, es) from samples (test_id, s, p, vals) and observed (test_id, y).

    Sum of p |x - y| less half the sum of p p' |x - x'|. Samples meet only within their test, dealt into blocks by its size,
    so the pairs of a large test are made by many tasks.
    """
    near = samples.join(observed, "test_id").groupBy("test_id").agg(F.sum(F.col("p") * euclidean(F.col("vals"), F.col("y"))).alias("a"))
    spread = blocks.sums_within(samples, "test_id", "s", "vals", blocks.euclidean, "p").groupBy("test_id").agg((F.sum("total") / 2).alias("b"))
    return near.join(spread, "test_id", "left").select("test_id", (F.col("a") - F.coalesce("b", F.lit(0.0))).alias("es"))


def variogram_score(scenarios: DataFrame, observed: DataFrame, beta: float = 0.5) -> DataFrame:
    """(day, vs): over all ordered slot pairs the squared gap between observed and mean scenario |difference| ** beta."""
    a = scenarios.select("day", "s", F.col("slot").alias("k1"), F.col("value").alias("v1"))
    b = scenarios.select("day", "s", F.col("slot").alias("k2"), F.col("value").alias("v2"))
    mean = a.join(b, ["day", "s"]).groupBy("day", "k1", "k2").agg(F.avg(F.pow(F.abs(F.col("v1") - F.col("v2")), F.lit(beta))).alias("m"))
    y1 = observed.select("day", F.col("slot").alias("k1"), F.col("y").alias("y1"))
    y2 = observed.select("day", F.col("slot").alias("k2"), F.col("y").alias("y2"))
    gap = F.pow(F.abs(F.col("y1") - F.col("y2")), F.lit(beta)) - F.col("m")
    return mean.join(y1, ["day", "k1"]).join(y2, ["day", "k2"]).groupBy("day").agg(F.sum(gap * gap).alias("vs"))


def crps(scenarios: DataFrame, observed: DataFrame) -> DataFrame:
    """(day, slot, crps): mean |x - y| less the mean pair gap, from the order of the scenarios instead of their pairs.

    Equal values are counted first and ordered range by range, so a day of very many scenarios is the work of many tasks.
    """
    rows = counted(scenarios, "value", ["day", "slot"])
    n, total = F.col("n"), F.col("total").cast("double")
    spread = F.sum(n * (2 * F.col("below") + n - F.col("total")) * F.col("value") / (total * total))
    near = F.sum(n * F.abs(F.col("value") - F.col("y")) / total)
    return rows.join(observed, ["day", "slot"]).groupBy("day", "slot").agg((near - spread).alias("crps"))


def quantiles(scenarios: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(day, slot, q, value) with linear quantiles of the scenarios, from counts ordered range by range."""
    return counted_quantiles(scenarios, "value", levels, ["day", "slot"]).withColumnRenamed("level", "q")


def empirical_cdf(df: DataFrame, col: str, by: Sequence[str], out: str) -> DataFrame:
    """Adds the share of the group's rows that lie at or below the row's value; NULL where the value is null."""
    found = counted(df, col, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("value").alias("_x"), ((F.col("below") + F.col("n")) / F.col("total")).alias(out))
    same = F.col(col) == F.col("_x")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(found, same, "left").drop("_x", *[f"_{c}" for c in by])


def pinball(quantile_rows: DataFrame, observed: DataFrame, by: str = "q") -> DataFrame:
    """(by, loss): 100 times the mean pinball loss."""
    gap = F.col("y") - F.col("value")
    loss = F.when(gap >= 0, F.col("q") * gap).otherwise((F.col("q") - 1) * gap)
    return quantile_rows.join(observed, ["day", "slot"]).groupBy(by).agg((100 * F.avg(loss)).alias("loss"))


def reliability(quantile_rows: DataFrame, observed: DataFrame) -> DataFrame:
    """(q, share): percent of observations strictly below each quantile."""
    return quantile_rows.join(observed, ["day", "slot"]).groupBy("q").agg((100 * F.avg((F.col("y") < F.col("value")).cast("double"))).alias("share"))


def mmd2(x: DataFrame, y: DataFrame, vals: str, sigma: float) -> DataFrame:
    """One row: squared maximum mean discrepancy with a Gaussian kernel, the diagonals included.

    Every row meets every other one, so both sets should be samples; a large one is met block by block.
    """
    a, b = (d.select(F.col(vals).alias("v")) for d in (x, y))

    def total(p: DataFrame, q: DataFrame) -> DataFrame:
        d = euclidean(F.col("v"), F.col("w"))
        return meet(p, q.withColumnRenamed("v", "w")).agg(F.sum(F.exp(-d * d / (2 * sigma * sigma))).alias("t"), F.count(F.lit(1)).alias("n"))

    xx, yy, xy = total(a, a), total(b, b), total(a, b)
    off = lambda c: F.col(c) - F.sqrt(F.col(c))  # noqa: E731  n(n-1) from n*n
    rows = xx.select(F.col("t").alias("t1"), F.col("n").alias("n1")).join(yy.select(F.col("t").alias("t2"), F.col("n").alias("n2"))).join(xy.select(F.col("t").alias("t3"), F.col("n").alias("n3")))
    return rows.select((F.col("t1") / off("n1") + F.col("t2") / off("n2") - 2 * F.col("t3") / F.col("n3")).alias("mmd2"))


def mmd2_of_groups(df: DataFrame, group: str, key: str, vals: str, sigma: float) -> DataFrame:
    """(x, y, mmd2) for x < y: as ``mmd2`` between every two groups of a sample; all pairs of its rows are made once.

    What a group has within itself comes by windows over the sums: joined with them, they would be made again for each side.
    """
    sums = blocks.kernel_sums(df, group, key, vals, sigma)
    within = lambda c: F.coalesce(F.max(F.when(F.col("group_a") == F.col("group_b"), F.col("t"))).over(Window.partitionBy(c)), F.lit(0.0))
    sums = sums.withColumns({"t_x": within("group_a"), "t_y": within("group_b")}).where("group_a < group_b")
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    x, y = (sizes.select(F.col("g").alias(s), F.col("n").alias(f"n_{s}")) for s in "xy")
    own = lambda s: (2 * F.col(f"t_{s}") + F.col(f"n_{s}")) / (F.col(f"n_{s}") * (F.col(f"n_{s}") - 1))
    apart = sums.select(F.col("group_a").alias("x"), F.col("group_b").alias("y"), "t", "t_x", "t_y").join(x, "x").join(y, "y")
    return apart.select("x", "y", (own("x") + own("y") - 2 * F.col("t") / (F.col("n_x") * F.col("n_y"))).alias("mmd2"))


def diebold_mariano(losses: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """mean_d, n and statistic of the one-sided test that losses ``a`` exceed ``b``; NULL where they never differ."""
    d = F.col(a) - F.col(b)
    stats = (losses.groupBy(by) if by else losses).agg(F.avg(d).alias("mean_d"), F.count(d).alias("n"), F.var_pop(d).alias("_v"))
    return stats.withColumn("statistic", F.try_divide(F.col("mean_d"), F.sqrt(F.col("_v") / F.col("n")))).drop("_v")


#: Hart's rational approximation of the normal distribution, double precision.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def upper_tail(z: Column) -> Column:
    """1 - normal CDF as a column expression, within 1e-14; NULL for NULL."""
    x = F.abs(z)
    polynomial = lambda cs: reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0]))
    density = F.exp(-x * x / 2)
    far = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + 0.65)
    tail = F.when(x < 7.07106781186547, density * polynomial(HART_TOP) / polynomial(HART_BOTTOM)).otherwise(density / far / math.sqrt(2 * math.pi))
    return F.when(z.isNotNull(), F.when(z >= 0, tail).otherwise(1 - tail))


def losses_of_cases(losses: DataFrame, case: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(case, a column a model): the mean of each model's absolute scores over a case's periods, for the multivariate test."""
    return losses.groupBy(*case).agg(*[F.avg(F.abs(F.col(m))).alias(m) for m in models])


def diebold_mariano_pairs(losses: DataFrame, models: Sequence[str]) -> DataFrame:
    """(a, b, mean_d, n, statistic, p) for every ordered pair of models, a column of scores each; one pass over the rows.

    p is the chance under equal accuracy of a statistic at least as large, so a small p says that b is better than a. Cases
    without one of the two scores are left out of their pair; statistic and p are NULL where the two never differ.
    """
    pairs = [(a, b) for a in models for b in models if a != b]
    sums = []
    for i, (a, b) in enumerate(pairs):
        d = F.col(a) - F.col(b)
        sums += [F.avg(d).alias(f"m{i}"), F.count(d).alias(f"n{i}"), F.var_pop(d).alias(f"v{i}")]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{i}").alias("mean_d"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v")) for i, (a, b) in enumerate(pairs)]
    found = losses.agg(*sums).select(F.inline(F.array(*rows)))
    found = found.withColumn("statistic", F.try_divide(F.col("mean_d"), F.sqrt(F.col("v") / F.col("n")))).drop("v")
    return found.withColumn("p", upper_tail(F.col("statistic")))
