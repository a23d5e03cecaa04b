"""Rank statistics, confusion matrices and smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators.counted import counted, running


def with_average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the average rank of a column over all rows. Equal values are counted first, distinct ones ranked range by range."""
    ranks = counted(df, col).select(F.col("value").alias("_x"), (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("_x"), "left").drop("_x")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return with_average_rank(with_average_rank(df.select(x, y), x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("rho"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties half; NULL without both."""
    s = with_average_rank(df.select(score, label), score, "_r").agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    return s.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, positives, precision, recall, fall_out) at every distinct score: rows at or above it are taken as positive.

    ``positives`` are those with just that score. Rows without a score or label are left out; recall is NULL without positives,
    fall_out without negatives.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    rows = running(counts, "threshold", ["pos", "n"])
    hit, taken = F.col("pos_total") - F.col("pos_below"), F.col("n_total") - F.col("n_below")
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    return rows.select("threshold", F.col("pos").alias("positives"), share(hit, taken).alias("precision"), share(hit, F.col("pos_total")).alias("recall"), share(taken - hit, F.col("n_total") - F.col("pos_total")).alias("fall_out"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: precision at each score, weighted by how much recall it adds; NULL without positives."""
    curve = threshold_curve(df, score, label)
    return curve.agg(F.try_divide(F.sum(F.col("positives") * F.col("precision")), F.sum("positives")).alias("average_precision"))


def class_aucs(scores: DataFrame, classes: Sequence) -> DataFrame:
    """(cls, n, ovr, ovo) from (truth, cls, p): how well a class's score sets its members apart, ties half.

    ``ovr`` against all other rows, ``ovo`` the mean over each other class alone. Scores are counted by true class and run up
    range by range, so no pairs are made. NULL where a side is empty.
    """
    held = {f"c{k}": F.count_if(F.col("truth") == c) for k, c in enumerate(classes)}
    counts = scores.where("p is not null").groupBy("cls", "p").agg(*[n.alias(c) for c, n in held.items()])
    rows = running(counts, "p", list(held), ["cls"])
    own = reduce(lambda acc, kc: F.when(F.col("cls") == kc[1], F.col(f"c{kc[0]}")).otherwise(acc), enumerate(classes), F.lit(0))
    sums = rows.groupBy("cls").agg(*[F.sum(own * (F.col(f"{c}_below") + F.col(c) / 2)).alias(f"s_{c}") for c in held], *[F.max(f"{c}_total").alias(f"n_{c}") for c in held])
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"s_c{k}").alias("s"), F.col(f"n_c{k}").cast("double").alias("n")) for k, c in enumerate(classes)])
    long = sums.select("cls", F.explode(pairs).alias("x")).select("cls", "x.*")
    mine = F.max(F.when(F.col("c") == F.col("cls"), F.col("n")))
    other = F.col("c") != F.col("cls")
    found = long.groupBy("cls").agg(mine.alias("n"), F.sum(F.when(other, F.col("s"))).alias("s"), F.sum(F.when(other, F.col("n"))).alias("rest"), F.avg(F.when(other, F.try_divide(F.col("s"), F.col("n")))).alias("each"))
    return found.select("cls", F.col("n").cast("long").alias("n"), F.try_divide(F.col("s"), F.col("n") * F.col("rest")).alias("ovr"), F.try_divide(F.col("each"), F.col("n")).alias("ovo"))


def inspection(scores: DataFrame, key: str, classes: Sequence) -> DataFrame:
    """One row from (key, truth, cls, p), a row for each class: accuracy, balanced_accuracy, log_loss, auc_ovr, auc_ovo.

    The guess is the likeliest class, ties to the smaller one; balanced accuracy and both areas are means over classes.
    """
    guess = F.min_by("cls", F.struct(-F.col("p"), F.col("cls")))
    given = F.max(F.when(F.col("cls") == F.col("truth"), F.col("p")))
    rows = scores.groupBy(key, "truth").agg(guess.alias("guess"), F.coalesce(given, F.lit(0.0)).alias("p"))
    hit = (F.col("guess") == F.col("truth")).cast("long")
    by_class = rows.groupBy("truth").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.sum(-F.ln(F.greatest("p", F.lit(1e-15)))).alias("loss"))
    all_ = by_class.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"))
    return all_.join(class_aucs(scores, classes).agg(F.avg("ovr").alias("auc_ovr"), F.avg("ovo").alias("auc_ovo")))


def confusion(df: DataFrame, truth: str, guess: str, mass: str, classes: list) -> DataFrame:
    """A row for each true class with the share of its mass that went to each guessed class, missing ones 0."""
    wide = df.groupBy(truth).pivot(guess, classes).agg(F.sum(mass)).na.fill(0.0)
    total = sum((F.col(f"`{c}`") for c in classes), F.lit(0.0))
    return wide.select(truth, *[F.try_divide(F.col(f"`{c}`"), total).alias(str(c)) for c in classes])


def smooth(df: DataFrame, vals: str, sigma: float) -> DataFrame:
    """Adds ``smooth``: Gaussian weights within four deviations, renormalised at the ends."""
    reach = int(4 * sigma)
    weights = F.array(*[F.lit(math.exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)])

    def at(i):
        ks = F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: (i + k >= 0) & (i + k < F.size(vals)))
        weight = lambda k: F.get(weights, k + reach)
        top = F.aggregate(ks, F.lit(0.0), lambda a, k: a + F.get(F.col(vals), i + k) * weight(k))
        return top / F.aggregate(ks, F.lit(0.0), lambda a, k: a + weight(k))

    return df.withColumn("smooth", F.transform(F.sequence(F.lit(0), F.size(vals) - 1), at))
