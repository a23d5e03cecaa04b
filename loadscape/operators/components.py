"""Non-negative components of groups of profiles, and how far the components of two groups lie apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.distance import banded, pairs_of_groups
from loadscape.operators.graph import cut

#: Added to divisors, and to the first components, so that no number is stuck at zero.
LEAST = 1e-9


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's uses of its group's components after one multiplicative step."""
    for batch in batches:
        x, w, h = (batch.column(c).to_pylist() for c in ("x", "w", "h"))
        out = []
        for row, use, flat in zip(x, w, h):
            row, parts = np.maximum(row, 0), np.reshape(flat, (-1, len(row)))
            use = np.ones(len(parts)) if use is None else np.array(use)
            out.append((use * (parts @ row) / (parts @ (use @ parts) + LEAST)).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("x"), pa.array(out, pa.list_(pa.float64()))], names=["g", "x", "w"])


def _sums(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By group: uses times rows, uses times uses, and the squares of the rows, one number a place."""
        found: dict = {}
        for batch in batches:
            for g, x, w in zip(*(batch.column(c).to_pylist() for c in ("g", "x", "w"))):
                x, w = np.maximum(x, 0), np.array(w)
                found[g] = found.get(g, 0) + np.concatenate((np.outer(w, x).ravel(), np.outer(w, w).ravel(), w, [x @ x]))
        for g, numbers in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(numbers), kind), pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], names=["g", "place", "v"])

    return run


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's components after one multiplicative step, how much each is used, and the loss before the step."""
    for batch in batches:
        flat, uses, losses = [], [], []
        for h, v, width in zip(*(batch.column(c).to_pylist() for c in ("h", "v", "width"))):
            h, v = np.reshape(h, (-1, width)), np.array(v)
            k = len(h)
            wx, ww, w, xx = v[: k * width].reshape(k, width), v[k * width : k * (width + k)].reshape(k, k), v[-1 - k : -1], v[-1]
            losses.append(float(xx - 2 * (h * wx).sum() + (ww * (h @ h.T)).sum()))
            flat.append((h * wx / (ww @ h + LEAST)).ravel().tolist())
            uses.append(w.tolist())
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(flat, pa.list_(pa.float64())), pa.array(uses, pa.list_(pa.float64())), pa.array(losses, pa.float64())], names=["g", "h", "uses", "loss"])


def factorised(df: DataFrame, group: str, key: str, vals: str, k: int, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(components, losses): (group, h, uses) with k components of each group behind each other in ``h`` and how much each
    is used by all rows, and (group, round, loss), the squared error after each round's new uses, which never rises.

    Rows and their uses stay in a written table; each round adds up components times rows within tasks and comes back as
    sums by group and place, so no group meets in one task. The first components are the k rows with the smallest hash of
    their key; fewer rows give fewer. Values below zero count as zero; null groups, null rows and rows with a null or of
    another length than the group's first are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(df.dtypes)[group]
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vals).cast("array<double>").alias("x"))
    rows = rows.where("g is not null and x is not null and not exists(x, v -> v is null)")
    order = Window.partitionBy("g").orderBy(F.xxhash64(F.lit("components"), "id"), "id")
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    width = first.where("_r = 1").select("g", F.size("x").alias("width"))
    start = first.join(width, "g").where("size(x) = width").groupBy("g", "width").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", "x"))), lambda p: p["x"])).alias("h"))
    parts = cut(start.select("g", "width", F.transform("h", lambda v: F.greatest(v, F.lit(0.0)) + 0.01).alias("h"), F.lit(None).cast("array<double>").alias("uses")))
    held = cut(rows.join(width, "g").where("size(x) = width").select("g", "x", F.lit(None).cast("array<double>").alias("w")))
    arrow, losses = to_arrow_type(rows.schema["g"].dataType), None
    for r in range(rounds):
        held = cut(held.join(parts.select("g", "h"), "g").select("g", "x", "w", "h").mapInArrow(_uses, f"g {kind}, x array<double>, w array<double>"))
        sums = held.mapInArrow(_sums(arrow), f"g {kind}, place int, v double").groupBy("g", "place").agg(F.sum("v").alias("v"))
        sums = sums.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p["v"]).alias("v"))
        after = cut(sums.join(parts.select("g", "width", "h"), "g").select("g", "h", "v", "width").mapInArrow(_components, f"g {kind}, h array<double>, uses array<double>, loss double"))
        now = after.select("g", F.lit(r).alias("round"), "loss")
        losses = now if losses is None else losses.union(now)
        parts = cut(after.join(parts.select("g", "width"), "g").select("g", "width", "h", "uses"))
    return parts.select(F.col("g").alias(group), "width", "h", "uses"), losses.select(F.col("g").alias(group), "round", "loss")


def matched(cost: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Mean cost when the nearest two are matched as far as both last, then the next nearest, until a side is used up."""
    left, right, total, moved = left.astype(float), right.astype(float), 0.0, 0.0
    for place in np.argsort(cost, axis=None, kind="stable"):
        i, j = divmod(int(place), cost.shape[1])
        amount = min(left[i], right[j])
        total, moved = total + amount * cost[i, j], moved + amount
        left[i] -= amount
        right[j] -= amount
    return total / moved if moved else 0.0


def component_distances(components: DataFrame, group: str, window: int = 4) -> DataFrame:
    """(group_a, group_b, d) for every two groups of ``factorised``: components, each scaled to a largest value of 1 and
    weighing what it adds to all rows, are matched greedily by their warping distance; a batch of pairs at a time."""

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            sides = []
            for flat in (np.asarray(x, float), np.asarray(y, float)):
                width = int(flat[0])
                k = (len(flat) - 1) // (width + 1)
                h, uses = flat[1 : 1 + k * width].reshape(k, width), flat[1 + k * width :]
                top = np.maximum(h.max(axis=1), LEAST)
                sides.append((h / top[:, None], uses * top))
            (h, u), (g, v) = sides
            cost = banded(np.repeat(h, len(g), axis=0), np.tile(g, (len(h), 1)), window).reshape(len(h), len(g))
            out.append(matched(cost, u / max(u.sum(), LEAST), v / max(v.sum(), LEAST)))
        return pd.Series(out, dtype=float)

    packed = components.select(group, F.concat(F.array(F.col("width").cast("double")), "h", "uses").alias("_packed"))
    return pairs_of_groups(packed.withColumn("_key", F.col(group)), group, "_key", "_packed", apart)
