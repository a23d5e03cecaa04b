"""Clusterings by shape: barycentres under time warping, and k-shape by normalised cross-correlation.

Every round adds up within each batch and comes back as sums for each cluster and slot, so no cluster meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators.graph import cut

#: Rows whose warping tables are held at once.
ROWS = 256


def warped(centre: np.ndarray, x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x (rows, n) laid along their rows of ``centre``: (sums, counts, cost).

    The cheapest path within the band, its cost in squared differences; sums and counts say what each slot of the centre
    is met by. Ties take the diagonal, then the step in x.
    """
    rows, n = centre.shape
    cost = np.full((n + 1, n + 1, rows), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - window + 1), min(n, i + window - 1) + 1):
            cost[i, j] = (centre[:, i - 1] - x[:, j - 1]) ** 2 + np.minimum(np.minimum(cost[i - 1, j - 1], cost[i, j - 1]), cost[i - 1, j])
    sums, counts, at = np.zeros((rows, n)), np.zeros((rows, n), np.int64), np.arange(rows)
    i, j = np.full(rows, n), np.full(rows, n)
    open_ = i > 0
    while open_.any():
        own, a, b = at[open_], i[open_], j[open_]
        np.add.at(sums, (own, a - 1), x[own, b - 1])
        np.add.at(counts, (own, a - 1), 1)
        before = np.stack([cost[a - 1, b - 1, own], cost[a, b - 1, own], cost[a - 1, b, own]]).argmin(axis=0)
        i[open_], j[open_] = a - (before != 1), b - (before != 2)
        open_ = (i > 0) & (j > 0)
    return sums, counts, cost[n, n]


def barycentres(df: DataFrame, cluster: str, vals: str, rounds: int = 5, window: int = 4) -> tuple[DataFrame, DataFrame]:
    """(centres, inertias): (cluster, centre) after ``rounds`` rounds from the mean, and (cluster, round, inertia) of the
    centres that each round began with.

    Every member is laid along its cluster's centre, and each slot becomes the mean of what it is met by, which never
    raises the inertia. Null profiles, and profiles with a null or of another length than their cluster's mean, count
    nothing.
    """
    kind = dict(df.dtypes)[cluster]
    rows = df.select(F.col(cluster).alias("c"), F.col(vals).cast("array<double>").alias("x")).where("c is not null and x is not null and not exists(x, v -> v is null)")
    means = rows.select("c", F.posexplode("x").alias("slot", "v")).groupBy("c", "slot").agg(F.avg("v").alias("v"))
    as_arrays = lambda d: d.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda p: p["v"]).alias("m"))
    centres, inertias = cut(as_arrays(means)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, x, m = (part.column(k).to_pylist() for k in range(3))
                for n in {len(v) for v in x}:
                    own = [i for i, v in enumerate(x) if len(v) == n]
                    sums, counts, cost = warped(np.array([m[i] for i in own]), np.array([x[i] for i in own]), window)
                    for k, i in enumerate(own):
                        old = found.get(names[i], (0.0, 0, 0.0))
                        found[names[i]] = old[0] + sums[k], old[1] + counts[k], old[2] + cost[k]
        for name, (sums, counts, cost) in found.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (n + 1), kind_), pa.array([*range(n), -1], pa.int32()), pa.array([*sums, cost]), pa.array([*counts, 1], pa.int64())], names=["c", "slot", "v", "n"])

    for r in range(rounds):
        met = rows.join(centres, "c").where(F.size("x") == F.size("m"))
        from pyspark.sql.pandas.types import to_arrow_type

        kind_ = to_arrow_type(met.schema["c"].dataType)
        sums = cut(met.select("c", "x", "m").mapInArrow(run, f"c {kind}, slot int, v double, n bigint").groupBy("c", "slot").agg(F.sum("v").alias("v"), F.sum("n").alias("n")))
        now = sums.where("slot < 0").select("c", F.lit(r).alias("round"), F.col("v").alias("inertia"))
        inertias = now if inertias is None else inertias.union(now)
        centres = cut(as_arrays(sums.where("slot >= 0").select("c", "slot", (F.col("v") / F.col("n")).alias("v"))))
    return centres.select(F.col("c").alias(cluster), F.col("m").alias("centre")), inertias.select(F.col("c").alias(cluster), "round", "inertia")


def standard(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and deviation 1; a constant row is zero."""
    spread = x.std(axis=1, keepdims=True)
    return np.where(spread > 1e-12, (x - x.mean(axis=1, keepdims=True)) / np.where(spread > 1e-12, spread, 1), 0.0)


def shape_distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, centres) of 1 less the largest normalised cross-correlation, and the shift at which x meets it."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    a, b = np.fft.rfft(x, size), np.fft.rfft(centres, size)
    cross = np.fft.irfft(b[None] * np.conj(a)[:, None], size)
    cross = np.concatenate((cross[..., -(n - 1) :] if n > 1 else cross[..., :0], cross[..., :n]), axis=2)
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None]
    share = cross / np.where(scale > 0, scale, 1)[:, :, None]
    return 1 - share.max(axis=2), share.argmax(axis=2) - (n - 1)


def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows moved on by so many slots, zeros coming in."""
    place = np.arange(x.shape[1])[None] - by[:, None]
    return np.where((place >= 0) & (place < x.shape[1]), np.take_along_axis(x, np.clip(place, 0, x.shape[1] - 1), axis=1), 0.0)


def extracted(products: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The shape whose squared similarity to all members is largest: the leading eigenvector of their summed outer
    products about the mean, its sign that of the members' mean."""
    n = len(products)
    centring = np.eye(n) - 1 / n
    shape = np.linalg.eigh(centring @ products @ centring)[1][:, -1]
    return standard((shape if shape @ mean >= 0 else -shape)[None])[0]


def k_shape(df: DataFrame, key: str, vals: str, k: int, rounds: int = 10, starts: int = 3) -> DataFrame:
    """(key, shape, d): profiles of one length in k clusters by shape, whatever their level, scale and shift.

    Starts from a deal of the rows by hash; of so many ``starts`` the one is taken whose distances add up to least. Each
    round lays members along their cluster's shape and takes a new one from
    the sums of their outer products: k times the width squared numbers come to the driver. Profiles with a null, null
    ones and those of another length than the smallest key's have shape null. An empty cluster keeps its shape.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vals).cast("array<double>").alias("x"))
    first = rows.where("x is not null").select(F.min_by(F.size("x"), "id").alias("n")).first()
    width = (first.n if first else None) or 0
    whole = rows.where(F.col("x").isNotNull() & (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull()))
    kind = dict(df.dtypes)[key]
    def sums(shapes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            products, total, n = np.zeros((k, width, width)), np.zeros((k, width)), np.zeros(k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = standard(np.array(batch.column(1).to_pylist(), float))
                if shapes is None:
                    label = batch.column(0).to_numpy()
                else:
                    d, by = shape_distances(x, shapes)
                    label = d.argmin(axis=1)
                    x = shifted(x, by[np.arange(len(x)), label])
                for c in np.unique(label):
                    own = x[label == c]
                    products[c] += own.T @ own
                    total[c] += own.sum(axis=0)
                    n[c] += len(own)
            for c in np.flatnonzero(n):
                numbers = np.concatenate((products[c].ravel(), total[c]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), c, np.int32)), pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], names=["c", "place", "v"])

        return run

    def fitted(seed: int) -> np.ndarray:
        start = whole.select(F.pmod(F.xxhash64(F.lit(f"k-shape {seed}"), "id"), F.lit(k)).cast("int").alias("c"), "x")
        centres = np.zeros((k, width))
        for r in range(rounds):
            found = start.mapInArrow(sums(centres if r else None), "c int, place int, v double").groupBy("c", "place").agg(F.sum("v").alias("v")).toArrow()
            table, after = np.zeros((k, width * width + width)), centres.copy()
            table[found.column("c").to_numpy(), found.column("place").to_numpy()] = found.column("v").to_numpy()
            for c in set(found.column("c").to_pylist()):
                after[c] = extracted(table[c, : width * width].reshape(width, width), table[c, width * width :])
            if r and np.abs(after - centres).max() < 1e-9:
                break
            centres = after
        return centres

    def given(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d, _ = shape_distances(standard(np.array(batch.column(1).to_pylist(), float)), centres)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["id", "shape", "d"])

        return whole.mapInArrow(run, f"id {kind}, shape int, d double")

    found = [fitted(s) for s in range(starts)] if width else []
    best = min(found, key=lambda c: given(c).agg(F.sum("d")).first()[0] or 0.0) if len(found) > 1 else next(iter(found), None)
    out = given(best) if width else whole.select("id", F.lit(None).cast("int").alias("shape"), F.lit(None).cast("double").alias("d"))
    rest = rows.where(F.col("x").isNull() | (F.size("x") != width) | F.exists("x", lambda v: v.isNull())).select("id", F.lit(None).cast("int"), F.lit(None).cast("double"))
    return out.union(rest).toDF(key, "shape", "d")
