"""Spectral clustering of any number of rows by landmarks.

Rows are not compared with each other but with a bounded sample of them, the landmarks. A row is tied to its nearest
landmarks by Gaussian weights that add up to one, and two rows are as alike as the ties that they share, each landmark
counting for less the more it is tied to. In that affinity every row has degree one, so its normalised Laplacian needs no
further scaling and its eigenvectors follow from those of a small matrix of landmarks, summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators.clustering import kmeans


def landmarks_of(df: DataFrame, key: str, vals: str, count: int) -> np.ndarray:
    """Different rows among the ``count`` ones with the smallest hash of their key: at most ``count`` rows reach the driver."""
    rows = df.select(vals, F.xxhash64(key).alias("_h"), F.col(key).alias("_key")).orderBy("_h", "_key").limit(count).select(vals).collect()
    return np.unique(np.array([r[0] for r in rows], float), axis=0) if rows else np.zeros((0, 0))


def apart(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Squared distances of rows to landmarks, a landmark at a time, so a batch needs no rows x landmarks x width cube."""
    return np.column_stack([((x - m) ** 2).sum(axis=1) for m in marks])


def reach_of(marks: np.ndarray, near: int) -> float:
    """The median distance of a landmark to its ``near``-th nearest other one."""
    d = np.sqrt(np.sort(apart(marks, marks), axis=1))
    return float(np.median(d[:, min(near, len(marks) - 1)])) or 1.0


#: Distances of rows to landmarks that are held at once (4 MB).
AT_ONCE = 500_000


def tied(x: pd.Series, marks: np.ndarray, near: int, sigma: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``ties`` for a batch of arrays, so many rows at a time that their distances stay bounded, whatever the batch holds."""
    step = max(1, AT_ONCE // max(1, len(marks)))
    for k in range(0, len(x), step):
        yield ties(np.stack(x.iloc[k : k + step].to_numpy()).astype(float), marks, near, sigma)


def ties(x: np.ndarray, marks: np.ndarray, near: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(landmarks, weights): each row's nearest landmarks, ties to the lower number, and weights that add up to one."""
    d = apart(x, marks)
    # a copy, since a view would keep the whole order of the landmarks
    at = np.argsort(d, axis=1, kind="stable")[:, :near].copy()
    d = np.take_along_axis(d, at, axis=1)
    w = np.exp((d[:, :1] - d) / (2 * sigma * sigma))
    return at, w / w.sum(axis=1, keepdims=True)


def directions(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection, eigenvalues) of the k leading eigenvectors from the summed products of ties; the sign is the largest entry's."""
    degree = sums.sum(axis=1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
    values, vectors = np.linalg.eigh(sums * scale[:, None] * scale[None, :])
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return scale[:, None] * vectors / np.sqrt(np.maximum(values, 1e-12)), values


def embedded(df: DataFrame, key: str, vals: str, k: int, landmarks: int = 500, near: int = 5, sigma: float | None = None, out: str = "place") -> DataFrame:
    """``df`` with ``out``: each row's k spectral coordinates, scaled to length one.

    Rows whose array is null or holds a null or NaN get NULL and shape nothing. Equal rows lie at the same place. Two passes:
    one sums the products of ties by pair of landmarks (at most landmarks ** 2 / 2 sums a task), one places the rows.
    The landmarks and a matrix of landmarks x k are sent to all tasks; both are bounded by the parameters.
    """
    whole = F.col(vals).isNotNull() & ~F.exists(vals, lambda x: x.isNull() | F.isnan(x)) & (F.size(vals) > 0)
    rows = df.where(whole)
    marks = landmarks_of(rows, key, vals, landmarks)
    if not len(marks):
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    m, near = len(marks), min(near, len(marks))
    sigma = reach_of(marks, near) if sigma is None else sigma

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, m))
        for pdf in batches:
            for at, w in tied(pdf[vals], marks, near, sigma):
                for a in range(near):
                    for b in range(near):
                        np.add.at(total, (at[:, a], at[:, b]), w[:, a] * w[:, b])
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    sums = np.zeros((m, m))
    for i, j, s in rows.select(vals).mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[i, j] = sums[j, i] = s
    project, _ = directions(sums, min(k, m))

    @F.pandas_udf("array<double>")
    def place(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        known = x.notna().to_numpy()
        found = pd.Series([None] * len(x), dtype=object, index=x.index)
        if known.any():
            parts = []
            for at, w in tied(x[known], marks, near, sigma):
                p = (project[at] * w[:, :, None]).sum(axis=1)
                parts.append(p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300))
            found[known] = pd.Series(list(np.concatenate(parts)), index=x.index[known])
        return found

    return df.withColumn(out, place(F.when(whole, F.col(vals))))


def spectral(df: DataFrame, key: str, vals: str, k: int, landmarks: int = 500, near: int = 5, sigma: float | None = None, seed: int = 1) -> DataFrame:
    """``df`` with ``part``: a cluster number from 0, by k-means over spectral coordinates; NULL for rows with missing values."""
    placed = embedded(df.select(F.col(key).alias("_k"), F.col(vals).alias("_v")), "_k", "_v", k, landmarks, near, sigma, "_p")
    known = placed.where("_p is not null").select("_k", "_p")
    if known.isEmpty():
        return df.withColumn("part", F.lit(None).cast("int"))
    parts = kmeans(known, "_p", k, seed).select("_k", F.col("kmeans").alias("part"))
    return df.join(parts, df[key] == parts["_k"], "left").drop(parts["_k"])
