"""Local regression and the seasonal-trend decomposition built on it, for whole batches of series of one length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loess(y: np.ndarray, q: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Local lines through the rows of y (series, n) at the places ``at``, which may lie outside 0 to n - 1.

    The q nearest places count (all, over a wider band, if q is more), by tricube weights times ``weights``. Where no place
    has a weight, the nearest value stands. Sums over the q places are added a place at a time, for all of ``at`` together.
    """
    n = y.shape[1]
    size = min(q, n)
    left = np.clip(at - size // 2, 0, n - size)
    x = (left[:, None] + np.arange(size) - at[:, None]).astype(float)
    reach = np.maximum(np.abs(x[:, 0]), np.abs(x[:, -1]))[:, None] + max(0, q - n) // 2
    near = np.where(np.abs(x) <= 0.999 * reach, (1 - np.minimum(np.abs(x) / np.maximum(reach, 1e-12), 1) ** 3) ** 3, 0.0)
    # places by series, so that a place's values lie together; weights may be one row for all series
    wy, weights = np.ascontiguousarray((weights * y).T), np.ascontiguousarray(weights.T)
    w, w_x, w_xx = (np.zeros((len(at), weights.shape[1])) for _ in range(3))
    v, v_x = (np.zeros((len(at), len(y))) for _ in range(2))
    for k in range(size):
        tricube, gap = near[:, k, None], x[:, k, None]
        own = np.take(weights, left + k, axis=0)
        own *= tricube
        w += own
        own *= gap
        w_x += own
        own *= gap
        w_xx += own
        value = np.take(wy, left + k, axis=0)
        value *= tricube
        v += value
        value *= gap
        v_x += value
    found = w > 0
    total = np.where(found, w, 1)
    for z in (w_x, w_xx, v, v_x):
        z /= total
    spread = np.maximum(w_xx - w_x * w_x, 0)
    slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (v_x - w_x * v) / np.where(spread > 0, spread, 1), 0.0)
    return np.ascontiguousarray(np.where(found, v - w_x * slope, y.T[np.clip(at, 0, n - 1)]).T)


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate((np.zeros((len(y), 1)), np.cumsum(y, axis=1)), axis=1)
    return (total[:, n:] - total[:, :-n]) / n


def odd_from(x: float) -> int:
    """The least odd number at or above x."""
    n = int(np.ceil(x))
    return n + (n + 1) % 2


def stl(y: np.ndarray, period: int, seasonal: int, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, robustness weights) of the rows of y (series, n), at least two periods long.

    Each inner pass smooths the series of every phase over ``seasonal`` periods, takes away what of that is slow, and
    smooths the rest for the trend; after each of ``outer`` passes values far from the fit lose weight (bisquare).
    """
    n, all_ = y.shape[1], np.arange(y.shape[1])
    slow, wide = odd_from(period + 1), odd_from(1.5 * period / (1 - 1.5 / seasonal))
    trend, season, weights, even = np.zeros_like(y), np.zeros_like(y), np.ones_like(y), np.ones((1, n))
    for _ in range(max(1, outer)):
        for _ in range(inner):
            cycle = np.empty((len(y), n + 2 * period))
            for phase in range(period):
                own = (y - trend)[:, phase::period]
                cycle[:, phase::period] = loess(own, seasonal, np.arange(-1, own.shape[1] + 1), weights[:, phase::period])
            low = loess(_moving(_moving(_moving(cycle, period), period), 3), slow, all_, even)
            season = cycle[:, period : period + n] - low
            trend = loess(y - season, wide, all_, weights)
        if not outer:
            break
        rest = np.abs(y - trend - season)
        far = 6 * np.median(rest, axis=1, keepdims=True)
        u = rest / np.where(far > 0, far, 1)
        weights = np.where(far > 0, np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0)), 1.0)
    return trend, season, weights


#: Series that are decomposed at once.
AT_ONCE = 32


def decompose_stl(df: DataFrame, key: str, vals: str, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> DataFrame:
    """(key, trend, season, rest), arrays beside each series ``vals``; batches of series are worked through at once.

    Nulls within a series count as its mean; a series of fewer than two periods, or a null one, has nulls for arrays.
    """
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, trend array<double>, season array<double>, rest array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                series = [None if x is None or len(x) < 2 * period else np.array(x, float) for x in part.column(1).to_pylist()]
                out: list[list] = [[None] * len(series) for _ in range(3)]
                for n in {len(x) for x in series if x is not None}:
                    own = [i for i, x in enumerate(series) if x is not None and len(x) == n]
                    y = np.stack([series[i] for i in own])
                    known = ~np.isnan(y)
                    mean = np.where(known, y, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
                    y = np.where(known, y, mean[:, None])
                    trend, season, _ = stl(y, period, seasonal, inner, outer)
                    for column, found in zip(out, (trend, season, y - trend - season)):
                        for i, row in zip(own, found):
                            column[i] = row.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.list_(pa.float64())) for c in out]], names=[key, "trend", "season", "rest"])

    return df.select(key, F.col(vals).cast("array<double>").alias("_vals")).mapInArrow(run, schema)
