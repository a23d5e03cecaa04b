"""Spectral clustering by landmarks."""

import numpy as np

from loadscape.operators import spectral


def _rings(n):
    r = np.random.default_rng(3)
    t, k = r.uniform(0, 2 * np.pi, n), np.arange(n) % 2
    return [(i, int(k[i]), [float((1 + k[i] * 1.5) * np.cos(t[i]) + r.normal() / 30), float((1 + k[i] * 1.5) * np.sin(t[i]) + r.normal() / 30)]) for i in range(n)]


def test_two_rings_split(spark):
    rows = spark.createDataFrame(_rings(3000), "id bigint, ring int, v array<double>").repartition(6)
    found = spectral.spectral(rows, "id", "v", 2, landmarks=300, near=4).groupBy("ring", "part").count().collect()
    assert len(found) == 2 and len({r.part for r in found}) == 2


def test_places_are_the_eigenvectors_of_the_whole_affinity(spark):
    rows = _rings(200)
    df = spark.createDataFrame(rows, "id bigint, ring int, v array<double>").repartition(5)
    got = {r.id: r.place for r in spectral.embedded(df, "id", "v", 3, landmarks=40, near=4, sigma=0.8).collect()}
    marks, x = spectral.landmarks_of(df, "id", "v", 40), np.array([r[2] for r in rows])
    z = np.zeros((len(x), len(marks)))
    for i, p in enumerate(x):
        d = ((p - marks) ** 2).sum(axis=1)
        for j in np.argsort(d)[:4]:
            z[i, j] = np.exp(-d[j] / (2 * 0.8**2))
        z[i] /= z[i].sum()
    affinity = z @ np.diag(1 / z.sum(axis=0)) @ z.T
    assert np.allclose(affinity.sum(axis=1), 1)
    values, vectors = np.linalg.eigh(affinity)
    want = vectors[:, ::-1][:, :3]
    assert values[-3] - values[-4] > 1e-6
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    have = np.array([got[i] for i in range(len(x))])
    # the space of the leading eigenvectors is the same, whatever its basis: products of places agree
    assert np.allclose(np.abs(have @ have.T), np.abs(want @ want.T), atol=1e-6)


def test_odd_rows(spark):
    schema = "id bigint, v array<double>, _k int"
    rows = [(1, [0.0, 0.0], 5), (2, [0.0, 0.0], 6), (3, None, 7), (4, [1.0, None], 8), (5, [9.0, 9.0], 9), (6, [float("nan"), 1.0], 1)]
    found = {r.id: r.part for r in spectral.spectral(spark.createDataFrame(rows, schema), "id", "v", 2, near=1).collect()}
    assert found[3] is found[4] is found[6] is None and found[1] == found[2] != found[5]
    assert spectral.spectral(spark.createDataFrame([], "id bigint, v array<double>"), "id", "v", 2).count() == 0
    same = spark.createDataFrame([(i, [1.0]) for i in range(9)], "id bigint, v array<double>")
    assert {r.part for r in spectral.spectral(same, "id", "v", 3).collect()} == {0}


def test_ties_of_a_large_batch_are_held_in_part_only():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(6)
    x, marks = rng.random((10_000, 8)), rng.random((500, 8))
    batch = pd.Series(list(x))
    tracemalloc.start()
    parts = [*spectral.tied(batch, marks, 5, 0.5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    at, w = (np.concatenate(z) for z in zip(*parts))
    want_at, want_w = spectral.ties(x[:200], marks, 5, 0.5)
    assert len(at) == 10_000 and np.array_equal(at[:200], want_at) and np.array_equal(w[:200], want_w)
