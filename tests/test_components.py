"""Factorisation against a plain numpy version whose loss falls; matching by hand."""

import numpy as np

from loadscape.operators import components


def test_factorisation_equals_the_plain_one(spark):
    rng = np.random.default_rng(1)
    data = {g: rng.random((20, 2)) @ rng.random((2, 6)) + rng.random((20, 6)) * 0.05 for g in (1, 2)}
    rows = [(g, 100 * g + i, x.tolist()) for g, xs in data.items() for i, x in enumerate(xs)] + [(1, 900, None), (None, 901, [1.0] * 6), (2, 902, [None] * 6)]
    df = spark.createDataFrame(rows, "g int, id int, x array<double>").repartition(3)
    found, losses = components.factorised(df, "g", "id", "x", 2, rounds=4)
    got, loss = {r.g: r for r in found.collect()}, {(r.g, r.round): r.loss for r in losses.collect()}
    order = [r.id for r in df.selectExpr("id", "xxhash64('components', id) AS h").orderBy("h", "id").collect()]
    for g, x in data.items():
        first = [i - 100 * g for i in order if 100 * g <= i < 100 * g + 20][:2]
        h, w = x[first] + 0.01, np.ones((20, 2))
        for r in range(4):
            w = w * (x @ h.T) / (w @ h @ h.T + components.LEAST)
            assert np.isclose(loss[g, r], ((x - w @ h) ** 2).sum(), atol=1e-6)
            h = h * (w.T @ x) / (w.T @ w @ h + components.LEAST)
        assert np.allclose(np.reshape(got[g].h, (2, 6)), h) and np.allclose(got[g].uses, w.sum(axis=0))
        assert all(loss[g, r + 1] <= loss[g, r] + 1e-9 for r in range(3)) and loss[g, 3] < loss[g, 0]
    d = components.component_distances(found, "g").collect()
    assert [(r.group_a, r.group_b) for r in d] == [(1, 2)] and d[0].d > 0


def test_nearest_components_are_matched_first():
    cost = np.array([[1.0, 5.0], [2.0, 9.0]])
    assert np.isclose(components.matched(cost, np.array([0.5, 0.5]), np.array([0.75, 0.25])), 0.5 * 1 + 0.25 * 2 + 0.25 * 9)
    assert components.matched(cost, np.zeros(2), np.ones(2)) == 0.0
