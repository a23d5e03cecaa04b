"""Properties over generated cases."""

from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadscape.operators import cleaning, distance, scoring, sequences
from loadscape.operators.matching import least_assignment


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.randoms(use_true_random=False))
def test_assignment_is_the_cheapest(n, more, rnd):
    cost = np.array([[rnd.randint(0, 9) for _ in range(n + more)] for _ in range(n)], float)
    want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(n + more), n))
    assert abs(least_assignment(cost) - want) < 1e-9


def test_runs_partition_the_series(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, None if rng.random() < 0.4 else float(rng.integers(3))) for k in range(30) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, pos int, v double")
    null = sequences.runs(df, ["k"], "pos", F.col("v").isNull()).toPandas()
    rest = sequences.runs(df, ["k"], "pos", F.col("v").isNotNull()).toPandas()
    for k in range(30):
        spans = sorted([*zip(null[null.k == k].start, null[null.k == k].end), *zip(rest[rest.k == k].start, rest[rest.k == k].end)])
        assert spans[0][0] == 0 and spans[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6, 8, 4)), rng.normal(size=(6, 4))
    samples = spark.createDataFrame([(t, s, 1 / 8, x[t, s].tolist()) for t in range(6) for s in range(8)], "test_id int, s int, p double, vals array<double>")
    observed = spark.createDataFrame([(t, y[t].tolist()) for t in range(6)], "test_id int, y array<double>")
    got = {r.test_id: r.es for r in scoring.energy_score(samples, observed).collect()}
    for t in range(6):
        want = np.linalg.norm(x[t] - y[t], axis=1).mean() - np.linalg.norm(x[t][:, None] - x[t][None], axis=2).sum() / 128
        assert abs(got[t] - want) < 1e-9 and got[t] >= 0
    scen = spark.createDataFrame([(t, k, s, float(x[t, s, k])) for t in range(6) for s in range(8) for k in range(4)], "day int, slot int, s int, value double")
    obs = spark.createDataFrame([(t, k, float(y[t, k])) for t in range(6) for k in range(4)], "day int, slot int, y double")
    for r in scoring.crps(scen, obs).collect():
        v = x[r.day, :, r.slot]
        assert abs(r.crps - (np.abs(v - y[r.day, r.slot]).mean() - np.abs(v[:, None] - v[None]).sum() / 128)) < 1e-9 and r.crps >= -1e-12
    for r in scoring.variogram_score(scen, obs).collect():
        gap = lambda a: np.sqrt(np.abs(a[..., :, None] - a[..., None, :]))
        assert abs(r.vs - ((gap(y[r.day]) - gap(x[r.day]).mean(axis=0)) ** 2).sum()) < 1e-9


def test_distances_are_symmetric(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(20)], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    for d in (distance.euclidean, distance.missing_aware, distance.wasserstein_1d):
        assert df.where(F.abs(d(a, b) - d(b, a)) > 1e-12).count() == 0 and df.where(d(a, a) != 0).count() == 0


def test_grid_is_complete(spark):
    df = spark.sql("SELECT k, timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, k) AS ts, 1.0D AS v FROM range(3) AS t(k)")
    grid = cleaning.complete_grid(df, "k", "ts", "2016-01-01 00:00:00", "2016-12-31 23:45:00", "15 MINUTES")
    assert grid.count() == 3 * 35136 and grid.where("v is not null").count() == 3
