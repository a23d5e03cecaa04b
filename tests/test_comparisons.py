"""Tests of models, threshold curves, inspection of classifiers, choice of k and cubic filling, held against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.operators import clustering, scoring, sequences, statistics


def test_upper_tail(spark):
    zs = [0.0, 1e-9, -0.3, 0.5, 1.96, -1.96, 5.0, -5.0, 7.0, 7.2, -7.2, 12.0, 36.0, -40.0]
    rows = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select("z", scoring.upper_tail(F.col("z")).alias("p")).collect()
    for r in rows:
        assert (r.p is None) if r.z is None else abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) < 1e-14
    far = next(r.p for r in rows if r.z == 12.0)
    assert abs(far / (0.5 * math.erfc(12 / math.sqrt(2))) - 1) < 1e-6


def test_every_pair_of_models(spark):
    r = np.random.default_rng(1)
    x = r.normal(1, 1, (40, 3))
    rows = [(i // 4, *map(float, v)) for i, v in enumerate(x)] + [(99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "day int, a double, b double, c double")
    found = {(p.a, p.b): p for p in scoring.diebold_mariano_pairs(df.where("day < 99"), ["a", "b", "c"]).collect()}
    assert len(found) == 6
    for (i, j), p in found.items():
        d = x[:, "abc".index(i)] - x[:, "abc".index(j)]
        z = d.mean() / math.sqrt(d.var() / 40)
        assert p.n == 40 and abs(p.statistic - z) < 1e-9 and abs(p.p - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-12
    days = {p.day: p for p in scoring.losses_of_cases(df, ["day"], ["a", "b"]).collect()}
    assert len(days) == 11 and abs(days[3].a - np.abs(x[12:16, 0]).mean()) < 1e-12 and days[99].a is None
    one = {(p.a, p.b): p for p in scoring.diebold_mariano_pairs(df.where("day = 99"), ["a", "b", "c"]).collect()}
    assert one["a", "b"].n == 0 and one["b", "c"].mean_d == 0 and one["b", "c"].p is None


def _area(pos, neg):
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])


def test_threshold_curve_and_average_precision(spark):
    r = np.random.default_rng(2)
    rows = [(round(float(v), 1), int(r.random() < 0.3 + v / 4)) for v in r.normal(size=300)]
    df = spark.createDataFrame(rows + [(None, 1), (0.5, None)], "s double, y int")
    curve = statistics.threshold_curve(df, "s", "y").orderBy(F.desc("threshold")).collect()
    p = sum(y for _, y in rows)
    recall, want = 0.0, 0.0
    for c in curve:
        taken = [y for s, y in rows if s >= c.threshold]
        assert abs(c.precision - sum(taken) / len(taken)) < 1e-12 and abs(c.recall - sum(taken) / p) < 1e-12
        assert abs(c.fall_out - (len(taken) - sum(taken)) / (len(rows) - p)) < 1e-12
        want += (c.recall - recall) * c.precision
        recall = c.recall
    assert len(curve) == len({s for s, _ in rows}) and recall == 1
    assert abs(statistics.average_precision(df, "s", "y").first()[0] - want) < 1e-12
    assert statistics.average_precision(df.where("y = 0"), "s", "y").first()[0] is None


def test_inspection(spark):
    r = np.random.default_rng(3)
    truth = ["a" if i % 3 else "b" if i % 2 else "c" for i in range(90)]
    p = np.round(r.dirichlet([1, 1, 1], 90), 1)
    rows = [(i, truth[i], c, float(p[i, k])) for i in range(90) for k, c in enumerate("abc")]
    got = statistics.inspection(spark.createDataFrame(rows, "id int, truth string, cls string, p double"), "id", list("abc")).first()
    guess = ["abc"[int(np.argmax(v))] for v in p]
    hit = np.array([g == t for g, t in zip(guess, truth)])
    own = np.array([p[i, "abc".index(t)] for i, t in enumerate(truth)])
    at = {c: [i for i, t in enumerate(truth) if t == c] for c in "abc"}
    assert abs(got.accuracy - hit.mean()) < 1e-12 and abs(got.balanced_accuracy - np.mean([hit[at[c]].mean() for c in "abc"])) < 1e-12
    assert abs(got.log_loss + np.log(np.maximum(own, 1e-15)).mean()) < 1e-9
    area = lambda k, c, others: _area(p[at[c], k], p[sum((at[o] for o in others), []), k])
    assert abs(got.auc_ovr - np.mean([area(k, c, [o for o in "abc" if o != c]) for k, c in enumerate("abc")])) < 1e-12
    assert abs(got.auc_ovo - np.mean([area(k, c, [o]) for k, c in enumerate("abc") for o in "abc" if o != c])) < 1e-12


def test_silhouettes_find_the_number_of_clusters(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>")
    found = {s.k: s for s in clustering.silhouette_search(df, "v", [2, 3, 4, 500]).collect()}
    assert set(found) == {2, 3, 4} and [k for k, s in found.items() if s.chosen] == [3]
    d = ((x[:, None] - x[None, :]) ** 2).sum(axis=2)
    labels = np.repeat([0, 1, 2], 40)
    a = np.array([d[i, labels == labels[i]].sum() / 39 for i in range(120)])
    b = np.array([min(d[i, labels == c].mean() for c in range(3) if c != labels[i]) for i in range(120)])
    assert abs(found[3].silhouette - ((b - a) / np.maximum(a, b)).mean()) < 1e-9
    assert clustering.silhouette_search(df.limit(0), "v", [2, 3]).count() == 0


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_cubic_follows_polynomials(spark, degree):
    f = np.polynomial.Polynomial([2.0, -1.0, 0.5, 0.25][: degree + 1])
    known = {0, 1, 4, 5, 9, 10}
    rows = [(1, i, float(f(i)) if i in known else None) for i in range(-1, 12)] + [(2, 0, 1.0), (2, 1, None), (2, 2, 5.0), (3, 0, None)]
    out = sequences.interpolate_cubic(spark.createDataFrame(rows, "m int, pos int, v double"), ["m"], "pos", "v", "filled")
    assert out.columns == ["m", "pos", "v", "filled"]
    got = {(r.m, r.pos): r.filled for r in out.collect()}
    assert all(abs(got[1, i] - f(i)) < 1e-9 for i in range(11)) and got[1, -1] is got[1, 11] is got[3, 0] is None
    assert got[2, 1] == 3.0
