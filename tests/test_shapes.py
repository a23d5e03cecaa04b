"""Barycentres and shapes against plain versions, medoids by exchange against every choice, and rows of unlisted years."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from loadscape.operators import intervals, matching, shapes
from loadscape.operators.distance import banded


def plain_path(c, x, window):
    n = len(c)
    cost = np.full((n + 1, n + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            if abs(i - j) < window:
                cost[i, j] = (c[i - 1] - x[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i, j - 1], cost[i - 1, j])
    i = j = n
    met = []
    while i and j:
        met.append((i - 1, x[j - 1]))
        step = int(np.argmin([cost[i - 1, j - 1], cost[i, j - 1], cost[i - 1, j]]))
        i, j = i - (step != 1), j - (step != 2)
    return met, cost[n, n]


def test_barycentres(spark):
    rng = np.random.default_rng(1)
    base = {c: np.sin(np.arange(12) / (1 + c)) for c in (1, 2)}
    data = {c: [np.roll(b, int(rng.integers(-1, 2))) + rng.normal(size=12) * 0.1 for _ in range(9)] for c, b in base.items()}
    rows = [(c, x.tolist()) for c, xs in data.items() for x in xs] + [(1, None), (1, [None] * 12), (None, [1.0] * 12)]
    centres, inertias = shapes.barycentres(spark.createDataFrame(rows, "c int, x array<double>").repartition(3), "c", "x", rounds=4, window=3)
    got, loss = {r.c: r.centre for r in centres.collect()}, {(r.c, r.round): r.inertia for r in inertias.collect()}
    for c, xs in data.items():
        centre = np.mean(xs, axis=0)
        for r in range(4):
            paths = [plain_path(centre, x, 3) for x in xs]
            assert np.isclose(loss[c, r], sum(p[1] for p in paths))
            assert np.isclose(loss[c, r], sum(banded(centre[None], x[None], 3)[0] ** 2 for x in xs))
            met = [v for p, _ in paths for v in p]
            centre = np.array([np.mean([v for i, v in met if i == k]) for k in range(12)])
        assert np.allclose(got[c], centre)
        assert all(loss[c, r + 1] <= loss[c, r] + 1e-9 for r in range(3)) and loss[c, 3] < loss[c, 0]


def test_shape_distance_and_shape():
    rng = np.random.default_rng(2)
    x, c = shapes.standard(rng.normal(size=(6, 9))), shapes.standard(rng.normal(size=(3, 9)))
    d, by = shapes.shape_distances(x, c)
    for i, j in itertools.product(range(6), range(3)):
        each = {s: shapes.shifted(x[i : i + 1], np.array([s]))[0] @ c[j] / np.linalg.norm(x[i]) / np.linalg.norm(c[j]) for s in range(-8, 9)}
        best = max(each, key=each.get)
        assert by[i, j] == best and np.isclose(d[i, j], 1 - each[best])
    shape = shapes.extracted(x.T @ x, x.sum(axis=0))
    score = lambda v: sum((v @ row) ** 2 for row in x) / (v @ v)
    assert all(score(shape) >= score(shapes.standard(rng.normal(size=(1, 9)))[0]) - 1e-9 for _ in range(200))


def test_shifted_and_scaled_copies_fall_together(spark):
    rng = np.random.default_rng(3)
    t = np.arange(48)
    kinds = [np.exp(-((t - 20) ** 2) / 8), np.exp(-((t - 15) ** 2) / 4) + np.exp(-((t - 35) ** 2) / 4), np.exp(-((t - 20) ** 2) / 6) - np.exp(-((t - 27) ** 2) / 6)]
    rows = [(i, (3 + i * np.roll(kinds[i % 3], int(rng.integers(-5, 6))) + rng.normal(size=48) * 0.01 * i).tolist()) for i in range(1, 91)]
    rows += [(-1, None), (500, [1.0]), (501, [None] * 48), (502, [2.0] * 48)]
    df = spark.createDataFrame([(i, v) for i, v in rows if i != -1] + [(1000, None)], "id int, x array<double>")
    got = {r.id: r for r in shapes.k_shape(df.repartition(3), "id", "x", 3).collect()}
    assert [len({got[i].shape for i in range(1, 91) if i % 3 == k}) for k in range(3)] == [1, 1, 1]
    assert len({got[i].shape for i in (1, 2, 3)}) == 3 and got[60].d < 0.2
    assert got[500].shape is None and got[501].shape is None and got[1000].shape is None and got[502].d == 1.0
    assert shapes.k_shape(df.limit(0), "id", "x", 3).collect() == []


def test_medoids_by_exchange(spark):
    rng = np.random.default_rng(4)
    best = 0
    for n, k in [(7, 2), (9, 3), (8, 2), (10, 3), (3, 3), (2, 5)] * 5:
        x = rng.random((n, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        start = list(range(min(k, n)))
        loss = lambda m: d[:, list(m)].min(axis=1).sum()
        found = matching.swapped_medoids(d, start)
        assert len({*found}) == min(k, n) and loss(found) <= loss(start) + 1e-12
        assert all(loss([i if m == out else m for m in found]) >= loss(found) - 1e-9 for out in found for i in range(n) if i not in found)
        best += np.isclose(loss(found), min(loss(m) for m in itertools.combinations(range(n), min(k, n))))
    assert best >= 24
    rows = [(g, 100 * g + i, rng.random(3).tolist()) for g in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    vals = {i: np.array(v) for _, i, v in rows}
    total = [sum(np.linalg.norm(vals[r.id] - vals[r.medoid]) for r in matching.k_medoids(df, "g", "id", "v", 4, swap=swap).collect()) for swap in (False, True)]
    assert total[1] <= total[0] + 1e-9


def test_readings_of_years_without_a_period_stay(spark):
    rows = spark.createDataFrame([(1, "2024-01-15 03:00:00", 5.0), (1, "2023-01-15 03:00:00", 7.0), (1, None, 1.0)], "m int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    periods = spark.createDataFrame([(2024, "2024-01-10 02:00:00", "2024-01-20 02:00:00")], "year int, start string, end string")
    got = {str(r.ts): r.v for r in intervals.wall_clock(rows, periods, "m", "ts", "v").collect()}
    assert got == {"2024-01-15 04:00:00": 5.0, "2023-01-15 03:00:00": 7.0, "None": 1.0}


def test_assigned_days_are_scaled_to_a_year(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 3.0]), (2, [4.0, 4.0, 1.0, 2.0])], "id int, v array<double>")
    plain = {r.other: r.d for r in matching.assigned(df.where("id = 0"), df, "id", "v", 2).collect()}
    year = {r.other: r.d for r in matching.assigned(df.where("id = 0"), df, "id", "v", 2, year=365.0).collect()}
    assert np.isclose(year[1], 365 * plain[1]) and np.isclose(year[2], 365 / 2 * plain[2])


def test_weakest_link_subtrees_are_best_at_their_price(spark):
    from loadscape.operators import models

    rng = np.random.default_rng(9)

    def grown(depth):
        if depth == 0 or rng.random() < 0.2:
            return models.Node(rng.integers(0, 9, 3).astype(float), [0])
        a, b = grown(depth - 1), grown(depth - 1)
        return models.Node(a.counts + b.counts, a.leaves + b.leaves, (a, b))

    def subtrees(node):
        yield [node]
        if node.children:
            yield from (a + b for a in subtrees(node.children[0]) for b in subtrees(node.children[1]))

    for _ in range(12):
        root = grown(3)
        total = root.counts.sum()
        risk = lambda t: sum(e.risk(total) for e in t)
        sequence = models.pruning_sequence(root)
        sizes = [len(models.ends(root, cut)) for _, cut in sequence]
        assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1
        alphas = [a for a, _ in sequence] + [sequence[-1][0] + 1]
        for (_, cut), low, high in zip(sequence, alphas, alphas[1:]):
            price = (low + high) / 2
            best = min(subtrees(root), key=lambda t: (round(risk(t) + price * len(t), 9), len(t)))
            own = models.ends(root, cut)
            assert abs(risk(own) + price * len(own) - risk(best) - price * len(best)) < 1e-9


def test_pruned_tree_on_rows(spark):
    from loadscape.operators import models

    rng = np.random.default_rng(10)
    x = rng.random((400, 2))
    y = (x[:, 0] > 0.5).astype(float)
    y = np.where(rng.random(400) < 0.25, 1 - y, y)
    df = spark.createDataFrame([(float(a), float(b), float(c), i) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y double, i int")
    train, held = df.where("i % 4 <> 0"), df.where("i % 4 = 0")
    model, root, steps, best = models.pruned_tree(train, held, ["a", "b"], "y", depth=5)
    assert steps[0][1] == len(root.leaves) and steps[best][1] < steps[0][1] and steps[best][2] <= min(s[2] for s in steps)
    found = model.transform(held.withColumn("_x", models.array_to_vector(F.array("a", "b")))).collect()
    loss = -np.mean([np.log(max(r.probability[int(r.y)], 1e-12)) for r in found])
    assert np.isclose(loss, steps[0][2])
