"""Spanning trees, linkage, constraints, label distances and transport against plain versions; the decomposition against loops."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadscape.operators import distance, graph, loess, matching


def plain_linkage(d, k):
    """Parts of n points by merging the nearest two parts; of the cuts that leave at most k parts the lowest."""
    n = len(d)
    label, heights, cuts = list(range(n)), [], []
    for _ in range(n - 1):
        h, a, b = min((d[i][j], label[i], label[j]) for i in range(n) for j in range(i) if label[i] != label[j])
        heights.append(h)
        low, high = sorted((a, b))
        label = [low if x == high else x for x in label]
        cuts.append((h, list(label)))
    if n <= k:
        return list(range(n))
    t = sorted(heights, reverse=True)[k - 1]
    return [lab for h, lab in cuts if h <= t][-1]


@pytest.mark.parametrize("levels", [None, 3])
def test_single_linkage(spark, levels):
    rng = np.random.default_rng(5)
    rows, pairs, want = [], [], {}
    for g, n in enumerate((60, 25, 2, 1)):
        x = rng.random((n, 2)) * (1 if levels is None else levels)
        x = x if levels is None else np.floor(x)
        d = [[round(float(math.dist(a, b)), 9) for b in x] for a in x]
        rows += [(g, 100 * g + i) for i in range(n)]
        pairs += [(g, 100 * g + j, 100 * g + i, d[i][j]) for i in range(n) for j in range(i)]
        part = plain_linkage(d, 4)
        want |= {100 * g + i: 100 * g + part.index(part[i]) for i in range(n)}
    got = graph.single_linkage(spark.createDataFrame(rows, "g int, id int"), spark.createDataFrame(pairs, "g int, i int, j int, d double"), "g", "id", 4)
    assert {r.id: r.part for r in got.collect()} == want


def test_spanning_forest_is_minimal_in_few_rounds(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1, 1.0) for i in range(0, 120) if i != 60] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 121, 200), rng.integers(0, 121, 200), rng.integers(1, 4, 200)) if (a <= 60) == (b <= 60)] + [(5, 5, 0.1), (None, 3, 0.1), (7, 9, None)]
    forest, parts, rounds = graph.spanning_forest(spark.createDataFrame(edges, "i int, j int, d double"))
    found = forest.collect()
    assert len(found) == 119 and {r.part for r in parts.collect()} == {0, 61} and rounds <= 7
    parent = list(range(121))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0.0
    for w, a, b in sorted((w, a, b) for a, b, w in edges if None not in (a, b, w)):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total += w
    assert sum(r.d for r in found) == total
    none = graph.spanning_forest(spark.createDataFrame([], "i int, j int, d double"))
    assert none[0].collect() == none[1].collect() == [] and none[2] == 0


def test_constraints_and_contradictions(spark):
    links = [(1, 2, True), (2, 3, True), (9, 8, True), (3, 1, False), (1, 9, False), (8, 3, False), (20, 21, False), (None, 1, False), (2, 2, True), (20, 20, False)]
    parts, apart = graph.constraint_closure(spark.createDataFrame(links, "i1 int, i2 int, is_ml boolean"))
    assert {r.node: r.part for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 21}
    assert sorted(map(tuple, apart.collect())) == [(1, 1, 1, True), (1, 8, 2, False), (20, 20, 1, True), (20, 21, 1, False)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2**32))
def test_transport_equals_the_assignment_of_single_labels(labels, seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 4, (labels, labels)).astype(float) if seed % 2 else rng.random((labels, labels))
    supply, demand = rng.integers(0, 3, (8, labels)), rng.integers(0, 3, (8, labels))
    for s, d, got in zip(supply, demand, matching.transports(cost, supply, demand)):
        a, b = np.repeat(np.arange(labels), s), np.repeat(np.arange(labels), d)
        if len(a) > len(b):
            m = cost[np.ix_(a, b)].T
        else:
            m = cost[np.ix_(a, b)]
        want = matching.least_assignment(m) if len(m) else 0.0
        if len(m) and m.shape[1] <= 5:
            assert math.isclose(want, min(sum(m[i, p[i]] for i in range(len(m))) for p in itertools.permutations(range(m.shape[1]), len(m))), abs_tol=1e-9)
        assert math.isclose(got, want, abs_tol=1e-9)


def test_label_distances(spark):
    apart = {(a, b): 0.0 if a == b else float(abs(ord(a) - ord(b))) for a in "abcz" for b in "abcz"}
    profiles = {1: "aab", 2: "aab", 3: "abbcc", 4: "z", 5: "", 6: "zzzz"}
    df = spark.createDataFrame([(k, x) for k, v in profiles.items() for x in v] + [(1, None), (2, "?")], "id int, label string")
    table = spark.createDataFrame([(a, b, d) for (a, b), d in apart.items()], "a string, b string, d double")
    got = {(r.query, r.other): r.d for r in matching.label_distances(df.where("id in (1, 4)"), df, "id", "label", table).collect()}
    # left of 1 and 3: a against b, c, c; of 4 and 6: nothing against z, z, z
    assert got == {(1, 2): 0.0, (1, 3): 1.0, (1, 4): 24.0, (1, 6): 24.0 + 25.0 + 25.0, (4, 1): 24.0, (4, 2): 24.0, (4, 3): 23.0, (4, 6): 0.0}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=7), st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=7)), min_size=1, max_size=5))
def test_transport_of_samples_of_any_size(spark, pairs):
    df = spark.createDataFrame([(i, [None if v is None else float(v) for v in a], [None if v is None else float(v) for v in b]) for i, (a, b) in enumerate(pairs)], "id int, a array<double>, b array<double>")
    got = {r.id: r.d for r in df.select("id", distance.transport_1d(F.col("a"), F.col("b")).alias("d")).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = (sorted(v for v in p if v is not None) for p in (a, b))
        want = sum((p - q) ** 2 for p, q in zip(sorted(x * len(y)), sorted(y * len(x)))) / (len(x) * len(y)) if x and y else None
        assert (got[i] is None) == (want is None) and (want is None or math.isclose(got[i], want, abs_tol=1e-9))


def plain_loess(y, q, at, weights):
    out = []
    n = len(y)
    for x0 in at:
        size = min(q, n)
        left = min(max(x0 - size // 2, 0), n - size)
        places = range(left, left + size)
        h = max(abs(places[0] - x0), abs(places[-1] - x0)) + max(0, q - n) // 2
        w = [((1 - (abs(i - x0) / h) ** 3) ** 3 if abs(i - x0) <= 0.999 * h else 0.0) * weights[i] for i in places]
        if not sum(w):
            out.append(y[min(max(x0, 0), n - 1)])
            continue
        a = np.array([[1.0, i - x0] for i in places])
        root = np.sqrt(np.array(w))[:, None]
        mean = sum(i * v for i, v in zip(places, w)) / sum(w)
        if math.sqrt(sum(v * (i - mean) ** 2 for i, v in zip(places, w)) / sum(w)) <= 0.001 * (n - 1):
            out.append(sum(y[i] * v for i, v in zip(places, w)) / sum(w))
        else:
            out.append(np.linalg.lstsq(a * root, np.array([y[i] for i in places])[:, None] * root, rcond=None)[0][0, 0])
    return np.array(out)


def plain_stl(y, period, seasonal, inner, outer):
    n = len(y)
    trend, weights = np.zeros(n), np.ones(n)
    slow = period + 1 if period % 2 == 0 else period + 2
    wide = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    wide += (wide + 1) % 2
    moving = lambda x, k: np.array([x[i : i + k].mean() for i in range(len(x) - k + 1)])
    for _ in range(max(1, outer)):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                own = (y - trend)[phase::period]
                cycle[phase::period] = plain_loess(own, seasonal, range(-1, len(own) + 1), weights[phase::period])
            low = plain_loess(moving(moving(moving(cycle, period), period), 3), slow, range(n), np.ones(n))
            season = cycle[period : period + n] - low
            trend = plain_loess(y - season, wide, range(n), weights)
        if not outer:
            break
        rest = abs(y - trend - season)
        u = rest / (6 * np.median(rest))
        weights = np.array([1.0 if v <= 0.001 else (1 - v * v) ** 2 if v <= 0.999 else 0.0 for v in u])
    return trend, season


@pytest.mark.parametrize("outer", [0, 3])
def test_decomposition_equals_its_loops(spark, outer):
    rng = np.random.default_rng(7)
    t = np.arange(53)
    series = {1: t / 10 + 3 * np.sin(t * 2 * np.pi / 6) + rng.normal(size=53), 2: rng.normal(size=53), 3: rng.normal(size=40)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in series.items()] + [(4, [1.0, 2.0]), (5, None)], "id int, vals array<double>")
    got = {r.id: r for r in loess.decompose_stl(df, "id", "vals", 6, 7, outer=outer).collect()}
    for k, y in series.items():
        trend, season = plain_stl(y, 6, 7, 2, outer)
        assert np.allclose(got[k].trend, trend, atol=1e-6) and np.allclose(got[k].season, season, atol=1e-6)
        assert np.allclose(np.add(np.add(got[k].trend, got[k].season), got[k].rest), y)
    assert got[4].trend is None and got[5].rest is None


def test_a_spike_moves_neither_trend_nor_season():
    rng = np.random.default_rng(8)
    t = np.arange(240)
    y = t / 20 + 5 * np.sin(t * 2 * np.pi / 12) + rng.normal(size=240) * 0.1
    spiked = y.copy()
    spiked[100] += 60
    both = np.stack([y, spiked])
    trend, season, weights = loess.stl(both, 12, 7)
    assert weights[1, 100] == 0 and np.abs(trend[0] - trend[1]).max() < 0.1 and np.abs(season[0] - season[1]).max() < 0.2
    trend, season, _ = loess.stl(both, 12, 7, outer=0)
    assert np.abs(season[0] - season[1]).max() > 5


def test_forests_of_blocks_hold_the_spanning_forest(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 12)
    r = np.random.default_rng(11)
    rows = [("hot" if i % 3 else "small", i, r.integers(0, 4, 3).astype(float).tolist()) for i in range(150)]
    odd = [(None, 900, [0.0, 0.0, 0.0]), ("hot", 901, None), ("hot", 902, [0.0, None, 0.0]), ("hot", 903, [0.0, float("nan"), 0.0]), ("hot", 904, [0.0, 0.0]), ("one", 905, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "g string, key long, vals array<double>")
    edges = graph.euclidean_forests(df, "g", "key", "vals").cache()
    every = [(a[1], b[1], float(np.linalg.norm(np.subtract(a[2], b[2])))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    assert edges.distinct().count() < len(every) / 3
    got = {(e.i, e.j): e.d for e in graph.spanning_forest(edges)[0].collect()}
    part, want = {k: k for _, k, _ in rows}, {}
    for i, j, d in sorted(every, key=lambda e: (round(e[2], 9), e[0], e[1])):
        if part[i] != part[j]:
            want[i, j] = d
            part = {k: part[i] if p == part[j] else p for k, p in part.items()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert graph.euclidean_forests(df.limit(0), "g", "key", "vals").count() == 0
    named = df.selectExpr("g", "concat('k', key) as key", "vals")
    assert graph.spanning_forest(graph.euclidean_forests(named, "g", "key", "vals"))[0].count() == len(want)


def test_label_moves_of_many_pairs_at_once():
    """As moving one pair's labels at a time, few and many labels, with and without a metric."""
    r = np.random.default_rng(5)
    p = r.random((7, 3))
    metric = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    for cost in (metric, r.random((7, 7))):
        for most in (1, 3, 9):
            x, y = r.integers(0, most + 1, (120, 7)), r.integers(0, most + 1, (120, 7))
            x[:5], y[5:10] = 0, 0
            common = np.minimum(x, y)
            want = [matching.transports(cost, a[None], b[None])[0] for a, b in zip(x - common, y - common)]
            assert np.allclose(matching.moves(cost, x - common, y - common), want, atol=1e-9)
            units = [i for i in range(120) if 0 < min((x - common)[i].sum(), (y - common)[i].sum()) <= 6]
            for i in units[:20]:
                a, b = (np.repeat(np.arange(7), z) for z in ((x - common)[i], (y - common)[i]))
                c = cost[np.ix_(a, b)] if len(a) <= len(b) else cost[np.ix_(a, b)].T
                assert np.isclose(matching.least_assignment(c), want[i])


def test_label_distances_leave_no_pair_to_the_jvm(spark):
    df = spark.createDataFrame([(i, (i * k) % 4) for i in range(30) for k in range(5)], "id bigint, label int")
    apart = spark.createDataFrame([(a, b, float(abs(a - b))) for a in range(4) for b in range(4)], "a int, b int, d double")
    found = matching.label_distances(df.where("id % 20 = 0"), df, "id", "label", apart, 6)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 * 29


def test_local_regression_holds_no_cube_of_series_places_and_neighbours():
    """What it holds at once goes by series and places, however wide the band; weights may be one row for all series."""
    import tracemalloc

    rng = np.random.default_rng(4)
    y, at = rng.random((32, 720)), np.arange(720)
    tracemalloc.start()
    found = loess.loess(y, 201, at, np.ones((1, 720)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * y.nbytes
    assert np.allclose(found, loess.loess(y, 201, at, np.ones_like(y)), atol=1e-12)
    assert np.allclose(found[3], plain_loess(y[3], 201, range(720), np.ones(720)), atol=1e-9)
