"""Groups that hold most of the rows: counted ranges and blocks give what a whole group in one task would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.operators import clustering, counted, distance, generators, reshape, samplers, scoring


@pytest.fixture(autouse=True)
def _short_ranges(monkeypatch):
    """Ranges of a few rows, so that small tables have as many as shuffle partitions."""
    monkeypatch.setattr(counted, "RANGE_ROWS", 25)


def _hot(n=600, seed=4):
    """(g, key, w): a third of all rows in one group, and a group that is null."""
    r = np.random.default_rng(seed)
    return [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{i % 7}", i, int(r.integers(1, 9))) for i in r.permutation(n).tolist()]


def test_running_sums(spark):
    rows = _hot()
    got = counted.running(spark.createDataFrame(rows, "g string, key long, w long"), "key", ["w"], ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r.g]
        assert r.w_below == sum(x[2] for x in own if x[1] < r.key) and r.w_total == sum(x[2] for x in own)


def test_one_range_gives_what_many_give(spark, monkeypatch):
    df = spark.createDataFrame(_hot(), "g string, key long, w long")
    many = {*counted.running(df, "key", ["w"], ["g"]).collect()}
    monkeypatch.setattr(counted, "RANGE_ROWS", 1000)
    assert counted.bounds_of(df, "key") == [] and {*counted.running(df, "key", ["w"], ["g"]).collect()} == many


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "decimal(12,2)"])
def test_ranges_by_bounds_of_any_type(spark, kind):
    value = "date_add(date '2000-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
    df = spark.range(2000).selectExpr(f"{value} as x")
    bounds = counted.bounds_of(df, "x")
    assert 1 <= len(bounds) <= 3 and bounds == sorted(bounds)
    got = df.select("x", counted.range_of(F.col("x"), bounds, df.schema["x"].dataType).alias("part")).collect()
    assert all(r.part == sum(b <= r.x for b in bounds) for r in got) and {r.part for r in got} == {*range(len(bounds) + 1)}


def test_two_thousand_bounds(spark):
    bounds = [*range(10, 20_010, 10)]
    got = spark.range(0, 20_100, 7).select("id", counted.range_of(F.col("id"), bounds, spark.range(1).schema["id"].dataType).alias("part")).collect()
    assert all(r.part == min(2000, r.id // 10) for r in got)


def test_draws_of_a_hot_group(spark):
    rows = [(k, g, float(w)) for g, k, w in _hot()]
    train = spark.createDataFrame(rows, "pick long, g string, w double")
    asked = spark.createDataFrame([(i, "hot") for i in range(400)], "test long, g string")
    got = samplers.weighted_draws(asked, train, "g", "w", 5, "seed").collect()
    assert len(got) == 2000 and {r.pick for r in got} <= {k for k, g, _ in rows if g == "hot"}
    total = sum(w for _, g, w in rows if g == "hot")
    weight = {k: w for k, g, w in rows}
    assert abs(sum(weight[r.pick] for r in got) / 2000 - sum(w * w for _, g, w in rows if g == "hot") / total) < 0.25


def test_random_members_of_a_hot_group(spark):
    rows = [(g or "none", k) for g, k, _ in _hot()]
    got = generators.random_scenarios(spark.createDataFrame(rows, "g string, key long"), "g", "key", 30, "seed").collect()
    assert len(got) == 30 * len({g for g, _ in rows}) and all((r.day, r.pick) in set(rows) for r in got)


def test_crps_and_quantiles_of_a_hot_day(spark):
    r = np.random.default_rng(5)
    rows = [("hot" if i < 400 else f"d{i % 5}", 0, i, round(float(r.normal()), 1)) for i in range(600)]
    seen = [(d, 0, 0.25) for d in {x[0] for x in rows}]
    s, o = spark.createDataFrame(rows, "day string, slot int, s long, value double"), spark.createDataFrame(seen, "day string, slot int, y double")
    for row in scoring.crps(s, o).collect():
        x = np.array([v for d, _, _, v in rows if d == row.day])
        assert abs(row.crps - (np.abs(x - 0.25).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2)) < 1e-9
    for row in scoring.quantiles(s, [0.1, 0.5, 0.9]).collect():
        assert abs(row.value - np.quantile([v for d, _, _, v in rows if d == row.day], row.q)) < 1e-9
    assert scoring.crps(s.limit(0), o).count() == 0


def test_blocks_follow_the_size_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK_ROWS", 10)
    r = np.random.default_rng(6)
    rows = [("hot" if i % 3 else "small" if i % 2 else None, i, r.normal(size=3).tolist(), 0.5) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, key long, vals array<double>, p double")
    assert {(x.g, x._blocks) for x in distance.with_blocks(df, ["g"]).collect()} == {("hot", 10), ("small", 4), (None, 4)}
    got = {(x.i, x.j): x.d for x in distance.pairs_within(df, "g", "key", "vals", distance.euclidean).collect()}
    want = {(a[1], b[1]): np.linalg.norm(np.subtract(a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and a[0] and a[1] < b[1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    samples = df.where("g is not null").selectExpr("g as test_id", "key as s", "p", "vals")
    seen = spark.createDataFrame([("hot", [0.0, 0.0, 0.0]), ("small", [1.0, 0.0, 0.0])], "test_id string, y array<double>")
    for row in scoring.energy_score(samples, seen).collect():
        x = np.array([v for g, _, v, _ in rows if g == row.test_id])
        y = np.array([0.0 if row.test_id == "hot" else 1.0, 0, 0])
        apart = np.linalg.norm(x[:, None] - x[None, :], axis=2)
        assert abs(row.es - (0.5 * np.linalg.norm(x - y, axis=1).sum() - 0.125 * apart.sum())) < 1e-6


def test_members_in_parts(spark):
    rows = [(g, k) for g, k, _ in _hot()]
    df = spark.createDataFrame([*rows, ("hot", None)], "g string, key long")
    got = {(r.g, r.part): [*map(int, r.members.split(","))] for r in reshape.in_parts(df, "g", "key", 20).collect()}
    for g in {g for g, _ in rows}:
        own = sorted(k for h, k in rows if h == g)
        assert [got.pop((g, p)) for p in range(-(-len(own) // 20))] == [own[at : at + 20] for at in range(0, len(own), 20)]
    assert not got and reshape.in_parts(df.limit(0), "g", "key", 20).count() == 0


def test_numbered_draws(spark):
    asked, train = spark.range(3000).selectExpr("id as test"), spark.range(12).selectExpr("id * 7 as pick")
    seen = np.zeros(12)
    for r in samplers.numbered_draws(asked, train, 5, "s").groupBy("test").agg(F.collect_list("pick").alias("picks"), F.sum("p").alias("p")).collect():
        assert len({*r.picks}) == 5 and abs(r.p - 1) < 1e-12
        seen[[x // 7 for x in r.picks]] += 1
    assert seen.sum() == 15_000 and abs(seen - 1250).max() < 130
    few = samplers.numbered_draws(asked.limit(2), train.union(train).union(spark.sql("select cast(null as bigint)")), 50, "s").collect()
    assert len(few) == 24 and {r.pick for r in few} == {i * 7 for i in range(12)}
    assert samplers.numbered_draws(asked, train.limit(0), 5, "s").count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_landmarks_of_a_hot_group(spark, monkeypatch, sent):
    monkeypatch.setattr(distance, "SENT_ROWS", sent)
    r = np.random.default_rng(7)
    rows = [(g, k, r.normal(size=3).tolist()) for g, k, _ in _hot(300)] + [("hot", 1000 + i, [9.0, 9.0, 9.0]) for i in range(40)] + [("copies", 2000 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, key long, vals array<double>")
    marks = distance.landmarks(df, "g", "key", 30, "seed")
    pairs = distance.pairs_with_landmarks(df, marks, "g", "key", "vals", distance.euclidean)
    held = {k: v for _, k, v in rows}
    chosen = {g: [k for h, k in marks.select("g", "key").collect() if h == g] for g in {g for g, _, _ in rows}}
    assert len(chosen["hot"]) == 30 and all(len(v) <= 30 for v in chosen.values())
    for m in distance.landmark_medoids(pairs, "g").collect():
        total = {j: sum(np.linalg.norm(np.subtract(held[j], v)) for g, _, v in rows if g == m.g) for j in chosen[m.g]}
        assert abs(m.total - min(total.values())) < 1e-5 and abs(total[m.medoid] - m.total) < 1e-5
    factors = {(x.g, x.i): x.lof for x in clustering.outlier_factors(pairs, "g", 5).collect()}
    assert factors.keys() == {(g, k) for g, k, _ in rows if g is not None}
    assert all(abs(v - 1) < 1e-9 for (g, _), v in factors.items() if g == "copies")

    def nearest(g, i):
        return sorted((np.linalg.norm(np.subtract(held[i], held[j])), j) for j in chosen[g] if j != i)[:5]

    density = lambda g, i: 1 / max(np.mean([max(d, nearest(g, j)[-1][0]) for d, j in nearest(g, i)]), 1e-10)
    for i in [k for g, k, _ in rows if g == "hot"][::9]:
        want = np.mean([density("hot", j) for _, j in nearest("hot", i)]) / density("hot", i)
        assert abs(factors["hot", i] / want - 1) < 1e-6
