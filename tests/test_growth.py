"""Operators whose work once grew faster than their rows: results on odd rows, and plans without the step that grew."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from loadscape.operators import intervals, rules, samplers, sequences


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _series(spark, n=60):
    draw = random.Random(3)
    rows = [(k, p, None if draw.random() < 0.6 else round(draw.uniform(-5, 5), 2)) for k in range(4) for p in range(n) if k or p % 3]
    rows += [(9, p, None) for p in range(5)] + [(8, 4, 1.5)]
    return spark.createDataFrame(rows, "k int, pos int, v double"), rows


@pytest.mark.parametrize("name", ["interpolate", "interpolate_cubic"])
def test_no_frame_is_read_up_to_the_end_for_each_row(spark, name):
    df, rows = _series(spark)
    out = getattr(sequences, name)(df, ["k"], "pos", "v", "f")
    assert "unboundedfollowing" not in _plan(out).lower() and out.columns == ["k", "pos", "v", "f"]
    got = {(r.k, r.pos): r.f for r in out.collect()}
    assert len(got) == len(rows)
    for k, p, v in rows:
        known = sorted((q, x) for j, q, x in rows if j == k and x is not None)
        before, after = [z for z in known if z[0] <= p], [z for z in known if z[0] >= p]
        if v is not None or not before or not after:
            assert got[k, p] == v
            continue
        points = before[-1:] + after[:1] if name == "interpolate" else before[-2:] + after[:2]
        want = 0.0
        for q, x in points:
            for r, _ in points:
                x = x if r == q else x * (p - r) / (q - r)
            want += x
        assert got[k, p] == pytest.approx(want, abs=1e-9)


def test_medians_of_days_meet_as_arrays(spark):
    draw = random.Random(4)
    rows = [(k, p, None if draw.random() < 0.1 else draw.randint(-9, 9) / 2, "x") for k in range(3) for p in range(40) if k or p % 7] + [(None, 3, 1.0, "x")]
    out = sequences.decompose_robust(spark.createDataFrame(rows, "k int, pos int, v double, more string"), ["k"], "pos", "v", 4, 40)
    plan = _plan(out)
    assert "Join" not in plan and "Window" not in plan and out.columns == ["k", "pos", "v", "more", "trend", "season", "rest"]
    trend, season = {}, {}
    for k in range(3):
        own = [(p, v) for j, p, v, _ in rows if j == k]
        for i, (p, _) in enumerate(own):
            day = sorted(v for _, v in own[max(0, i - 2) : i + 3] if v is not None)
            trend[k, p] = day[2] if 2 <= p <= 37 and len(day) > 2 else None
        for phase in range(4):
            season[k, phase] = median([v - trend[k, p] for p, v in own if p % 4 == phase and None not in (v, trend[k, p])])
    got = out.collect()
    assert len(got) == len(rows) - 1
    for r in got:
        assert r.trend == trend[r.k, r.pos] and r.season == season[r.k, r.pos % 4]
        assert r.rest == (None if None in (r.v, r.trend) else r.v - r.trend - r.season)


def test_disconnections_meet_as_different_pairs(spark):
    draw = random.Random(5)
    rows = [(m, s := draw.randint(0, 12), s + draw.randint(1, 6)) for m in range(60)]
    out = intervals.disconnected(spark.createDataFrame(rows, "m int, start int, end int"), ["m"], 4, 2)
    joins = [line for line in _plan(out).splitlines() if "Join" in line]
    assert len(joins) == 1 and "_s" in joins[0] and "_e" in joins[0]
    common = {z for _, *z in map(list, rows) for z in [tuple(z)] if sum(y == z for y in ((s, e) for _, s, e in rows)) >= 4}
    want = sorted((m, s, e, any(abs(s - a) + abs(e - b) <= 2 for a, b in common)) for m, s, e in rows)
    assert sorted(map(tuple, out.collect())) == want and out.columns == ["m", "start", "end", "disconnected"]


def test_a_row_is_not_multiplied_by_centroids(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.0), (3, "b", 5.0), (4, "b", 5.0), (5, "c", 100.0), (6, "b", None), (7, "a", 3.0), (7, "a", 99.0)], "id int, cluster string, x double")
    out = samplers.nearest_centroid(rows, rows.where("id < 7"), "x")
    assert "array_min" in _plan(out)
    got = {r.test: (r.cluster, round(1 / r.p)) for r in out.collect()}
    assert got == {1: ("a", 2), 2: ("a", 2), 3: ("b", 3), 4: ("b", 3), 5: ("c", 1), 6: ("a", 2), 7: ("c", 1)}


def test_what_follows_a_gap_needs_no_join(spark):
    df, _ = _series(spark)
    out = rules.after_null_runs(df, "k", "pos", "v", 4)
    assert "Join" not in _plan(out)
    want = rules.after_gap(df, sequences.runs(df, ["k"], "pos", F.col("v").isNull()), "k", "pos", "v", 4)
    read = lambda d: sorted(map(str, d.select("k", "start", "gap", "v1", "v2", "mean", "hi").collect()))
    assert read(out) == read(want) and out.columns == want.columns and out.count() > 10


def test_shared_starts_are_sent_to_the_intervals(spark):
    draw = random.Random(6)
    rows = [(m, draw.randint(0, 4), draw.randint(5, 9), draw.choice([None, False])) for m in range(90)]
    found = spark.createDataFrame(rows, "m int, start int, end int, normal boolean")
    out = intervals.collective_rest(found, F.col("normal").isNull(), 8, 1)
    assert _plan(out).count("Join") == 1 and "broadcast" in _plan(out)
    old = intervals.collective(found.where("normal is null").select("m", "start", "end"), 8, 1).where("collective")
    assert {r.m for r in out.where("shared").collect()} == {r.m for r in old.collect()} and out.count() == 90


def test_a_large_clusters_pairs_are_made_by_many_tasks(spark):
    members = spark.range(3000).select(F.when(F.col("id") < 2990, 1).otherwise(F.lit(2)).alias("c"), F.col("id").alias("pick"), (F.col("id") % 2).alias("kind"))
    asked = spark.createDataFrame([(0, 1, 0, 0.75), (0, 2, 0, 0.25), (20, 1, 1, 1.0), (40, 3, 1, 1.0), (60, None, 1, 1.0)], "test int, c int, kind long, p double")
    out = samplers.two_level(asked, members, "c", ["kind"])
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 - 5 and len(sizes) > 32 and max(sizes) < 300
    assert {r.test: round(r.p, 9) for r in out.groupBy("test").agg(F.sum("p").alias("p")).collect()} == {0: 1.0, 20: 1.0}
