"""Small fixtures with values computed by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.functions import calendar as cal
from loadscape.operators import cleaning, clustering, distance, intervals, reshape, scoring, sequences


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def runs_df(spark):
    vals = [0.0, 0.0, None, 1.0, 0.0, None, None, 5.0]
    return spark.createDataFrame([("m", i, v) for i, v in enumerate(vals)], "id string, pos int, value double")


def test_runs(runs_df):
    zero = sequences.runs(runs_df, ["id"], "pos", F.col("value") == 0)
    assert sorted(rows(zero.select("start", "end"))) == [(0, 2), (4, 5)]
    null = sequences.runs(runs_df, ["id"], "pos", F.col("value").isNull())
    assert sorted(rows(null.select("start", "end"))) == [(2, 3), (5, 7)]


def test_interval_neighbours(runs_df):
    t = intervals.interval_table(runs_df, ["id"], "pos", "value", F.col("value") == 0)
    got = {r["start"]: r for r in t.collect()}
    assert got[0]["at_start"] and got[0]["value_after"] is None and got[0]["second_after"] == 1.0
    assert got[5]["value_before"] == 0.0 and got[5]["value_after"] == 5.0 and not got[5]["at_end"]


def test_mask_takes_the_value_after(runs_df):
    found = sequences.runs(runs_df, ["id"], "pos", F.col("value") == 0)
    got = dict(rows(intervals.mask(runs_df, found, ["id"], "pos", "value").select("pos", "value")))
    assert [got[i] for i in range(8)] == [None, None, None, 1.0, None, None, None, 5.0]


def test_fills(runs_df):
    got = dict(rows(sequences.interpolate(runs_df, ["id"], "pos", "value", "f").select("pos", "f")))
    assert got[2] == 0.5 and abs(got[5] - 5 / 3) < 1e-12
    got = dict(rows(sequences.forward_fill(runs_df, ["id"], "pos", "value", "f").select("pos", "f")))
    assert got[6] == 0.0


def test_swap_and_decimal_comma(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 2, 3),), (dt.datetime(2016, 5, 13),)], "ts timestamp_ntz")
    assert rows(df.select(cleaning.swap_day_month(F.col("ts")))) == [(dt.datetime(2016, 3, 2),), (dt.datetime(2016, 5, 13),)]
    df = spark.createDataFrame([("1,5",), ("/",), ("x",), (None,)], "t string")
    assert rows(df.select(cleaning.decimal_comma(F.col("t")))) == [(1.5,), (None,), (None,), (None,)]


def test_weeks_and_easter(spark):
    days = [dt.date(2016, 1, 1), dt.date(2016, 1, 4), dt.date(2017, 1, 1), dt.date(2017, 1, 2), dt.date(2016, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(cal.monday_week(F.col("d"))).collect()] == [0, 1, 0, 1, 52]
    years = spark.createDataFrame([(y,) for y in (1961, 2000, 2016, 2038)], "y int")
    assert [r[0] for r in years.select(cal.easter(F.col("y"))).collect()] == [dt.date(1961, 4, 2), dt.date(2000, 4, 23), dt.date(2016, 3, 27), dt.date(2038, 4, 25)]


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 3.0, 3.0, 9.0, 2.0)], "k int, v double")
    got = reshape.quantile_bands(df, "k", "v", [30]).first()
    assert (got["lower"], got["upper"], got["band"]) == (2.0, 3.0, "30-70")


def test_scores_by_hand(spark):
    s = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate((1.0, 2.0, 4.0))], "day int, slot int, s int, value double")
    o = spark.createDataFrame([(0, 0, 2.0)], "day int, slot int, y double")
    want = np.mean([1, 0, 2]) - np.abs(np.subtract.outer([1, 2, 4], [1, 2, 4])).sum() / 18
    assert abs(scoring.crps(s, o).first()["crps"] - want) < 1e-12
    q = scoring.quantiles(s, [0.5])
    assert rows(scoring.reliability(q, o).select("share")) == [(0.0,)]
    assert rows(scoring.pinball(q, o).select("loss")) == [(0.0,)]


def test_dtw_against_full_search(spark):
    rng = np.random.default_rng(0)
    pairs = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(5)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(distance.dtw("a", "b", F.lit(99))).collect()]

    def full(a, b):
        from functools import cache

        @cache
        def f(i, j):
            if i < 0 or j < 0:
                return 0.0 if i == j else np.inf
            return (a[i] - b[j]) ** 2 + min(f(i - 1, j), f(i, j - 1), f(i - 1, j - 1))

        return f(len(a) - 1, len(b) - 1) ** 0.5

    assert np.allclose(got, [full(*p) for p in pairs])


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert clustering.adjusted_rand(df, "a", "b").first()[0] == 1.0


def test_nulls_in_sums_and_sides(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.25, 0.5)], "o double, i double")
    assert [r[0] for r in df.select(cleaning.net(F.col("o"), F.col("i"))).collect()] == [0.0, 1.0, 0.75]
    assert rows(spark.createDataFrame([(None,)], "v double").select(cleaning.clip_negative(F.col("v")))) == [(None,)]
