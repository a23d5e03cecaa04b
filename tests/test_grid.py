"""Grids, contexts and comparisons of days made in ordered passes, against the joins that they stand for."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loadscape.operators import cleaning, rules
from loadscape.operators import sequences as seq
from loadscape.plans.catalog import QUERIES

from conftest import DATA

START, END = "2024-01-01 00:00:00", "2024-01-01 05:00:00"


def test_grid_equals_the_join(spark):
    """Keys without a reading in the grid, readings between and outside steps, repeated and null ones."""
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = [("a", at(1), 1.0), ("a", at(4), 2.0), ("a", at(4), 3.0), ("a", at(2, 30), 9.0), ("b", at(9), 5.0), ("c", None, 6.0), ("d", at(0), None), ("d", at(5), 7.0), (None, at(1), 8.0), ("e", at(0), 1.0), ("e", at(0), 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    stamps = F.explode(F.sequence(F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))).alias("ts")
    want = df.select("k").distinct().select("k", stamps).join(df, ["k", "ts"], "left")
    got = cleaning.complete_grid(df, "k", "ts", START, END, "1 HOUR")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["q6_cumulative_rules", "q13_context_vote", "q14_real_or_cumulative", "q15_detector_ensemble", "q15_density_ensemble"])
def test_no_grid_is_joined_or_sent(spark, name):
    """Below a join or a broadcast there is no grid of hours: what is sent to all tasks is the list of steps or one row a meter."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint, true], input[1, timestamp_ntz" not in plan
    lines = plan.splitlines()
    assert not any("Join" in x and "ts#" in x and "meter_id#" in x for x in lines)


def test_context_equals_the_pairs(spark):
    draw = random.Random(3)
    rows = [(k, d, float(draw.randint(0, 5))) for k in range(3) for d in sorted(draw.sample(range(60), 30))]
    df = spark.createDataFrame(rows, "k int, day bigint, v double")
    got = sorted((r.k, r.day, r.other, r.gap) for r in seq.context(df, ["k"], "day", "v", 10, 4).collect())
    want = []
    for k, d, v in rows:
        near = sorted((abs(v - w), e) for j, e, w in rows if j == k and e != d and abs(e - d) <= 10)
        want += [(k, d, e, g) for g, e in near[:4]]
    assert got == sorted(want)


def test_days_compared_equal_brute_force(spark):
    """Positions that are missing, values that are not finite, and intervals that overlap."""
    draw = random.Random(8)
    values = {p: draw.choice([None, 1.0, 2.5, 4.25, float("nan"), 7.125]) for p in range(60) if p % 17}
    found = [(p, p + n) for p in range(1, 58, 3) for n in (1, 2, 4) if p + n < 60]
    df = spark.createDataFrame([(1, p, v) for p, v in values.items()], "k int, pos int, v double")
    got = {(r.start, r.end): r.cumulative for r in rules.real_or_cumulative(df, spark.createDataFrame([(1, *x) for x in found], "k int, start int, `end` int"), "k", "pos", "v", 6, 2).collect()}
    above = lambda xs: min(xs, key=lambda x: (x != x, x), default=None)  # noqa: E731  NaN after every number
    less = lambda a, b: b != b and a == a or a < b
    want = {}
    for a, b in found:
        v, real, total = values.get(b), [], []
        if v is None:
            continue
        whole = [d for d in (-12, -6, 6, 12) if all(p + d in values for p in range(a, b + 1))]
        for d in whole:
            seen = [values[p + d] for p in range(a, b + 1) if values[p + d] is not None]
            total.append(round(abs(v - sum(seen)), 6))
            real += [round(abs(v - values[b + d]), 6)] if values[b + d] is not None else []
        if whole:
            want[a, b] = less(above(total), above(real)) if real else None
    assert got == want
