"""Packed blocks that meet in a Cartesian product: the same pairs and sums as shuffled groups, and rows that are shuffled twice."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from loadscape.operators import blocks, clustering, distance, matching, scoring
from loadscape.plans.catalog import QUERIES

SCHEMA = "g int, k long, v array<double>"


@pytest.fixture(scope="module")
def odd(spark):
    """A large and small groups, with copies, unknown values, other widths, missing arrays, and rows without group or key."""
    draw = random.Random(9)
    rows = [(0 if k % 3 else k % 7, k, [round(draw.uniform(-1, 1), 2) for _ in range(6)]) for k in range(150)]
    rows += [(0, k, [0.25] * 6) for k in range(150, 158)] + [(0, 158, None), (0, 159, [1.0, None] * 3), (0, 160, [1.0] * 4), (0, 161, [float("nan")] * 6), (None, 162, [0.0] * 6), (0, None, [0.5] * 6)]
    return spark.createDataFrame(rows, SCHEMA)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _both(monkeypatch, make, read):
    """What groups of a shuffle give and, with small bounds, what packed blocks give."""
    want = read(make())
    for name, most in {"GROUPED_ROWS": 20, "PACKED_ROWS": 16, "FEW_PACKED": 3, "BLOCK_ROWS": 5, "TASK_PAIRS": 500}.items():
        monkeypatch.setattr(blocks, name, most)
    df = make()
    assert "CartesianProduct" in _plan(df)
    return read(df), want


def _same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a[:-1] == b[:-1]
        assert (a[-1] is None) == (b[-1] is None) and (b[-1] is None or np.isclose(a[-1], b[-1], rtol=0, atol=1e-9, equal_nan=True))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:-1])


MAKES = {
    "pairs": lambda df: distance.pairs_within(df, "g", "k", "v", distance.euclidean, 3),
    "sums": lambda df: blocks.sums_within(df, "g", "k", "v", blocks.missing_aware),
    "nearest": lambda df: distance.nearest_to_queries(df, df.where("k % 10 = 0"), "k", "v", distance.squared, 4).select("query", "rank", "other", "d"),
    "queries": lambda df: distance.pairs_with_queries(df, df.where("k % 5 = 0"), "k", "v", distance.wasserstein_1d),
    "masked": lambda df: blocks.warped_where_near(df, df.where("k % 5 = 0"), "k", "v", 1.0, 4),
    "outliers": lambda df: clustering.local_outlier_factors(df.where("k < 150"), "g", "k", "v", 3),
    "kernels": lambda df: blocks.kernel_sums(df.where("k < 158"), "g", "k", "v", 1.0),
    "similar": lambda df: blocks.similar_sums(df.where("k < 158").withColumn("w", F.col("k") / 7.0), "g", "k", "v", "w", 1.0).select("k", F.round("degree", 6).alias("degree"), "total"),
    "mmd": lambda df: scoring.mmd2_of_groups(df.where("k < 158"), "g", "k", "v", 1.0),
}


@pytest.mark.parametrize("name", MAKES)
def test_packed_blocks_give_what_groups_give(odd, name, monkeypatch):
    _same(*_both(monkeypatch, lambda: MAKES[name](odd), _rows))


@pytest.mark.parametrize("name", ["pairs", "queries", "kernels"])
def test_no_row_is_shuffled_once_for_each_block_that_its_own_meets(odd, name, monkeypatch):
    monkeypatch.setattr(blocks, "GROUPED_ROWS", 5)
    plan = _plan(MAKES[name](odd.where("g = 0")))
    assert "CartesianProduct" in plan and not re.search("Generate explode|CoGroups", plan)


def test_kernel_sums_are_made_once(odd, monkeypatch):
    """Sums within groups and between them come from one product, whose sums no filter splits."""
    monkeypatch.setattr(blocks, "GROUPED_ROWS", 20)
    assert _plan(MAKES["mmd"](odd)).count("CartesianProduct") == 1


def test_copies_of_label_counts_are_measured_once(spark, monkeypatch):
    """Profiles of the same counts lie in the same blocks, and one of them is measured; each still has a row of its own."""
    draw, measured = random.Random(2), []
    kinds = [[draw.randint(0, 3) for _ in range(draw.randint(1, 6))] for _ in range(6)] + [[3] * 5]
    days = [(k, x) for k in range(120) for x in (kinds[-1] if k % 2 else draw.choice(kinds))]
    df = spark.createDataFrame(days, "id long, label int")
    apart = spark.createDataFrame([(a, b, abs(a - b) / 3) for a in range(4) for b in range(4)], "a int, b int, d double")
    make = lambda: matching.label_distances(df.where("id % 10 < 3"), df, "id", "label", apart, 6)
    _same(*_both(monkeypatch, make, _rows))
    assert "rangepartitioning(_v" in _plan(make()) and make().count() == 36 * 119
    counts = np.array([[own.count(x) for x in range(4)] for own in kinds] * 30, float)
    cost, moves = np.abs(np.subtract.outer(np.arange(4), np.arange(4))) / 3, matching.moves
    monkeypatch.setattr(matching, "moves", lambda c, s, d: measured.append(len(s)) or moves(c, s, d))
    block = blocks.Block(np.arange(len(counts)), counts, np.ones(counts.shape, bool))
    got = matching.labels_moved(cost, 6)(block, block)[0]
    different = len({tuple(x) for x in counts.tolist()})
    assert sum(measured) == different**2
    gap = (counts[:, None, :] - counts[None, :, :]).reshape(-1, 4)
    assert np.allclose(got.ravel(), matching.transports(cost, np.maximum(gap, 0), np.maximum(-gap, 0)), rtol=0, atol=1e-6)


@pytest.mark.parametrize("name", ["d6_assigned_days", "d6_assigned_days_of_a_year", "d8_one_to_one_days", "d9_wasserstein_bins"])
def test_searches_round_where_they_measure(spark, name):
    """No decimal is made of each pair's distance in the JVM, and keys are no column that may be null."""
    got = QUERIES[name](spark, DATA)
    assert "round(" not in _plan(got).lower() and [f.nullable for f in got.schema] == [False, False, True]
