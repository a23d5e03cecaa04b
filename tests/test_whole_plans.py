"""Queries against all rows reach every row, whatever its cluster."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loadscape.plans.catalog import QUERIES
from loadscape.sources.tables import profiles


@pytest.mark.parametrize("name", ["d4_dynamic_time_warping", "d5_masked_time_warping", "d6_assigned_days", "d8_one_to_one_days", "d13_direction_similarity"])
def test_query_profiles_meet_all_clusters(spark, name):
    p = profiles(spark, DATA)
    rows = [(r.profile_id, float(sum(r.vals))) for r in p.select("profile_id", "vals").collect()]
    near = lambda a, b: name != "d5_masked_time_warping" or abs(a - b) < 1
    want = {(q, o) for q, t in rows if q % 20 == 0 for o, u in rows if o != q and near(t, u)}
    got = [(r.query, r.other) for r in QUERIES[name](spark, DATA).select("query", "other").collect()]
    assert len(got) == len(want) and {*got} == want
    labels = p.select(F.count_distinct("cluster")).first()[0]
    assert labels > 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_hourly_grid_holds_every_reading(spark, sf):
    from loadscape.plans.series import HOURS, START
    from loadscape.sources.tables import readings

    hour = F.timestamp_diff("HOUR", F.lit(START).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    lo, hi = readings(spark, f"/root/testdata/{sf}").agg(F.min(hour), F.max(hour)).first()
    assert 0 <= lo and hi < HOURS
