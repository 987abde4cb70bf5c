"""What is rounded for places isn't rounded for each of their stations."""

import pytest

from strataspark.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["three_station_geometry", "ray_residuals", "station_pairs", "pair_distance_wgs84"])
def test_rounded_before_stations_are_spread(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread = [k for k, line in enumerate(plan) if "Generate explode(own" in line]
    rounded = [k for k, line in enumerate(plan) if "round(" in line]
    assert spread and rounded and min(rounded) > max(spread)


@pytest.mark.parametrize("name", ["ray_residuals", "station_pairs", "pair_distance_wgs84"])
def test_pairs_of_places_are_not_sent_with_their_stations(spark, sf_dir, name):
    """Whatever the size of the tables, as Spark would shuffle them where it guesses that they are large."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [place1" in line or "Join [place2" in line]
        assert len(joins) == 2 and all("BroadcastHashJoin" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
