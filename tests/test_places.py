"""Pairs of stations by place: counts against plain loops, and work that follows the places, not the pairs of stations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.operators import pairs, places, tomography
from strataspark.plans import kernels
from strataspark.plans.catalog import QUERIES
from strataspark.sources.fixtures import table


@pytest.fixture(scope="module")
def crowded(spark, sf_dir, tmp_path_factory):
    """Six stations at each of the places of sf0.001."""
    d = tmp_path_factory.mktemp("crowded")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("*", "explode(sequence(0, 5)) as k")
    s.withColumn("s_suppkey", s["s_suppkey"] + s["k"] * 2000).drop("k").toPandas().to_parquet(d / "supplier.parquet")
    return str(d)


def test_counts_of_place_pairs(spark):
    rng = np.random.default_rng(1)
    s = pd.DataFrame({"key": rng.permutation(60), "x": rng.integers(0, 3, 60).astype(float), "y": rng.integers(0, 3, 60).astype(float), "a": rng.integers(0, 50, 60), "b": rng.integers(0, 50, 60)})
    places_ = s.groupby(["x", "y"])["key"].min()
    for low, high in (("key", "key"), ("a", "b")):
        got = {(r["place1"], r["place2"]): r["n"] for r in places.place_pairs(spark.createDataFrame(s), "key", low=low, high=high).collect()}
        own = places_.loc[list(zip(s["x"], s["y"], strict=True))].to_numpy()
        pairs = pd.DataFrame({"p": np.repeat(own, 60), "q": np.tile(own, 60), "ok": np.repeat(s[low].to_numpy(), 60) < np.tile(s[high].to_numpy(), 60)})
        want = pairs.groupby(["p", "q"])["ok"].sum()
        assert got == {k: v for k, v in want.items() if v}


def test_rays_follow_places(spark, crowded):
    r = kernels.rays(spark, crowded)
    assert r.count() <= 10 * 10 and r.agg({"n": "sum"}).first()[0] == 60 * 59 // 2


def test_sums_of_shared_rays(spark):
    rng = np.random.default_rng(2)
    r = pd.DataFrame(rng.uniform(0, 1000, (30, 4)), columns=["x1", "y1", "x2", "y2"]).assign(n=rng.integers(1, 4, 30))
    whole = r.loc[r.index.repeat(r["n"])].reset_index(drop=True).assign(ray=lambda d: np.arange(len(d))).drop(columns="n")
    r, whole = spark.createDataFrame(r), spark.createDataFrame(whole)
    for sides in (((0.0, 1.0),), ((-60.0, 0.25), (0.0, 0.5), (60.0, 0.25))):
        got = {(x["cell_x"], x["cell_y"]): (x["rays"], round(x["length"], 6)) for x in tomography.path_sums(r, 32, 100.0, sides).collect()}
        s = tomography.wide_segments(whole, 32, 100.0, sides).groupBy("cell_x", "cell_y").agg({"ray": "count", "length": "sum"}).collect()
        assert got == {(x["cell_x"], x["cell_y"]): (x["count(ray)"], round(x["sum(length)"], 6)) for x in s}
    n = tomography.normal_sums(r, 32, 100.0)
    g = tomography.ray_segments(whole, 32, 100.0)
    res = whole.selectExpr("ray", "0.01 * (ray % 7) as res")
    right = g.join(res, "ray").selectExpr("cell_x", "cell_y", "0 as term", "length * res as v").groupBy("cell_x", "cell_y", "term").agg({"v": "sum"}).withColumnRenamed("sum(v)", "g")
    a = {(x["cell_x"], x["cell_y"]): x["m"] for x in tomography.invert_normal(n, right, 50.0, 5).collect()}
    b = {(x["cell_x"], x["cell_y"]): x["m"] for x in tomography.invert_rays(g, res, 50.0, 5).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("name", ["ray_residuals", "anisotropic_tomography"])
def test_queries_on_crowded_places(spark, crowded, name):
    rows = QUERIES[name](spark, crowded).collect()
    if name == "ray_residuals":
        assert len({r["ray"] for r in rows}) == len(rows) == 60 * 59 // 2
    else:
        assert {r["term"]: r["m"] for r in rows} == {0: 0.01, 1: 0.004, 2: -0.002}


def test_pairs_are_worked_on_by_place(spark, crowded):
    seen = []

    def values(p):
        seen.append(p.count())
        return p.select("place1", "place2")

    s = table(spark, crowded, "stations")
    x = places.by_pair(s, "sta_key", ("lon", "lat"), ("staid",), values, F.col("s1.staid") < F.col("s2.staid"))
    assert x.count() == 60 * 59 // 2 and seen == [100]


def test_distance_classes_without_pairs_of_one_id(spark, crowded, tmp_path):
    s = pd.read_parquet(f"{crowded}/supplier.parquet")
    # ids of more than five digits are cut, so these two have one
    s = pd.concat([s, s.iloc[:2].assign(s_suppkey=[1_000_001, 1_000_002], s_nationkey=3)])
    s.to_parquet(tmp_path / "supplier.parquet")
    pairs = QUERIES["station_pairs"](spark, str(tmp_path)).selectExpr("floor(dist / 100) as hundred_km").groupBy("hundred_km").count().collect()
    got = QUERIES["station_distance_classes"](spark, str(tmp_path)).collect()
    assert {(r["hundred_km"], r["n"]) for r in got} == {(r["hundred_km"], r["count"]) for r in pairs}


def test_earlier_neighbour_with_shared_places(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"k": rng.permutation(40), "lon": rng.integers(0, 4, 40).astype(float), "lat": rng.integers(0, 2, 40).astype(float)}).assign(at=lambda d: d["lon"] + d["lat"])
    got = {r["k"]: r["near"] for r in pairs.nearest_earlier(spark.createDataFrame(p), "k").collect()}
    d = pairs._distances(p["lon"].to_numpy(), p["lat"].to_numpy(), p[["lon", "lat"]].to_numpy())
    before = (p["at"].to_numpy() < p["at"].to_numpy()[:, None]) | ((p["at"].to_numpy() == p["at"].to_numpy()[:, None]) & (p["k"].to_numpy() < p["k"].to_numpy()[:, None]))
    want = {p["k"][i]: min((round(d[i, j], 6), p["k"][j]) for j in np.nonzero(before[i])[0])[1] for i in range(40) if before[i].any()}
    assert got == want


def test_event_distances_against_windows(spark, crowded, sf_dir):
    e, s = table(spark, sf_dir, "catalog").where("evid % 10 = 0"), table(spark, crowded, "stations")
    x = pairs.event_windows(e, s, 2.0, 5.0).where("dist / 111.12 between 30 and 90").groupBy("evid").agg({"*": "count", "dist": "sum"}).collect()
    got = {r["evid"]: (r["n"], round(r["total"], 3)) for r in pairs.event_distances(e, s, 111.12, (30.0, 90.0)).collect()}
    assert got == {r["evid"]: (r["count(1)"], round(r["sum(dist)"], 3)) for r in x}


def test_three_places_against_joins(spark, crowded):
    s = table(spark, crowded, "stations").select("sta_key", "lon", "lat").where("sta_key < 4010")
    a, b = s.toDF("sta1", "lon1", "lat1"), s.toDF("sta2", "lon2", "lat2")
    legs = a.join(b, a["sta1"] < b["sta2"]).select("sta1", "sta2", geo.distance_km("lon1", "lat1", "lon2", "lat2").alias("d"))
    want = pairs.three_station(legs.withColumnRenamed("d", "d0"), legs, 0.05, 1.0)
    key = lambda d: sorted((r["sta1"], r["sta2"], r["source"], r["zone"], round(r["difference"], 6) + 0.0) for r in d.collect())
    assert key(places.three_places(s, "sta_key", ("lon", "lat"), 0.05, 1.0)) == key(want)
