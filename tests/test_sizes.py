"""Tables that are large but lie in few files, or have keys of very many rows, are dealt to tasks by their size."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.operators import dealing, fields, stacks
from strataspark.plans.catalog import QUERIES


def test_paths_of_one_file_are_dealt_out(spark, sf_dir, tmp_path):
    s = pd.read_parquet(f"{sf_dir}/supplier.parquet").iloc[[0]]
    pd.concat([s] * 4000).assign(s_suppkey=np.arange(4000)).to_parquet(tmp_path / "supplier.parquet")
    x = QUERIES["predicted_velocity"](spark, str(tmp_path))
    assert x.count() == 3999 and x.rdd.getNumPartitions() > 1


def test_points_of_paths(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 90.0, 0.0), (2, 170.0, -50.0, -160.0, 60.0), (3, 0.0, 0.0, 0.0, 0.0), (4, None, 5.0, 6.0, 5.0)], "id int, lon double, lat double, lon2 double, lat2 double")
    got = {(r["id"], r["k"]): r for r in fields.sampled(p, 4).collect()}
    lon, lat = geo.along(*map(F.col, ("lon", "lat", "lon2", "lat2")), (F.col("k") + 0.5) / 4)
    want = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("id", "k", lon.alias("lon"), lat.alias("lat"), geo.distance_km("lon", "lat", "lon2", "lat2").alias("dist")).collect()
    assert len(got) == len(want) == 16
    for r in want:
        g = got[r["id"], r["k"]]
        assert all(g[c] is None if r[c] is None else abs(g[c] - r[c]) < 1e-6 for c in ("lon", "lat"))
        assert r["id"] == 4 or abs(g["dist"] - r["dist"]) < 1e-6
    assert got[3, 0]["lon"] is None and got[2, 0]["lon"] is not None


def test_medians_of_rows_however_they_lie(spark):
    rng = np.random.default_rng(7)
    d = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in enumerate((rng.normal(size=30_000) ** 9, np.append(rng.normal(size=4999), 1e12), np.repeat([1.0, 2.0], 700), [5.0], [5.0, 7.0], rng.integers(0, 3, 999).astype(float)))])
    d = pd.concat([d, pd.DataFrame({"k": [1] * 999 + [6], "v": [None] * 1000})])
    rows = spark.createDataFrame([(int(k), None if v != v else float(v)) for k, v in d.itertuples(index=False)], "k int, v double")
    got, mad = ({r["k"]: r[1] for r in x.collect()} for x in (stacks.row_median(rows, "k", "v"), stacks.grouped_mad(rows, "k", "v")))
    for k, v in d.groupby("k")["v"]:
        v = v.dropna()
        assert (got[k], mad[k]) == ((None, None) if v.empty else (v.median(), (v - v.median()).abs().median()))


def test_no_task_has_a_period_to_itself(spark, sf_dir):
    """Joins with a few numbers a period leave rows where they are; only counts are sorted."""
    plan = QUERIES["residual_mad_qc"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rows_are_dealt_by_their_number(spark):
    x = dealing.dealt(spark.range(1000).withColumn("k", F.col("id") % 100), 20 * dealing.TASK_ROWS, "k")
    assert x.rdd.getNumPartitions() == 20 and dealing.dealt(x, 1, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["longest_smooth_segment", "curve_jumps", "local_extrema", "dispersion_sanity", "smoothed_profile", "period_resample", "correlation_lookup"])
def test_tasks_of_curves_follow_their_rows(spark, sf_dir, monkeypatch, name):
    """Curves are shuffled once, by pair, in partitions for their number of rows; what groups and orders them stays in these."""
    monkeypatch.setattr(dealing, "TASK_ROWS", 500)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    shuffles = re.findall(r"Exchange hashpartitioning\((?:sta1|sta2)[^\n]*", plan)
    assert shuffles and all(f", {parts})" in s for s in shuffles)
