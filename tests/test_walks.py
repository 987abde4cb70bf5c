"""The joint inversion's walks are run once, and its receiver functions are real sums."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.operators import layers
from strataspark.plans import posterior
from strataspark.plans.catalog import QUERIES


@pytest.mark.parametrize("p", [0.06, 0.1, 0.14])
def test_receiver_functions_of_many_models(p, monkeypatch):
    """Also where a wave doesn't go through a layer (0.14)."""
    rng, n = np.random.default_rng(0), 30
    h, vs = rng.uniform(0, 6, (n, 8)), np.sort(rng.uniform(1.8, 4.6, (n, 8)), axis=1)
    h[:, 3], h[::2, 5] = 0, 0
    a = (h, 1.75 * vs, vs, 2.5 + vs / 10, p, 0.5, 20)
    want = [layers.receiver_function(*(x[k] for x in a[:4]), *a[4:]) for k in range(n)]
    asked, one = [], layers.receiver_function
    monkeypatch.setattr(layers, "receiver_function", lambda *x: asked.append(1) or one(*x))
    # matrices of four by four waves aren't turned over
    monkeypatch.setattr(layers.np.linalg, "inv", None if p < 0.12 else np.linalg.inv)
    assert np.allclose(layers.receiver_functions(*a), want, atol=1e-12) and len(asked) == int((p * a[1] >= 1).any(axis=1).sum())


def test_walks_are_run_once(spark, sf_dir, tmp_path):
    """No plan after them has them, so nothing runs them again."""
    x = QUERIES["joint_posterior"](spark, sf_dir)
    assert x._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1 and x.count() > 0


def test_one_group_as_near_best(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"grid": np.repeat(np.arange(12), 60), "step": np.tile(np.arange(60), 12), "accepted": 1})
    d["misfit"] = rng.gamma(2.0, np.repeat(rng.uniform(0.1, 3.0, 12), 60))
    d = d[(d["grid"] > 0) | (d["step"] < 9)]
    want = sorted(map(tuple, posterior.near_best(spark.createDataFrame(d), ["grid"], ["step"], least=20).select("grid", "step", "threshold").collect()))
    got = []
    for grid, g in d.groupby("grid"):
        threshold, keep = posterior.near(g["misfit"].to_numpy(), 20)
        got += [(grid, s, threshold) for s in g["step"][keep]]
    assert sorted(got) == want and len(want) < len(d)


def test_means_as_of_samples(spark, sf_dir):
    """Which stations share a task doesn't matter."""
    seen = posterior._observed(spark, sf_dir).limit(3).localCheckpoint()
    tasks = seen.selectExpr("*", "explode(sequence(0L, 1L)) as chain")
    s = posterior.near_best(posterior.sampled(tasks, 20, 10, 5, 1e9), ["grid"], ["chain", "step"], least=5)
    want = {r["grid"]: r for r in s.groupBy("grid").agg(F.count("*").alias("n"), F.min("misfit").alias("misfit"), F.max("threshold").alias("threshold"), F.avg(F.col("p")[2]).alias("p2")).collect()}
    got = posterior.means_near_best(seen, 2, 5, 20, 10, 5, 1e9).collect()
    assert len(got) == len(want) == 3
    for r in got:
        w = want[r["grid"]]
        assert r["n"] == w["n"] and np.allclose([r["misfit"], r["threshold"], r["p"][2]], [w["misfit"], w["threshold"], w["p2"]], rtol=1e-9)
