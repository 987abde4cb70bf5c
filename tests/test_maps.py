"""Masks, overwritten maps, table functions, two-pass inversion, and the stream of gaps with its state over a restart."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataspark.functions import tables
from strataspark.operators import arrays, lookup, masks, signal, sphere
from strataspark.streaming import gaps


def test_masks_by_a_plain_loop(spark):
    rnd = random.Random(1)
    rows = [(p, i, j, rnd.random() < (0.06 if p else 0.0)) for p in range(4) for i in range(9) for j in range(11)]
    rows += [(0, 5 + a, 5 + b, True) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]  # a hole in the middle
    for rings in (0, 1, 2):
        got = {(r["ilat"], r["ilon"]): r["masked"] for r in masks.combined_mask(spark.createDataFrame(rows, "period int, ilat int, ilon int, bad boolean"), rings).collect()}
        m = {(i, j): any(b for _, x, y, b in rows if (x, y) == (i, j)) for i in range(9) for j in range(11)}
        near = lambda m, i, j: [m.get((i + a, j + b), False) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        m = {k: v or all(near(m, *k)) for k, v in m.items()}
        for _ in range(rings):
            m = {k: v or any(near(m, *k)) for k, v in m.items()}
        assert got == m and m[5, 5]
    a = spark.createDataFrame([(0, 0, False), (0, 1, False), (0, 2, True)], "ilat int, ilon int, masked boolean")
    b = spark.createDataFrame([(0, 1, True), (7, 7, True)], "ilat int, ilon int, masked boolean")
    assert sorted(map(tuple, masks.merged_mask(a, b).collect())) == [(0, 0, False), (0, 1, True), (0, 2, True)]


def test_overwriting(spark):
    g = spark.createDataFrame([(-10.0, 5.0, 3.0), (10.0, 5.0, 3.0), (20.0, 5.0, 3.0), (30.0, 5.0, 3.0), (0.0, 0.0, 3.0)], "lon double, lat double, v double")
    r = spark.createDataFrame([(350.02, 5.04, 3.2), (10.0, 5.06, 3.1), (20.0, 5.0, 3.6), (30.0, 5.0, 0.0), (0.01, 0.0, 3.1), (0.01, 0.02, 3.3)], "lon double, lat double, v double")
    got = {x["lon"]: (x["v"], x["changed"]) for x in masks.overwritten(g, r).collect()}
    assert got == {-10.0: (3.2, True), 10.0: (3.0, False), 20.0: (3.0, False), 30.0: (3.0, False), 0.0: (3.3, True)}


def test_table_functions(spark):
    tables.register(spark)
    r = spark.sql("select * from ray_samples(0D, 0D, 90D, 0D, 3)").collect()
    assert [(x["k"], round(x["lon"], 9), round(x["lat"], 9)) for x in r] == [(0, 15, 0), (1, 45, 0), (2, 75, 0)]
    assert spark.sql("select * from ray_samples(0D, 0D, 180D, 0D, 3)").count() == 0 and spark.sql("select * from ray_samples(null, 0D, 180D, 0D, 3)").count() == 0
    g = spark.sql("select * from grid_cells(50D, 10D, 0.5D, 2, 3)").collect()
    assert len(g) == 6 and tuple(g[-1]) == (1, 2, 50.5, 11.0)


def test_precursors_and_shifts_as_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(v) for v in rng.normal(size=301) * (1 + 8 * (np.abs(np.arange(301) - 150) < 20) * (k % 2))], float(d)) for k, d in enumerate((200, 200, 5, 900))]
    d = spark.createDataFrame(rows, "k int, data array<double>, distance double").withColumn("p", arrays.precursor_noise(F.col("data"), 1.0, F.col("distance")))
    for r in d.select("k", "data", "distance", "p.*").collect():
        x, early = np.array(r["data"]), int(min(r["distance"] / 4.5, 100))
        assert np.isclose(r["head"], np.sqrt((x[150 - early + 1 : 150 + early] ** 2).mean())) and np.isclose(r["tail"], np.sqrt((np.concatenate([x[:10], x[-10:]]) ** 2).mean()))
        assert signal.precursor(x, 1.0, r["distance"]) == (early >= 2 and r["head"] > 5 * r["tail"])
    s = arrays.time_shifted(spark.createDataFrame([(rows[0][1], 3.0), (rows[1][1], 0.5)], "data array<double>, shift double"), 1.0).collect()
    assert np.allclose(s[0]["data"][3:], rows[0][1][:-3], atol=1e-9) and np.allclose(s[1]["data"], signal.time_shift(np.array(rows[1][1]), 1.0, 0.5))


def test_second_pass_leaves_outliers_out(spark):
    rng = np.random.default_rng(3)
    rays = [(k, *map(float, (rng.uniform(0, 6), rng.uniform(40, 45), rng.uniform(0, 6), rng.uniform(40, 45)))) for k in range(150)]
    g = sphere.ray_cells(spark.createDataFrame(rays, "ray bigint, lon1 double, lat1 double, lon2 double, lat2 double"), 1.0).withColumn("term", F.lit(0))
    bad = F.when(F.col("ray") % 19 == 4, 60.0).otherwise(0.0)
    res = g.groupBy("ray").agg((F.sum("g") * 0.01).alias("res")).select("ray", (F.col("res") + bad).alias("res"), F.lit(1.0).alias("weight"))
    m, used = sphere.two_passes(g, res, {0: 1.0}, {0: 300.0}, {0: 100.0}, (1.0, 0.1), 0.01)
    u = {r["ray"]: r["used"] for r in used.collect()}
    assert not any(v for k, v in u.items() if k % 19 == 4) and sum(u.values()) > 125
    x = m.where("rays > 3").toPandas()
    assert abs(x["m"].median() - 0.01) < 0.001


def test_gaps_go_on_after_a_restart(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    days = [[(1, "a", 0), (1, "a", 5), (1, "b", 3), (2, "a", 1)], [(1, "a", 30), (1, "b", 4), (2, "a", 100)], [(1, "a", 32), (1, "a", 60), (2, "a", 101), (1, "b", 50)]]
    rows, n = [], 0
    for k, day in enumerate(days):
        d = spark.createDataFrame([(n + i, at(s).to_pydatetime(), u, e) for i, (u, e, s) in enumerate(day)], "event_id bigint, ts timestamp, user_id bigint, event_type string")
        d.coalesce(1).write.parquet(str(tmp_path / "all" / f"{k}"))
        n += len(day)
    schema = d.schema

    def until(k):
        """Reads the first k days' folders, from the checkpoint that is there."""
        for j in range(k):
            if not (tmp_path / "in" / f"{j}.parquet").exists():
                (tmp_path / "in").mkdir(exist_ok=True)
                next((tmp_path / "all" / f"{j}").glob("part-*")).rename(tmp_path / "in" / f"{j}.parquet")
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep = lambda b, _: rows.extend(map(tuple, b.select("user_id", "event_type", F.unix_timestamp("start"), F.unix_timestamp("stop"), "seconds").collect()))
        q = gaps.gaps(s, 10.0, most=4).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()

    for k in (1, 2, 3):
        until(k)
    zero = int(pd.Timestamp("2024-01-01").timestamp())
    assert sorted((u, e, a - zero, b - zero, s) for u, e, a, b, s in rows) == [(1, "a", 5, 30, 25.0), (1, "b", 4, 50, 46.0), (2, "a", 1, 100, 99.0)]


def test_depths_are_mixed_below_sea_level(spark):
    g = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, 30.0), (2, 0.0, 50.0, 1.0, 2.0, 30.0), (3, 10.0, 0.0, -3.0, 0.1, 10.0)], "pid int, lon double, lat double, topo double, sed double, crust double")
    s = spark.createDataFrame([(7, 0.0, 0.3, 2.0, 1.0, 40.0), (8, 10.0, 0.3, 3.0, 0.5, 20.0)], "sid int, lon_r double, lat_r double, topo_s double, sed_s double, crust_s double")
    got = {r["pid"]: r for r in lookup.blend_depths(g, s, 75.0, 2.5).collect()}
    w = 0.3 * 6371 * np.pi / 180 / 75
    base, moho = w * 1 + (1 - w) * -1, w * 31 + (1 - w) * 39
    assert np.isclose(got[1]["sed"], base + 1) and np.isclose(got[1]["crust"], moho - base) and got[1]["sid"] == 7
    assert (got[2]["sid"], got[2]["sed"], got[2]["crust"]) == (None, 2.0, 30.0)
    # the mixed base would be above the sea floor
    assert np.isclose(got[3]["sed"], w * 0.1 + (1 - w) * 0.5)
