"""Every registered query of the engine against its SQL in DuckDB, and kernels against closed forms."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataspark.functions import geo
from strataspark.operators import arrays, inversion, signal, stacks, tomography
from strataspark.plans.catalog import QUERIES, SQL
from strataspark.sources import files
from strataspark.sources.fixtures import table
from strataspark.streaming import stacks as streams

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SLOW = {"ray_tomography", "monte_carlo_posterior"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return round(float(v), 7) + 0.0 if isinstance(v, (float, np.floating)) else str(v)


def rows(d: pd.DataFrame):
    return sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(SQL)))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).schema) > 1 and (name in SLOW or QUERIES[name](spark, sf_dir).count() > 0)


def test_vincenty(spark):
    d = spark.createDataFrame([(-5.71475, 50.06632, -3.07009, 58.64402), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    r = [x["g"] for x in d.select(geo.wgs84_inverse("a", "b", "c", "d").alias("g")).collect()]
    assert abs(r[0]["distance"] - 969.954) < 0.01 and abs(r[0]["azimuth"] - 9.1419) < 1e-3 and r[1]["distance"] == 0


def test_correlation_and_shift():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), rng.normal(size=200)
    assert np.allclose(signal.correlate(x, y, 20)[20], x @ y) and np.allclose(signal.correlate(x, y, 20)[25], x[:195] @ y[5:])
    p = signal.ricker(500, 1.0, 100.0, 20.0)
    assert np.allclose(signal.time_shift(p, 1.0, 30.0), signal.ricker(500, 1.0, 130.0, 20.0), atol=1e-6)
    assert np.isclose(signal.correlate(p, signal.time_shift(p, 1.0, 7.0), 20).argmax(), 27)


def test_gap_fill_repeats_with_its_seed():
    x = np.sin(np.arange(100) / 5)
    x[20:30], x[95:] = np.nan, np.nan
    a, b = signal.fill_gaps(x, 3), signal.fill_gaps(x, 3)
    assert np.array_equal(a, b) and not np.isnan(a).any() and np.array_equal(a[~np.isnan(x)], x[~np.isnan(x)])


def test_frequency_time_of_a_pulse():
    n, d, v = 1024, 300.0, 3.0
    f = signal.frequency_time(signal.ricker(n, 1.0, d / v, 12.0), 1.0, d, np.array([8.0, 12.0, 16.0]))
    assert np.allclose(f["group"], v, atol=0.05) and (f["snr"] > 20).all()
    w = 2 * np.pi / np.array([8.0, 12.0, 16.0])
    c = np.array([3.2, 3.4, 3.6])
    phase = w * 100 - d * w / c + np.pi / 4
    assert np.allclose(signal.phase_velocity(np.full(3, 100.0), (phase + np.pi) % (2 * np.pi) - np.pi, 2 * np.pi / w, d, c), c)


def test_deconvolution_finds_its_spikes():
    v = signal.ricker(400, 0.1, 10.0, 2.0)
    r = 0.5 * v + 0.25 * signal.time_shift(v, 0.1, 4.0)
    rf, share = signal.deconvolve(r, v, 0.1)
    assert share > 99 and abs(int(rf.argmax())) <= 1 and abs(int(rf[20:].argmax()) + 20 - 40) <= 1
    vp, vs = np.full(400, 6.5), np.full(400, 3.7)
    assert np.allclose(signal.move_out(rf, 0.1, 0.06, vp, vs, 0.5)[:300], rf[:300], atol=1e-6)


def test_plane_wave_and_helmholtz():
    x, y = np.meshgrid(np.arange(30) * 20.0, np.arange(25) * 20.0)
    v, angle, reason = tomography.eikonal((x * np.sin(0.5) + y * np.cos(0.5)) / 3.2, 20.0, 20.0)
    assert np.allclose(v, 3.2) and np.allclose(angle, np.degrees(0.5)) and (reason[1:-1, 1:-1] == 0).all() and (reason[0] == 4).all()
    c, bad = tomography.helmholtz(v, np.ones_like(v), 20.0, 20.0, 20.0)
    assert np.allclose(c, v) and not bad.any() and (tomography.helmholtz(v, 0 * v, 20.0, 20.0, 20.0)[1] == 7).all()
    rng = np.random.default_rng(1)
    px, py = rng.uniform(0, 500, 120), rng.uniform(0, 500, 120)
    gx, gy = np.meshgrid(np.linspace(100, 400, 10), np.linspace(100, 400, 10))
    assert np.abs(tomography.biharmonic(px, py, px / 3 + py / 5, gx.ravel(), gy.ravel()) - (gx / 3 + gy / 5).ravel()).max() < 0.5
    d = np.hypot(px + 800, py)
    t = d / 3.1
    assert np.allclose(tomography.unwrap_cycles(d, t + 20 * rng.integers(-1, 2, 120) * (np.arange(120) != d.argmin()), px, py, 20.0), t)


def test_ray_inversion_recovers_a_cell(spark):
    rng = np.random.default_rng(2)
    r = [(k, *map(float, rng.uniform(0, 400, 4))) for k in range(150)]
    g = tomography.ray_segments(spark.createDataFrame(r, "ray bigint, x1 double, y1 double, x2 double, y2 double"), 64, 100.0)
    p = g.toPandas()
    p["res"] = p["length"] * np.where((p["cell_x"] == 1) & (p["cell_y"] == 2), 0.05, 0.0)
    res = spark.createDataFrame(p.groupby("ray", as_index=False)["res"].sum())
    m = {(x["cell_x"], x["cell_y"]): x["m"] for x in tomography.invert_rays(g, res, 1.0, 12).collect()}
    assert abs(m[1, 2] - 0.05) < 0.005 and max(abs(v) for k, v in m.items() if k != (1, 2)) < 0.01


def test_azimuth_fit_recovers_a_direction(spark):
    psi = np.arange(0, 360, 10.0)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "psi": psi, "value": 3.5 + 0.1 * np.cos(2 * np.radians(psi - 40)), "weight": 1.0}))
    f = stacks.azimuth_fit(d, ["k"]).first()
    assert abs(f["a0"] - 3.5) < 1e-9 and abs(f["amplitude"] - 0.1) < 1e-9 and abs(f["fast"] - 40) < 1e-6 and f["misfit"] < 1e-6


def test_rotation_and_symmetry(spark):
    d = spark.createDataFrame([([1.0, 0.0, 2.0], [0.0, 1.0, 2.0], 90.0)], "e array<double>, n array<double>, b double")
    r, t = arrays.rotate(d["e"], d["n"], d["b"])
    x = d.select(r.alias("r"), t.alias("t"), arrays.symmetric(d["e"]).alias("s")).first()
    assert np.allclose(x["r"], [-1, 0, -2]) and np.allclose(x["t"], [0, 1, 2], atol=1e-12) and x["s"] == [0.0, 1.5]


def test_love_waves_between_their_limits():
    h, vs, rho, t = np.array([35.0, 0.0]), np.array([3.5, 4.5]), np.array([2.7, 3.3]), np.array([2.0, 10.0, 20.0, 40.0, 400.0])
    c = inversion.love_velocity(h, vs, rho, t)
    assert (np.diff(c) > 0).all() and abs(c[0] - 3.5) < 0.01 and c[-1] < 4.5
    k = 2 * np.pi / (t[2] * c[2])
    q, g = np.sqrt((c[2] / 3.5) ** 2 - 1) * k, np.sqrt(1 - (c[2] / 4.5) ** 2) * k
    assert abs(np.tan(q * 35) - 3.3 * 4.5**2 * g / (2.7 * 3.5**2 * q)) < 1e-3
    assert inversion.prior_ok(np.array([3.0, 3.6, 4.3]), 2) and not inversion.prior_ok(np.array([3.6, 3.0, 4.3]), 2)


def test_chains_repeat_and_improve(spark):
    tasks = spark.createDataFrame([(1, 0, [3.35, 3.5, 3.75, 3.95])], "grid bigint, chain bigint, curve array<double>")
    a, b = (inversion.run_chains(tasks, 40, (8.0, 15.0, 25.0, 40.0)).toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 40 and a.loc[a["accepted"] == 1, "misfit"].iloc[-1] <= a["misfit"].iloc[0]


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streams.window_stack(streams.read_events(spark, str(tmp_path / "in")), "1 day", "60 days").writeStream.format("memory").queryName("stacked").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = streams.window_stack(e.withColumn("ts", e["ts"].cast("timestamp")))
    key = lambda d: sorted((r["user_id"], r["event_type"], r["start"], round(r["total"], 6), r["n"]) for r in d.collect())
    assert key(spark.table("stacked")) == key(batch)
    q = streams.read_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(streams.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert spark.read.parquet(str(last)).agg({"n": "sum"}).first()[0] == e.count()


def test_text_lists(spark, sf_dir, tmp_path):
    s = table(spark, sf_dir, "stations").select("staid", "lon", "lat", "elev_m")
    files.write_columns(s, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_columns(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, s.collect()))
    (tmp_path / "t").write_text("# list\n\nA.B 1 x 3\nC.D 2.5\n")
    assert sorted(map(tuple, files.read_columns(spark, str(tmp_path / "t"), at=(0, 1, 2, 3)).collect())) == [("A.B", 1.0, None, 3.0), ("C.D", 2.5, None, None)]
    more = files.insert_new(s, s.union(s.limit(1).selectExpr("'X' as staid", "lon", "lat", "elev_m")), ["staid"])
    assert more.count() == s.count() + 1
