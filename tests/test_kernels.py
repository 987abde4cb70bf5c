"""Kernels and tables added after the first queries, against closed forms, published values and direct computation."""

import numpy as np
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.operators import blocks, interferometry, inversion, layers, lookup, pairs, stacks, tomography
from strataspark.operators.inversion import love_velocities, love_velocity, prior_ok, sample_chains
from strataspark.sources import files

#: Upper layers of the AK135 model, flat: thickness, vp, vs, density (fixed values).
AK135 = np.array([(20, 5.8, 3.46, 2.72), (15, 6.5, 3.85, 2.92), (42.5, 8.04, 4.48, 3.32), (42.5, 8.045, 4.49, 3.34), (45, 8.05, 4.5, 3.35), (45, 8.175, 4.509, 3.36), (0, 8.3, 4.518, 3.37)]).T
PERIODS = np.array([10.0, 15, 20, 25, 30, 35, 40])


def test_dispersion_of_a_published_model():
    h, vp, vs, rho = AK135
    rayleigh, love = layers.rayleigh_velocity(h, vp, vs, rho, PERIODS), love_velocity(h, vs, rho, PERIODS)
    assert np.allclose(rayleigh, [3.2271, 3.3715, 3.5552, 3.7102, 3.8115, 3.8741, 3.9145], rtol=0.004)
    assert np.allclose(love, [3.6103, 3.7302, 3.8572, 3.9771, 4.0801, 4.1632, 4.2279], rtol=0.003)


def test_chains_in_step():
    rng, n = np.random.default_rng(0), 30
    h, vs = np.column_stack([rng.uniform(5, 30, n), np.full(n, 20.0), np.zeros(n)]), np.sort(rng.uniform(2.4, 4.6, (n, 3)), axis=1)
    rho, t = np.array([2.6, 2.8, 3.3]), np.array([8.0, 15, 25, 40])
    assert np.allclose(love_velocities(h, vs, rho, t), [love_velocity(h[i], vs[i], rho, t, 0.005) for i in range(n)], atol=1e-5)
    forward = lambda p: love_velocities(np.column_stack([p[:, 0], np.full(len(p), 20.0), np.zeros(len(p))]), p[:, 1:], rho, t)
    start = np.tile([15.0, 3, 3.6, 4.4], (6, 1))
    curves = forward(start) + 0.02 * np.arange(6)[:, None]
    run = lambda k: sample_chains(k, 40, start[k], np.array([0.8, 0.05, 0.05, 0.05]), np.array([5, 2.2, 3, 4.0]), np.array([30, 3.6, 4.2, 4.6]), forward, curves[k], np.full(4, 0.05), lambda p: prior_ok(p[1:], 2))
    together, alone = run(list(range(6))), run([3])
    assert np.array_equal(together[3], alone[0]) and (together[:, :, 0] > 0).any() and (together[:, :, 0] < 0).any()
    taken = together[:, :, 0] > 0
    for c in range(6):  # a step that isn't taken is one with a smaller likelihood than the last that was
        like = together[c, 0, 2]
        for k in range(1, 40):
            assert taken[c, k] or together[c, k, 2] < like
            like = together[c, k, 2] if taken[c, k] else like


def test_rayleigh_limits():
    for vs in (2.5, 3.5):
        c = layers.rayleigh_velocity(np.array([10.0, 20, 0]), np.full(3, vs * 3**0.5), np.full(3, vs), np.full(3, 2.7), np.array([5.0, 20, 80]))
        assert np.allclose(c / vs, (2 - 2 / 3**0.5) ** 0.5, atol=1e-6)
    # a thin cover doesn't matter to long waves
    c = layers.rayleigh_velocity(np.array([0.5, 0]), np.array([5.0, 3.5 * 3**0.5]), np.array([2.9, 3.5]), np.array([2.6, 2.7]), np.array([200.0]))
    assert abs(c[0] / 3.5 - 0.9194) < 0.003


def test_receiver_function_of_layers():
    p, delta = 0.06, 0.05
    for vs in (3.2, 4.0):
        rf = layers.receiver_function(np.array([10.0, 0]), np.full(2, vs * 1.75), np.full(2, vs), np.full(2, 2.8), p, delta, 400)
        assert abs(rf[0] - np.tan(2 * np.arcsin(p * vs))) < 2e-3 and np.abs(rf[40:]).max() < 2e-3
    vp, vs, h = np.array([6.2, 8.0]), np.array([3.5, 4.5]), 32.0
    rf = layers.receiver_function(np.array([h, 0]), vp, vs, np.array([2.8, 3.3]), p, delta, 800)
    eta = [np.sqrt(1 / v**2 - p * p) for v in (vs[0], vp[0])]
    window = lambda t: slice(int(t / delta) - 20, int(t / delta) + 20)
    for t, sign in ((h * (eta[0] - eta[1]), 1), (h * (eta[0] + eta[1]), 1), (2 * h * eta[0], -1)):
        w = window(t)
        assert abs((w.start + (sign * rf[w]).argmax()) * delta - t) <= delta and (sign * rf[w]).max() > 0.03


def test_splines():
    x = np.sort(np.random.default_rng(1).uniform(0, 5, 9))
    at = np.linspace(x[0], x[-1], 40)
    f = lambda t: 0.3 * t**3 - t**2 + 2
    assert np.allclose(layers.spline(x, np.stack([f(x), np.ones(9)]), at), np.stack([f(at), np.ones(40)]))
    for n, degree in ((4, 3), (7, 3), (5, 2)):
        b = layers.basis(n, degree, 50)
        assert np.allclose(b.sum(axis=1), 1) and (b >= 0).all() and b[0, 0] == b[-1, -1] == 1
    t = np.linspace(0, 1, 50)
    assert np.allclose(layers.basis(4, 3, 50)[:, 1], 3 * t * (1 - t) ** 2)


def test_ridges():
    periods = np.arange(6.0, 26, 2)
    g = 3 + 0.02 * periods
    broken = g.copy()
    broken[3:5] += 0.8
    fixed, best = interferometry.repaired(periods, broken, 0.2, 3)
    assert np.allclose(fixed, g) and best == slice(0, 10)
    broken[6:] += 2
    fixed, best = interferometry.repaired(periods, broken, 0.2, 3)
    assert np.allclose(fixed[:6], g[:6]) and best == slice(0, 6)


def test_phase_matched_filter():
    periods, d = np.array([8.0, 10, 12, 15, 20, 25, 30]), 500.0
    group = 2.9 + 0.02 * periods
    wave = interferometry.dispersed(1024, 1.0, d, periods, group, 0.45, 0.2)
    t = np.arange(1024) - d / 1.9
    other = 3 * np.abs(wave).max() * np.exp(-((t / 15) ** 2)) * np.cos(2 * np.pi * t / 12)
    clean = interferometry.phase_matched(wave + other, 1.0, d, periods, group, 40.0)
    f = interferometry.frequency_times(np.stack([wave + other, clean]), 1.0, np.array([d, d]), periods[1:5])["group"]
    assert np.abs(f[1] - group[1:5]).max() < 0.06 < np.abs(f[0] - group[1:5]).max()
    at = slice(int(d / 1.9) - 10, int(d / 1.9) + 10)
    assert np.abs(clean[at]).max() < 0.2 * np.abs(other).max()


def test_resolution_and_smoothing_against_dense_algebra(spark):
    rng = np.random.default_rng(6)
    f = rng.uniform(0, 1, (40, 9)) * (rng.uniform(size=(40, 9)) < 0.5)
    rows = [(r, k % 3, k // 3, float(f[r, k])) for r in range(40) for k in range(9) if f[r, k]]
    g = spark.createDataFrame(rows, "ray long, cell_x int, cell_y int, length double")
    dense = np.linalg.solve(f.T @ f + 0.5 * np.eye(9), f.T @ f)
    got = {(r["cell_x"], r["cell_y"]): r for r in tomography.resolution(g, 100.0, 0.5, 9).collect()}
    for k in range(9):
        m = np.abs(dense[:, k])
        d = 100 * np.hypot(np.arange(9) % 3 - k % 3, np.arange(9) // 3 - k // 3)
        w = np.where(m > 0.2 * m.max(), m, 0)
        r = got[k % 3, k // 3]
        assert np.isclose(r["response"], m.max(), atol=1e-6) and np.isclose(r["cone"], min(2000, 2 * (w * d).sum() / w.sum()), atol=1e-3)
        assert np.isclose(r["sigma"], max(50, np.sqrt((w * d**2).sum() / w.sum() / 2)), atol=1e-3)
    res = f @ np.array([1.0, 0, 0, 0, 0, 0, 0, 0, 0])
    near = [(a, b) for a in range(9) for b in range(9) if (a % 3 + 1 == b % 3 and a // 3 == b // 3) or (a % 3 == b % 3 and a // 3 + 1 == b // 3)]
    s = np.zeros((len(near), 9))
    for k, (a, b) in enumerate(near):
        s[k, a], s[k, b] = 2.0, -2.0
    want = np.linalg.solve(f.T @ f + s.T @ s + 0.5 * np.eye(9), f.T @ res)
    m = tomography.smoothed(g, spark.createDataFrame([(r, float(x)) for r, x in enumerate(res)], "ray long, res double"), 0.5, 2.0, 15).collect()
    assert np.allclose([r["m"] for r in sorted(m, key=lambda r: r["cell_y"] * 3 + r["cell_x"])], want, atol=1e-6)


def test_filters():
    t = np.arange(400)
    x = np.stack([np.sin(2 * np.pi * t / 80), np.ones(400)])
    y = interferometry.decimated(x, 4)
    assert y.shape == (2, 100) and np.allclose(y[:, 10:-10], x[:, ::4][:, 10:-10], atol=5e-3)
    rng = np.random.default_rng(3)
    h, p, own = (rng.normal(size=(40, 64)) for _ in range(3))
    z = own + np.fft.irfft(np.fft.rfft(h, 64) * 2.0, 64) + np.fft.irfft(np.fft.rfft(p, 64) * np.linspace(1, 3, 33), 64)
    left = interferometry.noise_removed(z, [h, p], 64)
    assert np.corrcoef(left.ravel(), own.ravel())[0, 1] > 0.95 > np.corrcoef(z.ravel(), own.ravel())[0, 1]


def test_block_products_across_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, d, rng.normal(size=16).tolist()) for s in (1, 4, 7, 8, 9, 20) for d in range(5) if (s + d) % 4]
    t = spark.createDataFrame(rows, "sta_key long, day long, data array<double>")
    by = {(s, d): np.array(x) for s, d, x in rows}
    want: dict = {}
    for (a, d), x in by.items():
        for (b, e), y in by.items():
            if a < b and d == e:
                v = want.setdefault((a, b), np.zeros(6))
                v += [1, *(sum(x[i] * y[i + k] for i in range(16) if 0 <= i + k < 16) for k in range(-2, 3))]
    got = {(r["sta1"], r["sta2"]): [r["n"], *(r[f"v{k}"] for k in range(5))] for r in blocks.lag_sums(t, 2, block=5, days=2).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    one = {(r["sta1"], r["sta2"], r["day"]): r["x"] for r in blocks.spectral_lags(t, {"x": -1}, block=5, days=2).collect()}
    assert all(np.isclose(v, sum(by[a, d][i] * by[b, d][i - 1] for i in range(1, 16))) for (a, b, d), v in one.items()) and len(one) == sum(int(v[0]) for v in want.values())


def test_grouped_medians(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 500), (3, 501)) for v in np.round(rng.normal(size=n) ** 3, 2)] + [(4, 2.0)] * 7
    d = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["median"] for r in stacks.grouped_median(d.groupBy("k", "v").agg(F.count("*").alias("n")), "k", "v").collect()}
    mad = {r["k"]: r["mad"] for r in stacks.grouped_mad(d, "k", "v").collect()}
    for k in range(5):
        v = np.array([x for i, x in rows if i == k])
        assert np.isclose(got[k], np.median(v)) and np.isclose(mad[k], np.median(np.abs(v - np.median(v))))


def test_near_join_wraps(spark):
    a = spark.createDataFrame([(1, 179.9, 10.0), (2, -179.95, -5.0), (3, 359.8, 0.0)], "k int, lon double, lat double")
    b = spark.createDataFrame([(1, -179.9, 10.1), (2, 180.0, -5.0), (3, 0.1, 0.0), (4, 90.0, 0.0)], "j int, lon_r double, lat_r double")
    for radius in (0.5, 7.0, 50.0):
        assert {(r["k"], r["j"]) for r in pairs.near_join(a, b, radius).where("abs(lat - lat_r) < 1").collect()} >= {(1, 1), (2, 2), (3, 3)}
    assert pairs.near_join(a, b, 0.5).count() == 3


def test_masks_and_planes(spark):
    c = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 0)], "ilat int, ilon int, mask int")
    any_, all_ = ({(r["ilat"], r["ilon"]): r["mask"] for r in lookup.smoothed_mask(c, every=e).collect()} for e in (False, True))
    assert len(any_) == 9 and any_[0, 1] == any_[1, 1] == 1 and all_[0, 1] == all_[1, 1] == 0 and all_[0, 0] == 1 and any_[2, 1] == 0
    x, y = np.random.default_rng(1).uniform(0, 100, (2, 12))
    gx, gy = np.meshgrid(np.linspace(0, 100, 5), np.linspace(0, 100, 5))
    assert np.allclose(tomography.biharmonic(x, y, 2 + 0.1 * x - 0.3 * y, gx.ravel(), gy.ravel()), (2 + 0.1 * gx - 0.3 * gy).ravel())


def test_great_circle_points(spark):
    d = spark.createDataFrame([(0.0, 0.0, 90.0, 0.0), (10.0, 0.0, 10.0, 80.0)], "a double, b double, c double, d double")
    lon, lat = geo.along(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0.5))
    assert [tuple(np.round(r, 6)) for r in d.select(lon, lat).collect()] == [(45.0, 0.0), (10.0, 40.0)]


def test_curves_and_correlations_on_disk(spark, tmp_path):
    c = spark.createDataFrame([("A.B", 8.0, 3.1, 0.02), ("A.B", 10.0, 3.2, None), ("C.D", 8.0, 3.3, 0.1)], "pair string, period double, value double, uncertainty double")
    files.write_curves(c, str(tmp_path / "curves"), ["pair"])
    assert sorted(map(tuple, files.read_curves(spark, str(tmp_path / "curves"), ["pair"]).collect()), key=str) == sorted(map(tuple, c.collect()), key=str)
    k = spark.createDataFrame([(1, 2, "ZZ", [1.0, 2.0, 3.0]), (5, 3, "ZZ", [4.0, 5.0, 6.0]), (1, 2, "RR", [7.0])], "sta1 long, sta2 long, channels string, data array<double>")
    files.write_correlations(k, str(tmp_path / "k"))
    find = lambda *a: [(r["sta1"], r["sta2"], r["channels"], r["data"]) for r in files.find_correlation(spark, str(tmp_path / "k"), *a).collect()]
    assert find(1, 2, "ZZ") == [(1, 2, "ZZ", [1.0, 2.0, 3.0])] and find(2, 1, "ZZ") == [(2, 1, "ZZ", [3.0, 2.0, 1.0])]
    assert find(5, 3) == [(5, 3, "ZZ", [4.0, 5.0, 6.0])] and find(3, 5) == [(3, 5, "ZZ", [6.0, 5.0, 4.0])] and find(1, 9) == [] and len(find(1, 2)) == 2
    m = spark.createDataFrame([(0, 1, 0, 2.5, 0.5, 0.05)], "part int, kind int, place int, value double, space double, step double")
    files.write_columns(m, str(tmp_path / "m"), files.PARAMETERS)
    assert files.read_columns(spark, str(tmp_path / "m"), files.PARAMETERS).collect() == m.collect()


def test_love_brackets_by_halves():
    rng = np.random.default_rng(3)
    n, rho, periods = 400, np.array([2.6, 2.8, 3.3]), np.array([8.0, 15, 25, 40])
    h = np.column_stack([rng.uniform(5, 30, n), np.full(n, 20.0), np.zeros(n)])
    vs = np.column_stack([rng.uniform(2.2, 3.6, n), rng.uniform(3.0, 4.2, n), rng.uniform(4.0, 4.6, n)])
    want = inversion._love_scanned(h, vs, rho, periods, 96)
    got = inversion.love_velocities(h, vs, rho, periods)
    assert (np.diff(vs, axis=1) > 0).all(axis=1).sum() > 200 and np.array_equal(got, want, equal_nan=True)


def test_halves_look_at_few_velocities(monkeypatch):
    seen = []
    monkeypatch.setattr(inversion, "_love_traction", lambda h, vs, mu, w, c, own=inversion._love_traction: seen.append(c.shape[-1]) or own(h, vs, mu, w, c))
    inversion.love_velocities(np.array([[15.0, 20, 0]]), np.array([[3.0, 3.6, 4.4]]), np.array([2.6, 2.8, 3.3]), np.array([8.0, 40]))
    assert sum(seen) == 2
