"""Travel-time fields: surfaces in tension, cycle skips, neighbours, reasons and amplitudes, against closed forms and plain loops."""

import numpy as np
import pandas as pd
import pytest

from strataspark.operators import travel
from strataspark.operators import travel
from strataspark.operators.travel import Rules, field, green, grown, k0, laplacian, lonely, tension_surface, without_skips


def stations(n=80, seed=0, size=900.0):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, size, n), rng.uniform(0, size, n)


def test_bessel_function():
    # published values
    assert np.allclose(k0(np.array([0.1, 1.0, 2.0, 5.0])), [2.4270690247, 0.4210244382, 0.1138938727, 0.0036910983], rtol=1e-9)
    x = np.array([1e-6, 0.3, 3.0, 15.0, 30.0])
    assert np.allclose(green(x, 0.5), np.where(x < 1e-4, np.log(2) - np.euler_gamma, k0(x) + np.log(x)), atol=2e-7)


def test_responses_close_to_the_source():
    x = np.array([1e-6, 1e-5, 1e-4, 1e-3])
    assert np.allclose(k0(x), np.log(2) - np.euler_gamma - np.log(x), rtol=0, atol=1e-5) and np.allclose(k0(np.array([1 - 1e-9])), k0(np.array([1 + 1e-9])), atol=1e-8)
    x = np.append(np.geomspace(1e-3, 30, 5000), 20.0)
    assert np.abs(green(x.copy(), 0.5) - k0(x) - np.log(x)).max() < 2e-8 and green(np.zeros(1), 0.5)[0] == np.log(2) - np.euler_gamma


@pytest.mark.parametrize("tension", [0.0, 0.2, 0.5])
def test_surface_goes_through_its_points_and_obeys_its_equation(tension):
    x, y = stations(30)
    z = np.sin(x / 150) * np.cos(y / 200) * 5 + x / 100
    assert np.allclose(tension_surface(x, y, z, x, y, tension, 50.0), z, atol=1e-6)
    # away from points (1 - T) del^4 z = T del^2 z in units of the spacing
    h = 0.02
    gx, gy = np.meshgrid(450 + 50 * h * np.arange(-4, 5), 450 + 50 * h * np.arange(-4, 5))
    if np.hypot(x - 450, y - 450).min() > 10:
        s = tension_surface(x, y, z, gx, gy, 0.0, 50.0)
        assert abs(laplacian(laplacian(s, h), h)[4, 4]) < 1e-2 * max(1, abs(laplacian(s, h)[4, 4]))
    g = lambda r: green(r, 0.5)
    r, e = np.array([0.7, 1.5, 3.0]), 1e-2
    lap = lambda f, r: (f(r + e) - 2 * f(r) + f(r - e)) / e**2 + (f(r + e) - f(r - e)) / (2 * e * r)
    assert np.allclose(lap(g, r), k0(r), atol=2e-3)


def test_planes_stay_planes_and_tension_flattens():
    x, y = stations(25)
    gx, gy = np.meshgrid(np.linspace(0, 900, 10), np.linspace(0, 900, 10))
    for t in (0.0, 0.2, 0.9):
        assert np.allclose(tension_surface(x, y, x / 3 + y / 5 + 7, gx, gy, t, 50.0), gx / 3 + gy / 5 + 7, atol=1e-6)
    px, py = np.array([0.0, 100, 0, 100, 50, 400, 0, 400]), np.array([0.0, 0, 100, 100, 50, 0, 400, 400])
    z = np.array([0.0, 0, 0, 0, 1, 0, 0, 0])
    free, tight = (tension_surface(px, py, z, gx, gy, t, 50.0) for t in (0.0, 0.9))
    assert np.abs(free).max() > np.abs(tight).max() and np.allclose(tension_surface(np.append(px, 50), np.append(py, 50), np.append(z, 3.0), np.array([50.0]), np.array([50.0]), 0.2, 50.0), 2)


def planted(period=12.0, seed=3):
    x, y = stations(90, seed)
    d = np.hypot(x + 400, y + 100)
    t = d / (3.2 + 0.05 * np.sin(x / 200))
    rng = np.random.default_rng(seed)
    skips = np.where(rng.random(90) < 0.2, rng.integers(-2, 3, 90), 0)
    centre = np.hypot(x - x.mean(), y - y.mean()).argmin()
    skips[centre] = 0
    return x, y, d, t, t + period * skips


def test_cycle_skips_come_out():
    x, y, d, true, t = planted()
    times, kept = without_skips(x, y, d, t, 12.0)
    assert kept.all() and np.allclose(times, true)
    bad = t.copy()
    bad[[5, 30]] = true[[5, 30]] + 5.0  # neither right nor a whole period off
    times, kept = grown(x, y, d, bad, 12.0, (x.mean(), y.mean()), 4.0)
    assert not kept[[5, 30]].any()
    times, kept = without_skips(x, y, d, t, 30.0)
    assert np.array_equal(times, t) and 0 < kept.sum() < 90


def test_growth_equals_a_plain_loop():
    x, y, d, _, t = planted(seed=8)
    times, kept = grown(x, y, d, t, 12.0, (0.0, 0.0), 3.0)
    order = sorted(range(90), key=lambda k: (np.hypot(x[k], y[k]), k))
    own, fits = t.copy(), np.ones(90, bool)
    for n, k in enumerate(order[1:], 1):
        near = min(order[:n], key=lambda j: np.hypot(x[j] - x[k], y[j] - y[k]))
        want = d[k] * own[near] / d[near]
        while own[k] - want > 6:
            own[k] -= 12
        while want - own[k] > 6:
            own[k] += 12
        fits[k] = abs(own[k] - want) <= 3
    assert np.allclose(times, own) and np.array_equal(kept, fits)


@pytest.mark.parametrize("quadrants", [2, 4])
@pytest.mark.parametrize("mode", [1, 2, 3])
def test_neighbours_by_a_plain_loop(mode, quadrants):
    x, y = stations(25, 5)
    gx, gy = np.meshgrid(np.arange(0, 901, 150.0), np.arange(0, 901, 150.0))
    r = Rules(mode=mode, near=120.0, far=300.0, quadrants=quadrants)
    got = lonely(gx, gy, gx, x, y, x, 150.0, r)

    def around(px, py, size):
        seen = {(a >= px, b >= py) for a, b in zip(x, y, strict=True) if abs(a - px) < size and abs(b - py) < size and np.hypot(a - px, b - py) >= 1}
        return len(seen) >= quadrants

    for i, j in np.ndindex(gx.shape):
        px, py = gx[i, j], gy[i, j]
        close = np.hypot(x - px, y - py).min() < 120
        assert got[i, j] != {1: close, 2: around(px, py, 120), 3: close or around(px, py, 300)}[mode]


def test_modes_by_a_stiffer_surface():
    x, y = stations(60, 6)
    z = np.hypot(x + 300, y) / 3
    gx, gy = np.meshgrid(np.arange(0, 901, 100.0), np.arange(0, 901, 100.0))
    t = np.hypot(gx + 300, gy) / 3
    t[4, 4] += 60
    for mode, near, far in ((4, 0.05, 20.0), (5, 200.0, 20.0)):
        found = lonely(gx, gy, t, x, y, z, 100.0, Rules(mode=mode, near=near, far=far))
        assert found[4, 4] and found[3:6, 3:6].sum() == 1
    with pytest.raises(ValueError):
        lonely(gx, gy, t, x, y, z, 100.0, Rules(mode=6))


def test_reasons_of_an_even_field():
    step = 40.0
    gx, gy = np.meshgrid(np.arange(200, 1000, step), np.arange(-400, 400, step))
    x, y = np.random.default_rng(2).uniform(150, 1000, 250), np.random.default_rng(3).uniform(-450, 450, 250)
    f = field(x, y, np.hypot(x, y) / 3.0, (0.0, 0.0), 20.0, gx, gy, step, Rules(near=150.0))
    d = np.hypot(gx, gy)
    inside = (gx > 300) & (gx < 900) & (np.abs(gy) < 300)
    ok = (f["reason"] == 0) & inside
    assert ok.sum() > 0.6 * (inside & (d > 300)).sum() and np.abs(f["velocity"][ok] - 3.0).max() < 0.05 and np.abs(f["deflection"][ok]).max() < 1.5
    assert (f["reason"][d < 3.5 * 20 * 3 - 1] != 0).all() and (f["reason"][inside & (d < 200)] == 5).all()
    hole = np.hypot(x - 600, y) > 250
    lone = field(x[hole], y[hole], np.hypot(x, y)[hole] / 3.0, (0.0, 0.0), 5.0, gx, gy, step, Rules(near=60.0))
    assert (lone["reason"][np.hypot(gx - 600, gy) < 150] == 2).all()
    slow = field(x, y, np.hypot(x, y) / 1.5, (0.0, 0.0), 5.0, gx, gy, step, Rules(near=150.0))
    assert (slow["reason"][inside & (slow["reason"] != 6) & (slow["reason"] != 1)] == 3).all() and (slow["reason"][inside] == 3).any()
    spike = np.hypot(x, y) / 3.0 + np.where(np.hypot(x - 600, y) < 40, 40.0, 0)
    assert (field(x, y, spike, (0.0, 0.0), 5.0, gx, gy, step, Rules(near=150.0))["reason"][np.hypot(gx - 600, gy) < 60] == 6).any()


def test_surfaces_that_differ():
    """Where curvature takes out a field's middle, the two surfaces bridge the gap differently."""
    step = 50.0
    gx, gy = np.meshgrid(np.arange(200, 1200, step), np.arange(-500, 500, step))
    rng = np.random.default_rng(7)
    x, y = rng.uniform(150, 1200, 300), rng.uniform(-550, 550, 300)
    z = np.hypot(x, y) / 3 + 60 * np.exp(-(np.hypot(x - 700, y) ** 2) / (2 * 130**2))
    f = field(x, y, z, (0.0, 0.0), 5.0, gx, gy, step, Rules(near=200.0, smooth=0.0006, curvature=0.02))
    assert ((f["reason"] == 1) & (np.hypot(gx - 700, gy) < 400)).any()


def test_beside_and_laplacian():
    m = np.zeros((3, 4), bool)
    m[1, 1] = True
    assert travel.beside(np.array([[0, 0, 0, 0], [0, 0, 3, 0], [0, 0, 0, 0]]), m, 4).tolist() == [[0, 4, 0, 0], [4, 0, 3, 0], [0, 4, 0, 0]]
    gx, gy = np.meshgrid(np.arange(6) * 2.0, np.arange(5) * 2.0)
    assert np.allclose(laplacian(gx**2 + 3 * gy**2, 2.0), 8)


def test_fields_as_jobs(spark):
    x, y = stations(60, 11)
    rows = []
    for event, (ex, ey) in enumerate(((-400.0, 100.0), (1500.0, 800.0), (0.0, 0.0))):
        t = np.hypot(x - ex, y - ey) / 3.1
        t[event + 1 :: 13] += 10.0
        keep = 3 if event == 2 else 60
        rows += [(10.0, event, ex, ey, float(a), float(b), float(c), 5.0 + float(a) / 1000) for a, b, c in zip(x[:keep], y[:keep], t[:keep], strict=True)]
    p = spark.createDataFrame(rows, "period double, event long, ex double, ey double, x double, y double, t double, amplitude double")
    grid = (100.0, 100.0, 100.0, 8, 8)
    got = travel.travel_fields(p.drop("amplitude"), grid, Rules(near=200.0)).toPandas()
    assert set(got["event"]) == {0, 1} and len(got) == 128 and (got["corrected"] > 0).all() and (got["kept"] == 60).all()
    ok = got[got["reason"] == 0]
    assert len(ok) > 60 and np.median(np.abs(ok["velocity"] - 3.1)) < 0.02
    both = pd.concat([p.toPandas()] * 1)
    assert len(both) == 123
    c = travel.corrected_fields(p, grid, Rules(near=200.0)).toPandas()
    assert set(c["reason"]) <= {0, 1, 2, 3, 4, 5, 6, 7, 8} and np.median(np.abs(c[c["reason"] == 0]["velocity"] - 3.1)) < 0.05
    low = travel.corrected_fields(p.withColumn("amplitude", p["amplitude"] * -1), grid, Rules(near=200.0)).toPandas()
    assert (low[c["reason"].to_numpy() == 0]["reason"] == 7).all()


@pytest.mark.parametrize("source", [(-80.0, 130.0), (210.0, 333.0), (150.0, 225.0)])
@pytest.mark.parametrize("tension", [0.0, 0.2])
def test_points_filled_by_the_shared_inverse_are_those_of_the_surface(source, tension):
    gx, gy = np.meshgrid(75.0 * np.arange(9), 75.0 * np.arange(8))
    t = np.hypot(gx - source[0], gy - source[1]) / 3.2 + np.sin(gx / 90) * np.cos(gy / 70)
    for known in (np.random.default_rng(4).random(t.shape) < 0.7, np.hypot(gx - 150, gy - 225) > 200):
        px, py, pz = (np.append(v[known], c) for v, c in ((gx, source[0]), (gy, source[1]), (t, 0.0)))
        want = tension_surface(px, py, pz, gx, gy, tension, 75.0)
        got = travel.filled(t, known, source, gx, gy, tension, 75.0, lambda k: travel.inverted(gx, gy, k, 75.0))
        assert np.allclose(got, want[~known], atol=1e-7)


def test_nearest_point_before():
    x, y = stations(150, 5)
    x[40:60] = x[0:20]
    y[40:60] = y[0:20]
    want = [0] + [int(np.hypot(x[:i] - x[i], y[:i] - y[i]).argmin()) for i in range(1, 150)]
    assert travel.nearest_before(x, y).tolist() == want


def test_fields_share_a_task(spark):
    x, y = stations(60, 7)
    rows = [(period, e, 100.0 * e, 50.0, float(u), float(v), float(np.hypot(u - 100 * e, v - 50) / 3.3)) for period in (8.0, 12.0) for e in range(12) for u, v in zip(x, y, strict=True)]
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["period", "event", "ex", "ey", "x", "y", "t"]))
    grid, rules = (0.0, 0.0, 100.0, 10, 10), Rules(smooth=0.001)
    f = travel.travel_fields(p, grid, rules, parts=3)
    one = travel.travel_fields(p, grid, rules, parts=500)
    assert f.count() == 24 * 100 and f.rdd.getNumPartitions() == 3
    assert f.exceptAll(one).count() == 0


def test_corrected_fields_share_a_task(spark):
    x, y = stations(60, 9)
    rows = [(10.0, e, 100.0 * e, 50.0, float(u), float(v), float(np.hypot(u - 100 * e, v - 50) / 3.3), 5.0 + float(u) / 900) for e in range(12) for u, v in zip(x, y, strict=True)]
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["period", "event", "ex", "ey", "x", "y", "t", "amplitude"]))
    grid = (0.0, 0.0, 100.0, 10, 10)
    f, one = (travel.corrected_fields(p, grid, Rules(smooth=0.001), parts=n) for n in (2, 500))
    assert f.count() == 1200 and f.rdd.getNumPartitions() == 2 and f.exceptAll(one).count() == 0


def test_fields_of_one_network_share_the_grids_responses(monkeypatch):
    x, y = stations(40)
    gx, gy = np.meshgrid(50.0 * np.arange(8), 50.0 * np.arange(6))
    rng = np.random.default_rng(3)
    made = []
    responses = travel._responses
    monkeypatch.setattr(travel, "_responses", lambda r, tension: made.append(r.shape) or responses(r, tension))
    for room in (100, 30, 5):
        known = travel._Known(gx, gy, 50.0, 8 * 48 * room)
        made.clear()
        for _ in range(12):
            at = rng.permutation(40)[:30]
            zs = [np.sin(x[at] / 90), rng.normal(size=30)]
            both = travel.tension_surfaces(x[at], y[at], zs, gx, gy, [0.0, 0.2], 50.0, known)
            n = len(made)
            for got, z, tension in zip(both, zs, (0.0, 0.2), strict=True):
                assert np.allclose(got, tension_surface(x[at], y[at], z, gx, gy, tension, 50.0), atol=1e-9)
            del made[n:]
        # all 40 places are met in a few fields where there is room for them, and none is kept twice
        on_grid = [s for s in made if s != (30, 30)]
        assert sum(s[0] for s in on_grid) == 80 if room == 100 else len(on_grid) >= 12
