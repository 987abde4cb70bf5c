"""Travel-time fields of one source: cycle skips by growth, splines in tension, and the reasons why a grid's points don't count.

A field is what one network recorded of one source at one period, so its size is that of a network; Spark deals the fields out.
Positions are km in a plane.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tomography import helmholtz

#: What k0(x) + ln(x) is at 0: ln 2 less Euler's constant.
_AT_ZERO = np.log(2) - np.euler_gamma
#: Points of fields that a task gets, about.
TASK_POINTS = 2000


def k0(x: np.ndarray) -> np.ndarray:
    """The modified Bessel function of the second kind of order 0, of positive numbers: by its series under 1, else by its integral of exp(-x cosh t)."""
    t = np.linspace(0, 12, 97)
    w = np.full(len(t), t[1])
    w[0] /= 2
    x = np.asarray(x, float)
    flat, out = x.ravel(), np.empty(x.size)
    near = flat < 1
    out[near] = _to_log(flat[near]) - np.log(flat[near])
    far = np.flatnonzero(~near)
    for at in range(0, len(far), 10_000):
        part = far[at : at + 10_000]
        out[part] = np.exp(-np.minimum(np.multiply.outer(flat[part], np.cosh(t)), 700)) @ w
    return out.reshape(x.shape)


def _to_log(x: np.ndarray) -> np.ndarray:
    """k0(x) + ln(x) of numbers from 0 to 1, by the series of powers of x * x / 4."""
    q, log = x * x / 4, np.log(np.maximum(x, 1e-300))
    term, out, h = np.ones_like(q), np.full_like(q, _AT_ZERO), 0.0
    for k in range(1, 12):
        h += 1 / k
        term = term * q / k**2
        out += term * (h + _AT_ZERO - log)
    return out


def green(r: np.ndarray, tension: float) -> np.ndarray:
    """The response of a thin plate under tension to a point force at distances r in units of the grid's spacing; of a free plate at tension 0."""
    if tension <= 0:
        return np.where(r > 0, r * r * (np.log(np.maximum(r, 1e-300)) - 1), 0.0)
    return _tense(r * np.sqrt(tension / (1 - tension)))


#: Up to where k0 is in a table, beyond which it is nothing, and steps of the table.
_END, _STEPS = 20.0, 1 << 17


def _tense(x: np.ndarray) -> np.ndarray:
    """k0(x) + ln(x) by lines between the places of a table, whose even steps need no search; x is overwritten."""
    value, rise = _table()
    far = x >= _END
    distant = x[far]
    x *= _STEPS / _END
    at = x.astype(np.intp)
    x -= at
    x *= rise.take(at, mode="clip")
    x += value.take(at, mode="clip")
    if len(distant):
        x[far] = np.log(distant)
    return x


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """k0(x) + ln(x) at even steps from 0 to _END, close enough that lines between are right to 1e-7, and how much it rises in a step."""
    x = np.linspace(0, _END, _STEPS + 1)
    value = np.append(_AT_ZERO, k0(x[1:]) + np.log(x[1:]))
    return value, np.diff(value)


def tension_surface(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, tension: float, spacing: float) -> np.ndarray:
    """z at (gx, gy) by a spline in tension (0 to under 1) through the points; repeated points count by their mean.

    A plane is taken off first, so what is even stays so. Tension acts over the grid's spacing.
    """
    return tension_surfaces(x, y, [z], gx, gy, [tension], spacing)[0]


def tension_surfaces(x: np.ndarray, y: np.ndarray, zs: list[np.ndarray], gx: np.ndarray, gy: np.ndarray, tensions: list[float], spacing: float, known: _Known | None = None) -> list[np.ndarray]:
    """tension_surface of several values at the same points, each in its tension; known has responses of the grid to places, where a grid has many fields."""
    at, which = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    n = np.bincount(which.ravel())
    zs = [np.bincount(which.ravel(), z) / n for z in zs]
    x, y = at.T
    ones = lambda u, v: np.stack([np.ones_like(u), (u - x.mean()) / spacing, (v - y.mean()) / spacing], -1)
    base, even = ones(x, y), ones(gx, gy)
    planes = np.linalg.lstsq(base, np.stack(zs, -1), rcond=None)[0].T
    apart = _squares(x, y, x, y, spacing)
    out = []
    for z, plane, tension in zip(zs, planes, tensions, strict=True):
        g, rest = _responses(apart.copy(), tension), z - base @ plane
        force = np.linalg.lstsq(g, rest, rcond=1e-13)[0] if len(x) < 3 else _solved(g, rest)
        rows = known.rows(x, y, tension) if known else None
        own = even @ plane
        if rows is not None:
            own = own + (force @ rows).reshape(gx.shape)
        for k in range(0, len(x) if rows is None else 0, 256):
            part = slice(k, k + 256)
            own = own + _responses(_squares(gx, gy, x[part], y[part], spacing), tension) @ force[part]
        out.append(own)
    return out


def _squares(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, spacing: float) -> np.ndarray:
    """Squares of the distances of all of (gx, gy) to all of (x, y), in units of the spacing."""
    r, v = np.subtract.outer(gx / spacing, x / spacing), np.subtract.outer(gy / spacing, y / spacing)
    r *= r
    v *= v
    r += v
    return r


def _responses(r: np.ndarray, tension: float) -> np.ndarray:
    """green at distances with squares r, in place, as most of a field's time goes here."""
    if tension > 0:
        return green(np.sqrt(r, out=r), tension)
    v = np.maximum(r, 1e-300)
    np.log(v, out=v)
    v *= 0.5
    v -= 1
    r *= v
    return r


class _Known:
    """Responses of a grid's points to the places that a task has met, as fields of one network share its places; forgotten where they get too many."""

    def __init__(self, gx: np.ndarray, gy: np.ndarray, spacing: float, size: int = 16_000_000):
        self.gx, self.gy, self.spacing = gx.ravel(), gy.ravel(), spacing
        self.most = size // (8 * gx.size)
        self.at: dict[float, dict[tuple[float, float], int]] = {}
        self.store: dict[float, np.ndarray] = {}

    def rows(self, x: np.ndarray, y: np.ndarray, tension: float) -> np.ndarray | None:
        """A row of the grid's responses for each of the places, which differ; None where they are too many to keep."""
        if len(x) > self.most:
            return None
        at = self.at.setdefault(tension, {})
        store = self.store.setdefault(tension, np.empty((self.most, self.gx.size)))
        keys = list(zip(x.tolist(), y.tolist(), strict=True))
        new = [k for k in keys if k not in at]
        if len(at) + len(new) > self.most:
            at.clear()
            new = keys
        if new:
            nx, ny = np.array(new).T
            store[len(at) : len(at) + len(new)] = _responses(_squares(nx, ny, self.gx, self.gy, self.spacing), tension)
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        return store[[at[k] for k in keys]]


def inverted(gx: np.ndarray, gy: np.ndarray, tension: float, spacing: float) -> np.ndarray:
    """The inverse of green of all points of a grid to each other."""
    x, y = gx.ravel(), gy.ravel()
    return np.linalg.inv(green(np.hypot(x[:, None] - x, y[:, None] - y) / spacing, tension))


def filled(t: np.ndarray, known: np.ndarray, source: tuple[float, float], gx: np.ndarray, gy: np.ndarray, tension: float, spacing: float, inverse: Callable[[float], np.ndarray]) -> np.ndarray:
    """tension_surface through the known points of a grid and 0 at the source, at the grid's other points.

    Of the surface through all points the forces at the others are nothing. So with the inverse of the responses of a grid's points to each other, which
    its fields share, only a system of the other points is left.
    """
    rest = ~known.ravel()
    x, y, z, q = gx.ravel(), gy.ravel(), t.ravel(), inverse(tension)
    same = (x == source[0]) & (y == source[1])
    own = green(np.hypot(x - source[0], y - source[1]) / spacing, tension)
    u = q @ own
    left = float(green(np.zeros(1), tension)[0] - own @ u)
    if abs(left) < 1e-7 and not same.any():
        px, py, pz = (np.append(v[~rest], c) for v, c in ((x, source[0]), (y, source[1]), (z, 0.0)))
        return tension_surface(px, py, pz, x[rest], y[rest], tension, spacing)
    # at a grid point the source's 0 counts with what is known there
    z = np.where(same, np.where(rest, 0.0, z / 2), z)
    r = np.flatnonzero(rest & ~same)
    k = ~rest | same
    px, py, pz = (x[k], y[k], z[k]) if same.any() else (np.append(v[k], c) for v, c in ((x, source[0]), (y, source[1]), (z, 0.0)))
    ones = lambda v, w: np.stack([np.ones_like(v), (v - px.mean()) / spacing, (w - py.mean()) / spacing], -1)
    plane = np.linalg.lstsq(ones(px, py), pz, rcond=None)[0]
    even = ones(x, y) @ plane
    z = np.where(k, z - even, 0.0)
    force, among = q[r] @ z, q[np.ix_(r, r)]
    if not same.any():
        # the inverse with the source as one more point
        among = among + np.outer(u[r], u[r]) / left
        force = force + u[r] * (u @ z + (ones(*np.array([[source[0]], [source[1]]])) @ plane)[0]) / left
    z[r] = -_solved(among, force) if len(r) else 0.0
    return (z + even)[rest]


def _solved(g: np.ndarray, z: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(g, z)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(g, z, rcond=1e-13)[0]


def thinned(x: np.ndarray, y: np.ndarray, z: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The medians of positions and values in each square of the size."""
    p = pd.DataFrame({"x": x, "y": y, "z": z, "i": np.floor(x / size), "j": np.floor(y / size)}).groupby(["i", "j"])[["x", "y", "z"]].median()
    return p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy()


def grown(x: np.ndarray, y: np.ndarray, distance: np.ndarray, t: np.ndarray, period: float, start: tuple[float, float], threshold: float, correct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Times with cycle skips taken out, and which points fit, going outwards from start.

    The time expected of a point is what its distance from the source gives at the speed of the nearest point before it. Whole periods
    are added or taken (if correct) until a time is within half a period of that; a point that is then off by over threshold doesn't fit.
    """
    order = np.argsort(np.hypot(x - start[0], y - start[1]), kind="stable")
    near = nearest_before(x[order], y[order]).tolist()
    far, pt = distance[order].tolist(), t[order].astype(float).tolist()
    fits = [True] * len(pt)
    for i in range(1, len(pt)):
        k = near[i]
        expected = far[i] * pt[k] / far[k] if far[k] > 0 else pt[i]
        off = (pt[i] - expected) / period
        if correct and 0.5 < abs(off) < math.inf:
            pt[i] -= math.copysign(period * math.ceil(abs(off) - 0.5), off)
        fits[i] = abs(pt[i] - expected) <= threshold
    times, kept = np.empty(len(t)), np.empty(len(t), bool)
    times[order], kept[order] = pt, fits
    return times, kept


def nearest_before(x: np.ndarray, y: np.ndarray, rows: int = 64) -> np.ndarray:
    """Which of the points before each one is nearest, the first of equal ones (0 for the first point); so many rows of distances are held at a time."""
    near = np.zeros(len(x), np.int64)
    for at in range(0, len(x), rows):
        end = min(at + rows, len(x))
        d = np.hypot(x[at:end, None] - x[:end], y[at:end, None] - y[:end])
        d[np.arange(end) >= np.arange(at, end)[:, None]] = np.inf
        near[at:end] = d.argmin(axis=1)
    return near


def without_skips(x: np.ndarray, y: np.ndarray, distance: np.ndarray, t: np.ndarray, period: float, threshold: float = 6.0, longest: float = 20.0, starts: int = 5, apart: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The times and fitting points of that growth which keeps most points, the first of equal ones.

    Growths start at the points' centre and at the points that are the 2nd, 4th and so on (by `apart`) from there. Fields of periods over
    `longest` are looked at without correction. A field of few points has fewer starts, one at least.
    """
    n = len(t)
    starts = max(1, n // 2 - 1) if starts * apart >= n else starts
    centre = (x.mean(), y.mean())
    order = np.argsort(np.hypot(x - centre[0], y - centre[1]), kind="stable")
    best = None
    for k in range(starts):
        at = centre if k == 0 else (x[order[min(k * apart, n - 1)]], y[order[min(k * apart, n - 1)]])
        got = grown(x, y, distance, t, period, at, threshold, period <= longest)
        if best is None or got[1].sum() > best[1].sum():
            best = got
        if best[1].all():
            break
    return best


def laplacian(z: np.ndarray, step: float) -> np.ndarray:
    """Second differences in both directions; at edges those of the next row or column."""
    out = np.zeros_like(z)
    for axis in (0, 1):
        s = np.moveaxis(z, axis, 0)
        d = np.empty_like(s)
        d[1:-1] = (s[2:] - 2 * s[1:-1] + s[:-2]) / step**2
        d[0], d[-1] = d[1], d[-2]
        out += np.moveaxis(d, 0, axis)
    return out


@dataclass(frozen=True)
class Rules:
    """What a point of a field must obey: see reasons. mode: 1 a station within near, 2 stations in `quadrants` of the four within a square of near, 3 either
    (the second with far), 4 a time within a share `near` of that of a stiffer surface (far seconds at most), 5 a station within near and a time within far of that."""

    difference: float = 2.0
    mode: int = 1
    near: float = 150.0
    far: float = 250.0
    quadrants: int = 4
    smooth: float = 0.005
    curvature: float = 0.005
    slowness: tuple[float, float] = (0.2, 0.5)
    wavelengths: float = 3.0


def lonely(gx: np.ndarray, gy: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, step: float, rules: Rules) -> np.ndarray:
    """Grid points without the neighbours that the mode asks for."""
    if not 1 <= rules.quadrants <= 4:
        raise ValueError("quadrants are one to four")
    dx, dy = x - gx[..., None], y - gy[..., None]
    d = dx * dx + dy * dy

    def surrounded(size: float, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        u, v = dx[at], dy[at]
        box = (np.abs(u) < size) & (np.abs(v) < size) & (d[at] >= 1)
        return sum((box & (east == (u >= 0)) & (north == (v >= 0))).any(-1).astype(int) for east in (True, False) for north in (True, False)) >= rules.quadrants

    close = (d < rules.near**2).any(-1)
    if rules.mode == 1:
        return ~close
    if rules.mode == 2:
        return ~surrounded(rules.near)
    if rules.mode == 3:
        alone = ~close
        alone[alone] = ~surrounded(rules.far, alone)
        return alone
    off = np.abs(t - tension_surface(*thinned(x, y, z, step), gx, gy, 0.5, step))
    if rules.mode == 4:
        return off > np.minimum(np.abs(min(rules.near, 0.5) * t), min(rules.far, 50.0))
    if rules.mode == 5:
        return ~close | (off > rules.far)
    raise ValueError("modes are one to five")


def beside(reason: np.ndarray, mark: np.ndarray, code: int) -> np.ndarray:
    """reason with code where it is 0 and one of the four neighbours is marked."""
    p = np.pad(mark, 1)
    return np.where((reason == 0) & (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]), code, reason)


def field(x: np.ndarray, y: np.ndarray, z: np.ndarray, source: tuple[float, float], period: float, gx: np.ndarray, gy: np.ndarray, step: float, rules: Rules, inverse: Callable[[float], np.ndarray] | None = None, known: _Known | None = None, also: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """t, velocity, angle, deflection, reason and curvature on a grid, of times z at (x, y) from a source.

    Reasons, the first that holds: 1 surfaces of tension 0 and 0.2 through the points whose curvature is under `smooth` differ by over `difference`; 2 lonely; 4 beside a point
    without time; 3 slowness out of bounds; 5 nearer to the source than `wavelengths` of 3.5 km/s; and before all 6, curvature. angle is that of
    propagation from north, deflection its difference from the direction away from the source (0 where 5 holds). inverse gives inverted()
    at a tension and known its responses, where a grid has many fields. also are other values at the points, whose surface of tension 0.2 is given as `also`.
    """
    inverse = inverse or (lambda tension: inverted(gx, gy, tension, step))
    t, *other = tension_surfaces(x, y, [z] if also is None else [z, also], gx, gy, [0.0] if also is None else [0.0, 0.2], step, known)
    curved = laplacian(t, step)
    even = np.abs(curved) < rules.smooth
    reason = np.zeros(t.shape, int) if even.any() else np.ones(t.shape, int)
    if even.any() and not even.all():
        # both surfaces go through the even points, so they can only differ at the others
        one, two = (filled(t, even, source, gx, gy, k, step, inverse) for k in (0.0, 0.2))
        reason[~even] = np.abs(one - two) > rules.difference
    reason = np.where((reason == 0) & lonely(gx, gy, t, x, y, z, step, rules), 2, reason)
    north, east = np.gradient(t, step)
    reason = beside(reason, t == 0, 4)
    slow = np.hypot(north, east)
    reason = np.where((reason == 0) & ((slow > rules.slowness[1]) | (slow < rules.slowness[0])), 3, reason)
    away = np.degrees(np.arctan2(gx - source[0], gy - source[1]))
    angle = np.degrees(np.arctan2(east, north))
    near = (reason == 0) & (np.hypot(gx - source[0], gy - source[1]) < 3.5 * period * rules.wavelengths)
    deflection = np.where(reason == 0, (angle - away + 180) % 360 - 180, 0.0)
    deflection = np.where(near, 0.0, deflection)
    reason = np.where(near, 5, reason)
    reason = np.where(np.abs(curved) > rules.curvature, 6, reason)
    return {"t": t, "velocity": np.where(slow > 0, 1 / np.maximum(slow, 1e-12), 0), "angle": angle, "deflection": deflection, "reason": reason, "curvature": curved, **{"also": o for o in other}}


_FIELD = "period double, event long, x double, y double, t double, velocity double, angle double, deflection double, reason int, kept int, corrected int"


def _by_field(points: DataFrame, run, schema: str, parts: int | None) -> DataFrame:
    """What run gives of each field, a dict of its columns or None; fields are dealt to `parts` groups of about TASK_POINTS points, whose rows are made together.

    A partition has 50 groups, or fewer where there are few, since small tables of heavy fields would end up in one; a task takes a tenth of a second to begin.
    """
    parts = max(1, parts or -(-points.count() // TASK_POINTS))
    names = [c.split()[0] for c in schema.split(", ")]

    def group(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["period", "event", "x", "y", "t"], ignore_index=True)
        new = np.flatnonzero(np.append(True, (p["period"].to_numpy()[1:] != p["period"].to_numpy()[:-1]) | (p["event"].to_numpy()[1:] != p["event"].to_numpy()[:-1])))
        columns = {c: p[c].to_numpy() for c in p.columns if c != "_part"}
        found = [run({c: v[a:b] for c, v in columns.items()}) for a, b in zip(new, np.append(new[1:], len(p)), strict=True)]
        found = [f for f in found if f is not None]
        if not found:
            return pd.DataFrame(columns=names)
        return pd.DataFrame({c: np.concatenate([np.broadcast_to(f[c], f["x"].shape) for f in found]) for c in names})

    part = F.pmod(F.xxhash64("period", "event"), F.lit(parts)).alias("_part")
    return points.select("*", part).repartition(min(parts, max(96, parts // 50)), "_part").groupBy("_part").applyInPandas(group, schema)


@lru_cache(maxsize=1)
def _known(grid: tuple[float, float, float, int, int]) -> _Known:
    return _Known(*_grid(grid)[:2], grid[2])


def _grid(grid: tuple[float, float, float, int, int]) -> tuple[np.ndarray, np.ndarray, Callable[[float], np.ndarray]]:
    """Positions of a grid's points, and the inverse of their responses to each other, kept by the task."""
    x0, y0, step, nx, ny = grid
    gx, gy = np.meshgrid(x0 + step * np.arange(nx), y0 + step * np.arange(ny))
    return gx, gy, lambda tension: _inverse(grid, tension)


@lru_cache(maxsize=4)
def _inverse(grid: tuple[float, float, float, int, int], tension: float) -> np.ndarray:
    return inverted(*_grid(grid)[:2], tension, grid[2])


def travel_fields(points: DataFrame, grid: tuple[float, float, float, int, int], rules: Rules = Rules(), least: int = 5, parts: int | None = None) -> DataFrame:
    """A row a grid point of each field of points(period, event, ex, ey, x, y, t) with `least` points or more after its cycle skips are out.

    ex, ey is the source's place; grid is x0, y0, spacing, columns, rows. kept and corrected count a field's points that fit and that were moved.
    parts is the number of groups that fields are dealt to; without it points are counted first.
    """
    gx, gy, inverse = _grid(grid)

    def run(p: dict[str, np.ndarray]) -> dict | None:
        x, y, t = (p[c].astype(float) for c in ("x", "y", "t"))
        source, period = (float(p["ex"][0]), float(p["ey"][0])), float(p["period"][0])
        times, kept = without_skips(x, y, np.hypot(x - source[0], y - source[1]), t, period)
        if kept.sum() < least:
            return None
        f = field(x[kept], y[kept], times[kept], source, period, gx, gy, grid[2], rules, inverse, _known(grid))
        own = {c: f[c].ravel() for c in ("t", "velocity", "angle", "deflection", "reason")}
        return {"period": period, "event": p["event"][0], "x": gx.ravel(), "y": gy.ravel(), **own, "kept": int(kept.sum()), "corrected": int((kept & (np.abs(times - t) > 1e-9)).sum())}

    return _by_field(points, run, _FIELD, parts)


_AMPLITUDE = "period double, event long, x double, y double, apparent double, velocity double, reason int"


def corrected_fields(points: DataFrame, grid: tuple[float, float, float, int, int], rules: Rules = Rules(), least: int = 5, parts: int | None = None) -> DataFrame:
    """Eikonal velocities (apparent) of points(period, event, ex, ey, x, y, t, amplitude) corrected by the amplitudes' curvature.

    reason is the eikonal one, else 7 where the amplitude's surface isn't above 0 and 8 where the corrected slowness would have a negative square.
    """
    gx, gy, inverse = _grid(grid)
    step = grid[2]

    def run(p: dict[str, np.ndarray]) -> dict | None:
        x, y, t, a = (p[c].astype(float) for c in ("x", "y", "t", "amplitude"))
        source, period = (float(p["ex"][0]), float(p["ey"][0])), float(p["period"][0])
        times, kept = without_skips(x, y, np.hypot(x - source[0], y - source[1]), t, period)
        if kept.sum() < least:
            return None
        f = field(x[kept], y[kept], times[kept], source, period, gx, gy, step, rules, inverse, _known(grid), a[kept])
        v, bad = helmholtz(np.where(f["velocity"] > 0, f["velocity"], 3.0), f["also"], period, step, step)
        reason = np.where(f["reason"] == 0, bad, f["reason"])
        return {"period": period, "event": p["event"][0], "x": gx.ravel(), "y": gy.ravel(), "apparent": f["velocity"].ravel(), "velocity": v.ravel(), "reason": reason.ravel()}

    return _by_field(points, run, _AMPLITUDE, parts)
