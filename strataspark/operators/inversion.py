"""Layered models: forward dispersion of Love waves, priors, and Metropolis chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def love_velocity(h: np.ndarray, vs: np.ndarray, rho: np.ndarray, periods: np.ndarray, step: float = 0.01) -> np.ndarray:
    """Fundamental Love-wave phase velocities of flat layers over a half-space (the last layer); NaN where there is none.

    The lowest root of the SH propagator's surface traction is bracketed on a grid of velocities, then on a finer one, and interpolated.
    """
    mu = rho * vs**2

    def traction(c: np.ndarray, w: float) -> np.ndarray:
        k = w / c
        g = np.sqrt(np.maximum(k**2 - (w / vs[-1]) ** 2, 1e-18))
        u, t = np.ones_like(c), -mu[-1] * g  # decay below; carried upwards through the layers
        for n in range(len(vs) - 2, -1, -1):
            q2 = (w / vs[n]) ** 2 - k**2
            q = np.sqrt(np.abs(q2)) + 1e-12
            cos, sin = np.where(q2 >= 0, np.cos(q * h[n]), np.cosh(np.minimum(q * h[n], 50))), np.where(q2 >= 0, np.sin(q * h[n]), np.sinh(np.minimum(q * h[n], 50)))
            u, t = cos * u - sin / (mu[n] * q) * t, np.where(q2 >= 0, 1, -1) * mu[n] * q * sin * u + cos * t
            big = np.maximum(np.abs(u), np.abs(t))
            u, t = u / big, t / big
        return t

    out = np.full(len(periods), np.nan)
    grid = np.append(np.arange(vs[:-1].min() + 1e-6, vs[-1], step), vs[-1] - 1e-9)
    for i, period in enumerate(periods):
        w = 2 * np.pi / period
        f = traction(grid, w)
        at = np.flatnonzero(f[:-1] * f[1:] < 0)
        if len(at):
            fine = np.linspace(grid[at[0]], grid[at[0] + 1], 65)
            g = traction(fine, w)
            k = int(np.flatnonzero(g[:-1] * g[1:] <= 0)[0])
            out[i] = fine[k] - g[k] * (fine[k + 1] - fine[k]) / (g[k + 1] - g[k] or 1)
    return out


def prior_ok(vs: np.ndarray, crust: int, most: float = 4.9, crust_most: float = 4.3, mantle: tuple[float, float] = (4.0, 4.6)):
    """Velocity rises through the crust and at its base, nothing is above most, the last crustal layer and the mantle's top are in bounds.

    vs has a velocity a layer, or (layers, models) of them, for which there is an answer a model.
    """
    if getattr(vs, "ndim", 1) == 2:
        return (vs[:crust] < vs[1 : crust + 1]).all(axis=0) & (vs <= most).all(axis=0) & (vs[crust - 1] <= crust_most) & (mantle[0] <= vs[crust]) & (vs[crust] <= mantle[1])
    v = vs if isinstance(vs, list) else np.asarray(vs).tolist()  # plain numbers are faster than arrays of a few
    return all(a < b for a, b in zip(v[:crust], v[1 : crust + 1], strict=True)) and all(a <= most for a in v) and v[crust - 1] <= crust_most and mantle[0] <= v[crust] <= mantle[1]


def likelihood(predicted: np.ndarray, observed: np.ndarray, sigma: np.ndarray) -> tuple[float, float]:
    """Misfit and likelihood; sums of squares over 50 count by their root, predictions that fail as a misfit of 9999."""
    if np.isnan(predicted).any():
        return 9999.0, 0.0
    s = float((((observed - predicted) / sigma) ** 2).sum())
    return float(np.sqrt(s / len(observed))), float(np.exp(-0.5 * (s if s <= 50 else np.sqrt(50 * s))))


def love_velocities(h: np.ndarray, vs: np.ndarray, rho: np.ndarray, periods: np.ndarray, steps: int = 96) -> np.ndarray:
    """love_velocity for the models in the rows of h and vs at once (models by periods): roots are bracketed on steps of each model's own range of velocities.

    Where velocities rise with depth, brackets are found by halves (see reached), else by looking at all steps.
    """
    rising = (np.diff(vs, axis=1) > 0).all(axis=1)
    if not rising.all():
        out = np.empty((len(vs), len(periods)))
        if rising.any():
            out[rising] = love_velocities(h[rising], vs[rising], rho, periods, steps)
        out[~rising] = _love_scanned(h[~rising], vs[~rising], rho, periods, steps)
        return out
    return _love_halved(h, vs, rho, periods, steps)


def reached(h: np.ndarray, vs: np.ndarray, mu: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the lowest root is at c (models, periods) or below, for velocities that rise with depth.

    Displacement and traction, scaled, turn from the half-space upwards by q h in a layer (or stay between its axes), from an angle under 0; the traction is
    nothing where the angle is 0. It grows with c, so the first root is where it gets there before the surface.
    """
    k = w / c
    u, t = np.ones_like(c), -mu[:, -1, None] * np.sqrt(np.maximum(k**2 - (w / vs[:, -1, None]) ** 2, 1e-18))
    found = np.zeros(c.shape, bool)
    for n in range(vs.shape[1] - 2, -1, -1):
        q2 = (w / vs[:, n, None]) ** 2 - k**2
        real = q2 >= 0
        q = np.sqrt(np.abs(q2)) + 1e-12
        qh, m = q * h[:, n, None], mu[:, n, None] * q
        found |= real & (np.arctan2(t / m, u) + qh >= 0)
        if n:
            grow = np.exp(np.minimum(qh, 50))
            cos, sin = np.where(real, np.cos(qh), (grow + 1 / grow) / 2), np.where(real, np.sin(qh), (grow - 1 / grow) / 2)
            u, t = cos * u - sin / m * t, np.where(real, 1, -1) * m * sin * u + cos * t
            big = np.maximum(np.abs(u), np.abs(t))
            u, t = u / big, t / big
    return found


def _love_halved(h: np.ndarray, vs: np.ndarray, rho: np.ndarray, periods: np.ndarray, steps: int) -> np.ndarray:
    mu, w = rho * vs**2, 2 * np.pi / periods
    low, high = (vs[:, :-1].min(axis=1) + 1e-6)[:, None], (vs[:, -1] - 1e-9)[:, None]

    def halved(at, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The last of n places before the root, and whether the last place is beyond it."""
        a, b = np.zeros((len(vs), len(w)), int), np.full((len(vs), len(w)), n - 1)
        beyond = reached(h, vs, mu, w, at(b))
        for _ in range((n - 2).bit_length()):
            mid = (a + b) // 2
            over = reached(h, vs, mu, w, at(mid))
            a, b = np.where(over, a, mid), np.where(over, mid, b)
        return np.minimum(a, n - 2), beyond

    share, part = np.linspace(0, 1, steps), np.linspace(0, 1, 17)
    coarse = lambda i: low + (high - low) * share[i]
    k, any_ = halved(coarse, steps)
    a, b = coarse(k), coarse(k + 1)
    fine = lambda i: a + (b - a) * part[i]
    k, _ = halved(fine, 17)
    a, b = fine(k), fine(k + 1)
    f = _love_traction(h, vs, mu, w, np.stack([a, b], -1))
    fa, fb = f[..., 0], f[..., 1]
    step = np.where(fb != fa, fb - fa, 1)
    return np.where(any_ & (high > low), a - fa * (b - a) / step, np.nan)


def _love_traction(h: np.ndarray, vs: np.ndarray, mu: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The traction at the surface of velocities c (models, periods, places)."""
    k = w[:, None] / c
    at = lambda x, n: x[:, n, None, None]
    g = np.sqrt(np.maximum(k**2 - (w[:, None] / at(vs, -1)) ** 2, 1e-18))
    u, t = np.ones_like(c), -at(mu, -1) * g
    for n in range(vs.shape[1] - 2, -1, -1):
        q2 = (w[:, None] / at(vs, n)) ** 2 - k**2
        real = q2 >= 0
        q = np.sqrt(np.abs(q2)) + 1e-12
        qh = q * at(h, n)
        grow = np.exp(np.minimum(qh, 50))
        cos, sin = np.where(real, np.cos(qh), (grow + 1 / grow) / 2), np.where(real, np.sin(qh), (grow - 1 / grow) / 2)
        m = at(mu, n) * q
        u, t = cos * u - sin / m * t, np.where(real, 1, -1) * m * sin * u + cos * t
        big = np.maximum(np.abs(u), np.abs(t))
        u, t = u / big, t / big
    return t


def _love_scanned(h: np.ndarray, vs: np.ndarray, rho: np.ndarray, periods: np.ndarray, steps: int) -> np.ndarray:
    mu = rho * vs**2
    w = 2 * np.pi / periods

    traction = lambda c: _love_traction(h, vs, mu, w, c)

    def first(c: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place before the first change of sign of each model and period, and whether there is one."""
        change = f[..., :-1] * f[..., 1:] <= 0
        return change.argmax(axis=-1)[..., None], change.any(axis=-1)

    low, high = vs[:, :-1].min(axis=1) + 1e-6, vs[:, -1] - 1e-9
    share = np.linspace(0, 1, steps)
    c = np.broadcast_to((low[:, None] + (high - low)[:, None] * share)[:, None, :], (len(vs), len(periods), steps))
    k, any_ = first(c, traction(c))
    a, b = np.take_along_axis(c, k, -1), np.take_along_axis(c, k + 1, -1)
    fine = a + (b - a) * np.linspace(0, 1, 17)
    f = traction(fine)
    k, _ = first(fine, f)
    a, b, fa, fb = (np.take_along_axis(x, i, -1)[..., 0] for x, i in ((fine, k), (fine, k + 1), (f, k), (f, k + 1)))
    step = np.where(fb != fa, fb - fa, 1)
    return np.where(any_ & (high > low)[:, None], a - fa * (b - a) / step, np.nan)


def turned(h: np.ndarray, z: np.ndarray, mu: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of displacement and traction at the surface (see reached) for squared wave numbers k2, and where it got to 0 below the first layer.

    h and mu have a row a layer, z the squares of frequency over velocity, for velocities that rise with depth and a wave faster than the first layer's. The angle grows with
    the wave's velocity and is 0 at the lowest root; where it got to 0 before, it means nothing. Below it is between -90 degrees and 0, so its tangent is enough.
    """
    over = np.zeros(k2.shape, bool)
    # minus the tangent, times the layer's m
    y = mu[-1] * np.sqrt(np.maximum(k2 - z[-1], 1e-18))
    for n in range(len(z) - 2, -1, -1):
        q2 = z[n] - k2
        q = np.sqrt(np.abs(q2)) + 1e-12
        qh, m = q * h[n], mu[n] * q
        y = y / m
        if n == 0:
            return qh - np.arctan(y), over
        real = q2 >= 0
        # tan, or minus tanh
        t = np.where(real, np.tan(qh), 2 / (np.exp(2 * np.minimum(qh, 50)) + 1) - 1)
        y1 = (y - t) / (1 + np.where(real, y, -y) * t)
        over |= real & ((y1 <= 0) | (qh >= np.pi / 2))
        y = y1 * m


class LoveRoots:
    """love_velocities of chains that go in step: from its last root and slope each chain's next roots are found by secants, a few looks each.

    Called with h and vs (models, layers), rows in the same order each time. Where secants don't end or velocities don't rise with depth, love_velocities
    is asked. A chain's roots don't depend on which chains go with it.
    """

    def __init__(self, rho: np.ndarray, periods: np.ndarray, looks: int = 15, close: float = 1e-7):
        self.rho, self.periods, self.looks, self.close = rho, periods, looks, close
        self.c = self.slope = None

    def __call__(self, h: np.ndarray, vs: np.ndarray) -> np.ndarray:
        w, h_, v = (2 * np.pi / self.periods)[:, None], np.ascontiguousarray(h.T), np.ascontiguousarray(vs.T)
        mu, z = self.rho[:, None] * v**2, (w / v[:, None]) ** 2
        with np.errstate(all="ignore"):
            if self.c is None:
                self.c = love_velocities(h, vs, self.rho, self.periods).T
                f, g = (turned(h_, z, mu, (w / x) ** 2)[0] for x in (self.c, self.c - 1e-5))
                self.slope = (f - g) / 1e-5
                return self.c.T
            low, high = np.broadcast_to(v[:-1].min(axis=0) + 1e-6, self.c.shape), np.broadcast_to(v[-1] - 1e-9, self.c.shape)
            root = np.minimum(np.maximum(self.c, low), high)
            slope, a, fa, off = np.where(self.slope > 0, self.slope, 1.0), root, 0.0, True
            left, own, model, b, s = np.ones(root.shape, bool), None, (h_, z, mu, w), root, slope
            for k in range(self.looks):
                h_, z, mu, w = model
                fb, over = turned(h_, z, mu, (w / b) ** 2)
                # the root lies between low and high
                above = over | (fb > 0)
                low, high = np.where(above, low, b), np.where(above, b, high)
                moved = np.abs(b - a)
                s = np.where(off | over | (moved < 1e-9), s, (fb - fa) / (b - a))
                y = b - fb / s
                y = np.where((y >= low) & (y <= high) & ~over, y, (low + high) / 2)
                # a secant's error is about the product of both before
                go = over | ~(np.abs(y - b) * np.maximum(moved, 1e-4) < self.close) if k else True
                if own is None:
                    root, slope = np.where(left, y, root), np.where(left, s, slope)
                    left &= go
                    a, fa, b, s, off = b, fb, root, slope, over
                    # all three times, then those that are left
                    if k == 2:
                        own = i, j = np.nonzero(left)
                        model = h_[:, j], z[:, i, j], mu[:, j], w[i, 0]
                        low, high, a, fa, b, s, off = (x[own] for x in (low, high, a, fa, b, s, off))
                else:
                    root[own], slope[own] = y, s
                    own = own[0][go], own[1][go]
                    model = h_[:, go], z[:, go], mu[:, go], w[go]
                    low, high, a, fa, b, s, off = (x[go] for x in (low, high, b, fb, y, s, over))
                if own is not None and not len(own[0]):
                    break
            again = ~(np.isfinite(root) & (slope > 0)).all(axis=0) | ~(vs[:, 1:] > vs[:, :-1]).all(axis=1)
            again[own[1]] = True
        if again.any():
            root[:, again] = love_velocities(h[again], vs[again], self.rho, self.periods).T
        self.c, self.slope = root, slope
        return root.T


#: Steps whose normal numbers a chain draws at once.
DRAWN = 128


def sample_chains(seeds: list[int], steps: int, start: np.ndarray, sigma: np.ndarray, low: np.ndarray, high: np.ndarray, forward, observed: np.ndarray, spread: np.ndarray, valid) -> np.ndarray:
    """Metropolis chains that go in step, one for each seed: an array of chains by steps of accepted (1 or -1), misfit, likelihood and parameters.

    Gaussian steps within bounds are redrawn until valid, 5000 times at most, then drawn evenly within the bounds; better
    models are taken, worse ones by the ratio of likelihoods. start and observed have a row a chain; forward takes the models
    of all chains, valid takes (parameters, models). A chain's numbers come from its own seed, so they don't depend on which chains go with it.
    """
    n, size = len(seeds), start.shape[1]
    rngs = [np.random.default_rng(s) for s in seeds]
    others = [np.random.default_rng([s, 2]) for s in seeds]
    # a number for every step, taken or not, so that each step uses up alike
    chances = np.stack([rng.random(steps) for rng in others])
    ahead, place = np.empty((n, DRAWN, size)), np.full(n, DRAWN)
    low, high = np.asarray(low, float), np.asarray(high, float)
    now, out = start.copy(), np.empty((n, steps, 3 + size))
    every = np.arange(n)

    def judged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore"):
            s = (((observed - forward(x)) / spread) ** 2).sum(axis=1)
        bad = np.isnan(s)
        s = np.where(bad, 0, s)
        return np.where(bad, 9999.0, np.sqrt(s / observed.shape[1])), np.where(bad, 0.0, np.exp(-0.5 * np.where(s <= 50, s, np.sqrt(50 * s))))

    def drawn() -> np.ndarray:
        new, left = None, every
        for _ in range(5000):
            at = place[left]
            if at.max() == DRAWN:
                for i in left[at == DRAWN]:
                    ahead[i], place[i] = rngs[i].standard_normal((DRAWN, size)), 0
                at = place[left]
            x = now[left] + sigma * ahead[left, at]
            place[left] = at + 1
            bad = np.flatnonzero(~(((x >= low) & (x <= high)).all(axis=1) & valid(x.T)))
            if new is None:
                new = x
            else:
                new[left] = x
            if not len(bad):
                return new
            left = left[bad]
        for i in left:
            new[i] = others[i].uniform(low, high)
        return new

    misfit, like = judged(now)
    out[:, 0] = np.column_stack([np.ones(n), misfit, like, now])
    for k in range(1, steps):
        new = drawn()
        m, lk = judged(new)
        taken = (lk >= like) | (chances[:, k] < lk / np.where(like > 0, like, 1)) | (like <= 0)
        out[:, k, 0], out[:, k, 1], out[:, k, 2], out[:, k, 3:] = np.where(taken, 1, -1), m, lk, new
        now, like = np.where(taken[:, None], new, now), np.where(taken, lk, like)
    return out


#: Chains that go in step.
TOGETHER = 512


def run_chains(tasks: DataFrame, steps: int, periods: tuple[float, ...]) -> DataFrame:
    """Chains of tasks(grid, chain, curve array<double>): Love-wave inversion for two layers over a half-space.

    Chain 0 begins at a standard model, the others at one drawn within the bounds. A chain's seed is its key, so a task that
    runs again gives the same samples.
    """
    t = np.array(periods)
    base, sigma, low, high = np.array([15.0, 3.0, 3.6, 4.4]), np.array([0.8, 0.05, 0.05, 0.05]), np.array([5.0, 2.2, 3.0, 4.0]), np.array([30.0, 3.6, 4.2, 4.6])
    rho = np.array([2.6, 2.8, 3.3])
    valid = lambda p: prior_ok(p[1:], 2)

    def begin(seed: int, chain: int) -> np.ndarray:
        rng = np.random.default_rng([seed, 1])
        x = base
        while chain and not valid(x := rng.uniform(low, high)):
            pass
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.iloc[at : at + TOGETHER]
                seeds = [int(g) * 1000 + int(c) for g, c in zip(part["grid"], part["chain"], strict=True)]
                start = np.stack([begin(s, int(c)) for s, c in zip(seeds, part["chain"], strict=True)])
                roots = LoveRoots(rho, t)
                forward = lambda p, roots=roots: roots(np.column_stack([p[:, 0], np.full(len(p), 20.0), np.zeros(len(p))]), p[:, 1:])
                out = sample_chains(seeds, steps, start, sigma, low, high, forward, np.stack(part["curve"].to_list()), np.full(len(t), 0.05), valid)
                # some chains at a time, as columns of all would hold the samples once more
                for k in range(0, len(part), 64):
                    flat, keys = out[k : k + 64].reshape(-1, out.shape[2]), part.iloc[k : k + 64]
                    yield pd.DataFrame({"grid": np.repeat(keys["grid"].to_numpy(), steps), "chain": np.repeat(keys["chain"].to_numpy(), steps), "step": np.tile(np.arange(steps), len(keys)), "accepted": flat[:, 0].astype(int), "misfit": flat[:, 1], "likelihood": flat[:, 2], **{f"p{k}": flat[:, 3 + k] for k in range(4)}})

    # a number of parts of its own, since small tables of heavy rows would end up in one
    return tasks.repartition(max(1, -(-tasks.count() // TOGETHER)), "grid", "chain").mapInPandas(run, "grid long, chain long, step long, accepted int, misfit double, likelihood double, p0 double, p1 double, p2 double, p3 double")
