"""Travel-time surfaces, eikonal and ray tomography."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def biharmonic(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, damping: float = 1e-6) -> np.ndarray:
    """z at (gx, gy) by a biharmonic spline through the points (x, y, z); a small damping keeps close points solvable."""
    # a plane through the points first, so that what is even is kept exactly
    ones = lambda u, v: np.stack([np.ones_like(u), u - x.mean(), v - y.mean()], 1)
    plane = np.linalg.lstsq(ones(x, y), z, rcond=None)[0]
    z = z - ones(x, y) @ plane
    green = lambda d: np.where(d > 0, d * d * (np.log(np.maximum(d, 1e-300)) - 1), 0.0)
    scale = max(np.ptp(x), np.ptp(y), 1e-12)
    a = green(np.hypot(x[:, None] - x, y[:, None] - y) / scale)
    force = np.linalg.solve(a.T @ a + damping * np.eye(len(x)), a.T @ z)
    return green(np.hypot(gx[:, None] - x, gy[:, None] - y) / scale) @ force + ones(gx, gy) @ plane


def unwrap_cycles(dist: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, period: float) -> np.ndarray:
    """Travel times with whole periods added or taken, by distance: each to within half a period of its nearest earlier neighbour's speed."""
    order, out = np.argsort(dist, kind="stable"), t.copy()
    for n, k in enumerate(order[1:], 1):
        done = order[:n]
        near = done[np.hypot(x[done] - x[k], y[done] - y[k]).argmin()]
        expected = out[near] * dist[k] / dist[near] if dist[near] > 0 else out[k]
        out[k] -= period * np.round((out[k] - expected) / period)
    return out


def eikonal(t: np.ndarray, dx: float, dy: np.ndarray | float, lowest: float = 0.2, highest: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Apparent velocity, direction of travel in degrees from north, and reason (0 good, 3 slowness out of bounds, 4 edge) of a time surface t[lat, lon].

    dx and dy are the spacings in km along longitude (a value a row, or one) and latitude.
    """
    gy, gx = np.gradient(t)
    gx, gy = gx / np.reshape(dx, (-1, 1)), gy / dy
    slow = np.hypot(gx, gy)
    reason = np.where((slow < lowest) | (slow > highest), 3, 0)
    reason[[0, -1]], reason[:, [0, -1]] = 4, 4
    return np.where(slow > 0, 1 / np.maximum(slow, 1e-12), 0), np.degrees(np.arctan2(gx, gy)), reason


def helmholtz(velocity: np.ndarray, amplitude: np.ndarray, period: float, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """Velocity corrected by the amplitude's Laplacian, 1 / c ** 2 = 1 / v ** 2 - lap(A) / (A * w ** 2), and reason (7 bad amplitude, 8 negative)."""
    lap = np.zeros_like(amplitude)
    lap[1:-1, 1:-1] = (amplitude[1:-1, 2:] - 2 * amplitude[1:-1, 1:-1] + amplitude[1:-1, :-2]) / dx**2 + (amplitude[2:, 1:-1] - 2 * amplitude[1:-1, 1:-1] + amplitude[:-2, 1:-1]) / dy**2
    ok = amplitude > 0
    s2 = 1 / velocity**2 - np.where(ok, lap / np.where(ok, amplitude, 1), 0) * (period / (2 * np.pi)) ** 2
    return 1 / np.sqrt(np.where(s2 > 0, s2, 1 / 9)), np.where(~ok, 7, np.where(s2 <= 0, 8, 0))


def field_velocities(points: DataFrame, grid: tuple[float, float, float, float, float]) -> DataFrame:
    """Eikonal velocities of each field of points(period, event, x, y, t): a surface, its gradient and reasons, a row a cell.

    points of a field should be thinned first (block_medians), as each field is one dense system. x and y are km; grid is x0, y0, spacing and the numbers of columns and rows. A field is one source's stations at one
    period: its size is that of a network, so a task holds one at a time.
    """
    x0, y0, step, nx, ny = grid
    gx, gy = np.meshgrid(x0 + step * np.arange(int(nx)), y0 + step * np.arange(int(ny)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.groupby(["x", "y"], as_index=False).agg({"t": "mean", "period": "first", "event": "first"})
        t = biharmonic(p["x"].to_numpy(), p["y"].to_numpy(), p["t"].to_numpy(), gx.ravel(), gy.ravel()).reshape(gx.shape)
        v, angle, reason = eikonal(t, step, step)
        return pd.DataFrame({"period": p["period"].iloc[0], "event": p["event"].iloc[0], "x": gx.ravel(), "y": gy.ravel(), "velocity": v.ravel(), "angle": angle.ravel(), "reason": reason.ravel()})

    return points.groupBy("period", "event").applyInPandas(run, "period double, event long, x double, y double, velocity double, angle double, reason int")


def block_medians(points: DataFrame, size: float) -> DataFrame:
    """points(period, event, x, y, t, n) with one row for each square of size km of each field: the means of its positions and times, which keep a plane a plane; n points count for a row."""
    g = points.groupBy("period", "event", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return g.agg(mean("x"), mean("y"), mean("t")).drop("bx", "by")


def anisotropic_segments(rays: DataFrame, samples: int, cell: float) -> DataFrame:
    """ray_segments with term 0 (length), 1 and 2 (length times cosine and sine of twice the azimuth), the columns of isotropic and 2-psi unknowns; anisotropic ones usually take a coarser cell."""
    az = 2 * F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = ray_segments(rays, samples, cell).join(rays.select("ray", az.alias("a")), "ray")
    terms = F.array(F.struct(F.lit(0).alias("term"), F.lit(1.0).alias("f")), F.struct(F.lit(1).alias("term"), F.cos("a").alias("f")), F.struct(F.lit(2).alias("term"), F.sin("a").alias("f")))
    return s.select("ray", "cell_x", "cell_y", "length", F.explode(terms).alias("k")).select("ray", "cell_x", "cell_y", "k.term", (F.col("length") * F.col("k.f")).alias("length"))


def wide_segments(rays: DataFrame, samples: int, cell: float, sides: tuple[tuple[float, float], ...]) -> DataFrame:
    """ray_segments of rays of a finite width, as of a Fresnel zone: sides has offsets in km across the ray and their weights, which add up to 1.

    Rays without a length are left out.
    """
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    across = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(f).alias("f")) for o, f in sides)))
    at = rays.where(d > 0).select("ray", "x1", "y1", "x2", "y2", d.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")).withColumn("w", across)
    s = (F.col("k") + 0.5) / samples
    x = F.col("x1") + s * (F.col("x2") - F.col("x1")) - (F.col("y2") - F.col("y1")) / F.col("d") * F.col("w.o")
    y = F.col("y1") + s * (F.col("y2") - F.col("y1")) + (F.col("x2") - F.col("x1")) / F.col("d") * F.col("w.o")
    return at.groupBy("ray", F.floor(x / cell).cast("int").alias("cell_x"), F.floor(y / cell).cast("int").alias("cell_y")).agg(F.sum(F.col("d") / samples * F.col("w.f")).alias("length"))


def smoothing_rows(segments: DataFrame, weight: float) -> DataFrame:
    """A row (ray < 0) for each pair of neighbouring cells of segments that asks for their difference to be nothing: weight on one, -weight on the other."""
    c = segments.select("cell_x", "cell_y").distinct()
    near = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("cell_x") + a).alias("x"), (F.col("cell_y") + b).alias("y")) for k, (a, b) in enumerate(((1, 0), (0, 1)))))
    p = c.withColumn("n", F.explode(near)).join(c.select(F.col("cell_x").alias("_x"), F.col("cell_y").alias("_y")), (F.col("n.x") == F.col("_x")) & (F.col("n.y") == F.col("_y")))
    ray = -(((F.col("cell_x").cast("bigint") + 100_000) * 1_000_000 + F.col("cell_y") + 100_000) * 2 + F.col("n.k") + 1)
    ends = F.array(F.struct(F.col("cell_x").alias("cell_x"), F.col("cell_y").alias("cell_y"), F.lit(weight).alias("length")), F.struct(F.col("n.x").alias("cell_x"), F.col("n.y").alias("cell_y"), F.lit(-weight).alias("length")))
    return p.select(ray.alias("ray"), F.explode(ends).alias("e")).select("ray", "e.*")


def _crossed(p: pd.DataFrame, samples: int, cell: float, sides: tuple[tuple[float, float], ...] = ((0.0, 1.0),)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of p(x1, y1, x2, y2), cell_x, cell_y and length of each cell that a ray's samples are in."""
    x1, y1, x2, y2 = (p[c].to_numpy(float)[:, None, None] for c in ("x1", "y1", "x2", "y2"))
    d = np.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
    s = ((np.arange(samples) + 0.5) / samples)[:, None]
    x, y = x1 + s * (x2 - x1), y1 + s * (y2 - y1)
    offset, share = np.array([o for o, _ in sides]), np.array([f for _, f in sides])
    if offset.any():
        x, y = x - (y2 - y1) / d * offset, y + (x2 - x1) / d * offset
    cx, cy = np.floor(x / cell).astype(np.int64), np.floor(y / cell).astype(np.int64)
    part = np.broadcast_to(d / samples * share, cx.shape).ravel()
    row = np.broadcast_to(np.arange(len(p))[:, None, None], cx.shape).ravel()
    cx, cy = cx.ravel(), cy.ravel()
    low_x, low_y, n_x, n_y = cx.min(), cy.min(), np.ptp(cx) + 1, np.ptp(cy) + 1
    found, which = np.unique((row * n_x + cx - low_x) * n_y + cy - low_y, return_inverse=True)
    return found // (n_x * n_y), found // n_y % n_x + low_x, found % n_y + low_y, np.bincount(which.ravel(), part)


def _in_parts(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows].reset_index(drop=True)


def path_sums(rays: DataFrame, samples: int, cell: float, sides: tuple[tuple[float, float], ...] = ((0.0, 1.0),), by: tuple[str, ...] = ()) -> DataFrame:
    """cell_x, cell_y, by, rays and length: how many of rays(x1, y1, x2, y2, n, by) cross each cell, and their length there; n counts the rays of a row, by has whole numbers.

    ray_segments or wide_segments (with sides) summed over rays; the sums of a batch are taken where it is, so no row a ray and cell is sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _in_parts(batches):
            row, cx, cy, length = _crossed(b, samples, cell, sides)
            n = b["n"].to_numpy()[row]
            g = pd.DataFrame({"cell_x": cx, "cell_y": cy, **{c: b[c].to_numpy()[row] for c in by}, "rays": n, "length": n * length})
            yield g.groupby(["cell_x", "cell_y", *by], as_index=False).sum()

    schema = f"cell_x int, cell_y int, {''.join(f'{c} int, ' for c in by)}rays long, length double"
    ends = ("x1", "y1", "x2", "y2")
    g = rays.where("x1 <> x2 or y1 <> y2") if any(o for o, _ in sides) else rays
    return g.select(*ends, "n", *by).mapInPandas(run, schema).groupBy("cell_x", "cell_y", *by).agg(F.sum("rays").alias("rays"), F.sum("length").alias("length"))


def normal_sums(rays: DataFrame, samples: int, cell: float, terms: tuple[str, ...] = ()) -> DataFrame:
    """cell_x, cell_y, term, other_x, other_y, other_term, g: the normal matrix of ray_segments of rays(x1, y1, x2, y2, n, terms), its sums over rays of products of two unknowns' factors.

    Unknowns are cells, with a term for each column of terms, by which a ray's length counts; without terms there is term 0. For many rays through few cells: its
    size follows the cells, whatever the number of rays, of which n count for a row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _in_parts(batches):
            row, cx, cy, length = _crossed(b, samples, cell)
            cells, which = np.unique(np.column_stack([cx, cy]), axis=0, return_inverse=True)
            which, k = which.ravel(), max(1, len(terms))
            total = np.zeros((len(cells) * k,) * 2)
            step = max(1, 4_000_000 // len(total))
            for at in range(0, len(b), step):
                mine = (row >= at) & (row < at + step)
                m = min(step, len(b) - at)
                a = np.zeros((m, len(cells), k))
                for t in range(k):
                    a[row[mine] - at, which[mine], t] = length[mine] * (b[terms[t]].to_numpy()[row[mine]] if terms else 1.0)
                a = a.reshape(m, -1)
                total += a.T @ (a * b["n"].to_numpy()[at : at + m, None])
            i, j = np.nonzero(total)
            i_cell, j_cell = cells[i // k], cells[j // k]
            yield pd.DataFrame({"cell_x": i_cell[:, 0], "cell_y": i_cell[:, 1], "term": i % k, "other_x": j_cell[:, 0], "other_y": j_cell[:, 1], "other_term": j % k, "g": total[i, j]})

    keys = ["cell_x", "cell_y", "term", "other_x", "other_y", "other_term"]
    return rays.select("x1", "y1", "x2", "y2", "n", *terms).mapInPandas(run, ", ".join(f"{c} int" for c in keys) + ", g double").groupBy(*keys).agg(F.sum("g").alias("g"))


def applied(normal: DataFrame, model: DataFrame) -> DataFrame:
    """cell_x, cell_y, term and g, the product of a normal matrix and model(cell_x, cell_y, term, p)."""
    p = model.select(F.col("cell_x").alias("other_x"), F.col("cell_y").alias("other_y"), F.col("term").alias("other_term"), "p")
    return normal.join(p, ["other_x", "other_y", "other_term"]).groupBy("cell_x", "cell_y", "term").agg(F.sum(F.col("g") * F.col("p")).alias("g"))


def smoothing_sums(normal: DataFrame, weight: float) -> DataFrame:
    """normal with differences of neighbouring cells held down by weight: the squares of smoothing_rows added."""
    r = smoothing_rows(normal, weight)
    o = r.select("ray", F.col("cell_x").alias("other_x"), F.col("cell_y").alias("other_y"), F.col("length").alias("other"))
    more = r.join(o, "ray").select("cell_x", "cell_y", F.lit(0).alias("term"), "other_x", "other_y", F.lit(0).alias("other_term"), (F.col("length") * F.col("other")).alias("g"))
    return normal.unionByName(more).groupBy(*normal.columns[:-1]).agg(F.sum("g").alias("g"))


def invert_normal(normal: DataFrame, right: DataFrame, damping: float, rounds: int = 15) -> DataFrame:
    """cell_x, cell_y, term, m: invert_rays by a normal matrix (normal_sums) and its right side (cell_x, cell_y, term, g)."""
    keys = ["cell_x", "cell_y", "term"]
    return _descent(right, lambda p: applied(normal, p), damping, rounds, keys)


def smoothed(segments: DataFrame, residuals: DataFrame, damping: float, weight: float, rounds: int) -> DataFrame:
    """invert_rays with differences of neighbouring cells held down by weight."""
    rows = segments.unionByName(smoothing_rows(segments, weight))
    every = rows.select("ray").distinct().join(residuals, "ray", "left").fillna({"res": 0.0})
    return invert_rays(rows, every, damping, rounds)


def resolution(segments: DataFrame, cell: float, damping: float, rounds: int = 12) -> DataFrame:
    """resolution_by_normal of the rays of segments."""
    o = segments.select("ray", F.col("cell_x").alias("other_x"), F.col("cell_y").alias("other_y"), F.col("length").alias("other"))
    normal = segments.join(o, "ray").groupBy("cell_x", "cell_y", "other_x", "other_y").agg(F.sum(F.col("length") * F.col("other")).alias("g"))
    return resolution_by_normal(normal, cell, damping, rounds)


def resolution_by_normal(normal: DataFrame, cell: float, damping: float, rounds: int = 12) -> DataFrame:
    """cell_x, cell_y, cone, sigma and response of each cell: how far a change in one cell spreads over the map, by the normal matrix (cell_x, cell_y, other_x, other_y, g) of the rays.

    The columns of the resolution matrix, one for each cell l, are the models that a change of 1 in l gives back. They are
    found together by conjugate gradients over joins, with steps of their own, so no task and not the driver holds the
    matrix; its size is the square of the cells' number. From the responses of over a fifth of the largest: cone is the
    radius of a cone, sigma that of a Gaussian, with the same mean and mean square distance; response is the largest.
    """
    from strataspark.operators.iteration import cut

    keys, own = ["cell_x", "cell_y"], ["lx", "ly"]
    normal = cut(normal)
    x = cut(normal.select(F.col("other_x").alias("lx"), F.col("other_y").alias("ly"), *keys, F.lit(0.0).alias("m"), F.col("g").alias("r"), F.col("g").alias("p")))
    for _ in range(rounds):
        ap = normal.join(x.select(*own, F.col("cell_x").alias("other_x"), F.col("cell_y").alias("other_y"), "p"), ["other_x", "other_y"]).groupBy(*own, *keys).agg(F.sum(F.col("g") * F.col("p")).alias("g"))
        # a column grows to cells that its direction reaches for the first time
        x = cut(ap.join(x, [*own, *keys], "left").fillna(0.0, ["m", "r", "p"]).withColumn("ap", F.col("g") + damping * F.col("p")).drop("g"))
        step = x.groupBy(*own).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("ap")).alias("pap"))
        x = x.join(step, own).withColumn("alpha", F.when(F.col("pap") > 0, F.col("rr") / F.col("pap")).otherwise(0.0))
        x = cut(x.withColumns({"m": F.col("m") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("ap")}))
        now = x.groupBy(*own).agg(F.sum(F.col("r") * F.col("r")).alias("now"))
        x = cut(x.join(now, own).withColumn("p", F.col("r") + F.when(F.col("rr") > 0, F.col("now") / F.col("rr")).otherwise(0.0) * F.col("p")).select(*own, *keys, "m", "r", "p"))
    top = x.groupBy(*own).agg(F.max(F.abs("m")).alias("response"))
    d = cell * F.hypot(F.col("cell_x") - F.col("lx"), F.col("cell_y") - F.col("ly"))
    w = x.join(top, own).withColumn("w", F.abs("m")).where("w > 0.2 * response").withColumn("d", d)
    total = F.sum("w")
    clipped = lambda c, low: F.least(F.greatest(c, F.lit(low)), F.lit(2000.0))
    g = w.groupBy(*own).agg(clipped(2 * F.sum(F.col("w") * F.col("d")) / total, 0.0).alias("cone"), clipped(F.sqrt(F.sum(F.col("w") * F.col("d") * F.col("d")) / (2 * total)), cell / 2).alias("sigma"), F.max("response").alias("response"))
    return g.select(F.col("lx").alias("cell_x"), F.col("ly").alias("cell_y"), "cone", "sigma", "response")


def ray_segments(rays: DataFrame, samples: int, cell: float) -> DataFrame:
    """ray, cell_x, cell_y and length in each cell of rays(ray, x1, y1, x2, y2): points along each ray, counted by cell."""
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = rays.select("ray", "x1", "y1", "x2", "y2", (d / samples).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    s = (F.col("k") + 0.5) / samples
    x, y = F.col("x1") + s * (F.col("x2") - F.col("x1")), F.col("y1") + s * (F.col("y2") - F.col("y1"))
    return at.groupBy("ray", F.floor(x / cell).cast("int").alias("cell_x"), F.floor(y / cell).cast("int").alias("cell_y")).agg(F.sum("step").alias("length"))


def invert_rays(segments: DataFrame, residuals: DataFrame, damping: float, rounds: int = 15, keys: list[str] | None = None) -> DataFrame:
    """keys (cell_x, cell_y), m: the damped least-squares slowness change for residuals(ray, res), by conjugate gradients on DataFrames.

    Every product with the path matrix is a join and a sum, so neither the matrix nor the model is held by one task; what
    reaches the driver is two scalars a round. Rounds end when the gradient is a millionth of the first.
    """
    keys = keys or ["cell_x", "cell_y"]
    back = lambda r: segments.join(r, "ray").groupBy(*keys).agg(F.sum(F.col("length") * F.col("res")).alias("g"))
    return _descent(back(residuals), lambda p: back(segments.join(p, keys).groupBy("ray").agg(F.sum(F.col("length") * F.col("p")).alias("res"))), damping, rounds, keys)


def _descent(right: DataFrame, product, damping: float, rounds: int, keys: list[str]) -> DataFrame:
    """keys, m by conjugate gradients from right(keys, g); product gives keys and g of (keys, p)."""
    from strataspark.operators.iteration import cut

    state = cut(right.select(*keys, F.lit(0.0).alias("m"), F.col("g").alias("r"), F.col("g").alias("p")))
    rr = first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if rr <= 1e-12 * first:
            break
        x = cut(state.join(product(state.select(*keys, "p")), keys).withColumn("ap", F.col("g") + damping * F.col("p")).drop("g"))
        alpha = rr / x.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        x = x.withColumns({"m": F.col("m") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ap")})
        now = x.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = cut(x.withColumn("p", F.col("r") + (now / rr) * F.col("p")).drop("ap"))
        rr = now
    return state.select(*keys, "m")
