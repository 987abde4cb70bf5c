"""Stacks and statistics of fields, curves and receiver functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iteration import cut


def azimuth_weights(cells: DataFrame, keys: list[str], width: float = 20.0) -> DataFrame:
    """cells with near, the number of rows of the cell, valid or not, within width degrees of azimuth around the circle; 0 if not valid.

    Azimuths are counted per whole degree first, and sums over a circular range window run over at most 360 rows a cell,
    so the work grows with the rows and not with their square. cells has az (whole degrees, -180 to 179) and valid.
    """
    n = cells.groupBy(*keys, "az").agg(F.count("*").alias("n"))
    turned = n.select(*keys, F.explode(F.array(*(F.struct((F.col("az") + 360 * k).alias("az"), F.col("n"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)))).alias("t")).select(*keys, "t.*")
    w = Window.partitionBy(*keys).orderBy("az").rangeBetween(-int(width), int(width))
    near = turned.withColumn("near", F.sum("n").over(w)).where("own").select(*keys, "az", "near")
    return cells.join(near, [*keys, "az"]).withColumn("near", F.when(F.col("valid"), F.col("near")).otherwise(F.lit(0)))


def isotropic_stack(cells: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Mean slowness of each cell: weights 1 / near are capped at mean + 3 sigma and normalised, values beyond 2 sigma go, and the mean is taken anew.

    cells has slow and near (0: not valid). Cells of fewer than least valid rows are dropped.
    """
    # equal values are counted and kept once; what follows is a few numbers a cell, joined back: no cell's rows are gathered
    x = cut(cells.where("near > 0").groupBy(*keys, "slow", "near").agg(F.count("*").alias("k"))).withColumn("w", 1 / F.col("near"))
    all_, mean = F.sum("k"), F.sum(F.col("k") * F.col("w")) / F.sum("k")
    cap = x.groupBy(*keys).agg(all_.alias("n"), (mean + 3 * F.sqrt(F.greatest(F.sum(F.col("k") * F.col("w") * F.col("w")) / all_ - mean * mean, F.lit(0.0)))).alias("cap"), (F.sum(F.col("k") * F.col("slow")) / all_).alias("r")).where(F.col("n") >= least)
    # the weighted spread about the mean, by values less a rough one so that squares don't cancel
    y = x.join(cap, keys).select(*keys, "slow", "k", (F.col("k") * F.least("w", "cap")).alias("w"), "n", (F.col("slow") - F.col("r")).alias("z"))
    total, first = F.sum("w"), F.sum(F.col("w") * F.col("z"))
    m = y.groupBy(*keys).agg((first / total).alias("m"), F.sqrt(F.greatest(F.sum(F.col("w") * F.col("z") * F.col("z")) / total - F.pow(first / total, 2), F.lit(0.0))).alias("sd"))
    x = y.join(m, keys).where(F.abs(F.col("z") - F.col("m")) <= 2 * F.col("sd"))
    kept, middle = F.sum("k"), F.sum(F.col("k") * F.col("z")) / F.sum("k")
    std = F.sqrt(F.greatest(F.sum(F.col("k") * F.col("z") * F.col("z")) / kept - middle * middle, F.lit(0.0)))
    g = x.groupBy(*keys).agg(F.max("n").alias("n"), kept.alias("n_kept"), (F.sum(F.col("w") * F.col("slow")) / F.sum("w")).alias("slowness"), std.alias("std"))
    return g.withColumns({"velocity": 1 / F.col("slowness"), "sem": F.col("std") / F.sqrt("n_kept")})


def azimuth_fit(bins: DataFrame, keys: list[str], psi: str = "psi", value: str = "value", weight: str = "weight", least: int = 0, regular: float | None = None) -> DataFrame:
    """Weighted least squares of a0 + a * cos(2 psi) + b * sin(2 psi) by keys: normal equations as sums, solved in columns.

    psi is in degrees. Gives a0, amplitude, the fast direction (0 to 180) and the root mean square misfit; keys whose
    equations are singular (by a determinant of regular times the cubed weight, where that is given), or that have under
    least rows, are dropped.
    """
    c, s = F.cos(2 * F.radians(psi)), F.sin(2 * F.radians(psi))
    x = bins.select(*keys, F.col(value).alias("y"), F.col(weight).alias("w"), c.alias("c"), s.alias("s"))
    names = {"sw": "w", "sc": "w * c", "ss": "w * s", "scc": "w * c * c", "scs": "w * c * s", "sss": "w * s * s", "sy": "w * y", "syc": "w * y * c", "sys": "w * y * s", "syy": "w * y * y"}
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(k) for k, e in names.items()))
    g = g.withColumn("det", F.expr("sw * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss) + ss * (sc * scs - scc * ss)")).where("abs(det) > 1e-9" if regular is None else f"abs(det) > {regular!r} * sw * sw * sw").where(f"n >= {least}")
    g = g.withColumns({
        "a0": F.expr("(sy * (scc * sss - scs * scs) - sc * (syc * sss - scs * sys) + ss * (syc * scs - scc * sys)) / det"),
        "a": F.expr("(sw * (syc * sss - scs * sys) - sy * (sc * sss - scs * ss) + ss * (sc * sys - syc * ss)) / det"),
        "b": F.expr("(sw * (scc * sys - syc * scs) - sc * (sc * sys - syc * ss) + sy * (sc * scs - scc * ss)) / det"),
    })
    g = g.withColumns({"amplitude": F.hypot("a", "b"), "fast": F.pmod(F.degrees(F.atan2("b", "a")) / 2, F.lit(180.0)), "misfit": F.expr("sqrt(greatest(syy - a0 * sy - a * syc - b * sys, 0) / sw)")})
    return g.select(*keys, "n", "a0", "amplitude", "fast", "misfit")


def harmonics(baz: Column, a0: float, one: tuple[float, float] | None = None, two: tuple[float, float] | None = None) -> Column:
    """a0 + a1 * sin(baz + p1) + a2 * sin(2 * baz + p2), with (a, p) of the terms that there are; baz in degrees."""
    b = F.radians(baz)
    out = F.lit(a0)
    for k, t in ((1, one), (2, two)):
        if t:
            out = out + t[0] * F.sin(k * b + t[1])
    return out


def _three_terms(bins: DataFrame, keys: list[str], k: int, kind: str, least: int) -> DataFrame:
    """Fits of a0 + a * cos(k psi) + b * sin(k psi): normal equations as sums, solved in columns; singular ones are dropped."""
    r = k * F.radians("psi")
    x = bins.select(*keys, F.col("value").alias("y"), F.col("weight").alias("w"), F.cos(r).alias("c"), F.sin(r).alias("s"))
    names = {"sw": "w", "sc": "w * c", "ss": "w * s", "scc": "w * c * c", "scs": "w * c * s", "sss": "w * s * s", "sy": "w * y", "syc": "w * y * c", "sys": "w * y * s"}
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(c) for c, e in names.items()))
    g = g.withColumn("det", F.expr("sw * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss) + ss * (sc * scs - scc * ss)")).where(f"n >= {least} and abs(det) > 1e-6 * sw * sw * sw")
    return g.select(
        *keys, F.lit(kind).alias("kind"), "n",
        F.expr("(sy * (scc * sss - scs * scs) - sc * (syc * sss - scs * sys) + ss * (syc * scs - scc * sys)) / det as a0"),
        F.expr("(sw * (syc * sss - scs * sys) - sy * (sc * sss - scs * ss) + ss * (sc * sys - syc * ss)) / det as a"),
        F.expr("(sw * (scc * sys - syc * scs) - sc * (sc * sys - syc * ss) + sy * (sc * scs - scc * ss)) / det as b"),
    )


def harmonic_fits(bins: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, kind (A0, A0+A1, A0+A2), n, a0, a and b (cosine and sine term) of weighted fits to bins(psi, value, weight) of least values or more."""
    w = F.sum("weight")
    a0 = bins.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col("value") * F.col("weight")) / w).alias("a0")).where(F.col("n") >= least)
    a0 = a0.select(*keys, F.lit("A0").alias("kind"), "n", "a0", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return a0.unionByName(_three_terms(bins, keys, 1, "A0+A1", least)).unionByName(_three_terms(bins, keys, 2, "A0+A2", least))


def five_terms(bins: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, a0, s1, c1, s2 and c2 of fits of a constant, one- and two-lobed terms to bins(psi, value): sums by keys, then 5 by 5 systems in batches."""
    r = F.radians("psi")
    terms = [F.lit(1.0), F.sin(r), F.cos(r), F.sin(2 * r), F.cos(2 * r)]
    x = bins.select(*keys, F.col("value").alias("y"), *(t.alias(f"t{k}") for k, t in enumerate(terms)))
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)] + [F.sum(F.col(f"t{i}") * F.col("y")).alias(f"v{i}") for i in range(5)]
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least).drop("n")
    names = ["a0", "s1", "c1", "s2", "c2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack([np.stack([b[f"m{min(i, j)}{max(i, j)}"] for j in range(5)], 1) for i in range(5)], 1)
                v = np.stack([b[f"v{i}"] for i in range(5)], 1)
                yield b[keys].assign(**dict(zip(names, np.linalg.solve(m, v[:, :, None])[:, :, 0].T, strict=True)))

    kinds = dict(bins.dtypes)
    return g.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names)]))


def two_layer_anisotropy(curves: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, n, and fast direction and amplitude (percent) of two layers by weighted least squares on curves(g1, g2, dc, ds, weight)."""
    names = {"m11": "g1 * g1", "m12": "g1 * g2", "m22": "g2 * g2", "c1": "g1 * dc", "c2": "g2 * dc", "s1": "g1 * ds", "s2": "g2 * ds"}
    q = curves.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"weight * {e}")).alias(c) for c, e in names.items())).where(F.col("n") >= least)
    q = q.withColumn("det", F.expr("m11 * m22 - m12 * m12")).where("det > 1e-9")
    for t in "cs":
        q = q.withColumns({f"g{t}1": F.expr(f"(m22 * {t}1 - m12 * {t}2) / det"), f"g{t}2": F.expr(f"(m11 * {t}2 - m12 * {t}1) / det")})
    fast = lambda k: F.pmod(F.degrees(F.atan2(f"gs{k}", f"gc{k}")) / 2, F.lit(180.0)).alias(f"fast{k}")
    amp = lambda k: (F.sqrt(F.col(f"gc{k}") * F.col(f"gc{k}") + F.col(f"gs{k}") * F.col(f"gs{k}")) / 2 * 100).alias(f"amp{k}")
    return q.select(*keys, "n", fast(1), amp(1), fast(2), amp(2))


def grouped_median(counts: DataFrame, key: str, value: str) -> DataFrame:
    """key and median of counts(key, value, n), values that stand n times each, by running totals over distinct values.

    The window runs over the distinct values of a key only; its totals are of groups of values first, so that a key of
    many values is not sorted in one task: the group that holds the middle is found, then only that one is read. Groups are
    equally wide; row_median takes rows that aren't counted, and doesn't depend on how values lie.
    """
    parts = 1000
    ends = counts.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("_all"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))).otherwise(0).cast("int")
    c = counts.join(F.broadcast(ends), key).withColumn("_p", part)
    sums = c.groupBy(key, "_p").agg(F.sum("n").alias("_n"), F.first("_all").alias("_all"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_p")) - F.col("_n")
    # the two middle places, counted from 0
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    hold = sums.withColumn("_b", before).where((F.col("_b") <= high) & (low < F.col("_b") + F.col("_n"))).select(key, "_p", "_b")
    v = c.join(F.broadcast(hold), [key, "_p"])
    at = F.col("_b") + F.sum("n").over(Window.partitionBy(key, "_p").orderBy(value)) - F.col("n")
    v = v.withColumn("_at", at)
    pick = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("n")), F.col(value)))
    return v.groupBy(key).agg(((pick(low) + pick(high)) / 2).alias("median"))


#: Ranks at either side of the middle, as a share of a key's rows, that are looked at exactly; a tenth of it is the error of approximate quantiles.
_MIDDLE = 0.001


def row_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and the exact median of the values of a few keys with very many rows each; nulls don't count, a key of nulls alone has null.

    Approximate quantiles enclose the middle, rows below them are counted, and the rows between, a few thousandths however the values lie, are
    sorted as distinct values with their counts. A few numbers a key are broadcast; no key's rows are gathered.
    """
    rows = rows.select(key, F.col(value).alias("_v"))
    ends = F.percentile_approx("_v", [0.5 - _MIDDLE, 0.5 + _MIDDLE], round(10 / _MIDDLE))
    ends = rows.groupBy(key).agg(ends.alias("_e")).select(key, F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    # one row a value between the ends; one, of null, for all that is below or above
    inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
    c = rows.where("_v is not null").join(F.broadcast(ends), key).groupBy(key, inside.alias("_m")).agg(F.count("*").alias("_n"), F.count_if(F.col("_v") < F.col("_lo")).alias("_b"))
    per = c.groupBy(key).agg(F.sum("_n").alias("_all"), F.sum("_b").alias("_below"))
    v = c.where("_m is not null").select(key, F.col("_m").alias("_v"), "_n").join(F.broadcast(per), key)
    v = v.withColumn("_at", F.col("_below") + F.sum("_n").over(Window.partitionBy(key).orderBy("_v")) - F.col("_n"))
    # the two middle places, counted from 0
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    pick = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_n")), F.col("_v")))
    m = v.groupBy(key).agg(((pick(low) + pick(high)) / 2).alias("median"))
    return ends.select(key).join(F.broadcast(m), key, "left")


def grouped_mad(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and mad, the median absolute deviation from the median, of a few keys with very many rows each."""
    off = rows.join(F.broadcast(row_median(rows, key, value)), key).select(key, F.abs(F.col(value) - F.col("median")).alias("off"))
    return row_median(off, key, "off").withColumnRenamed("median", "mad")


def trimmed(rows: DataFrame, keys: list[str], value: str, deviations: float) -> DataFrame:
    """rows whose value is within so many standard deviations of its key's mean; a mean and a spread a key are joined back."""
    m = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(m, keys).where(F.abs(F.col(value) - F.col("_m")) <= deviations * F.col("_s") + 1e-9).drop("_m", "_s")


def without_cycles(rows: DataFrame, keys: list[str], value: str, distance: float) -> DataFrame:
    """rows(period, value) with whole periods taken out of the time over distance that a velocity stands for, towards the key's mean."""
    m = rows.groupBy(*keys).agg(F.avg(value).alias("_m"))
    t = distance / F.col(value)
    return rows.join(m, keys).withColumn(value, distance / (t - F.col("period") * F.round((t - distance / F.col("_m")) / F.col("period")))).drop("_m")


def cosine_terms(amplitude: Column, psi: Column, amplitude_error: Column, psi_error: Column) -> tuple[Column, Column, Column, Column]:
    """Cosine and sine terms of a 2-psi curve of an amplitude and fast direction (degrees), and their errors by propagation."""
    r, e = F.radians(psi) * 2, F.radians(psi_error) * 2
    spread = lambda f, g: F.sqrt(F.pow(f * amplitude_error, 2) + F.pow(amplitude * g * e, 2))
    return amplitude * F.cos(r), amplitude * F.sin(r), spread(F.cos(r), F.sin(r)), spread(F.sin(r), F.cos(r))


def layered_anisotropy(curves: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, n, and for two layers amplitude (per cent, peak to peak over two), fast direction and their errors, of curves(g1, g2, dc, ds, dc_error, ds_error).

    The cosine and the sine terms are two least-squares problems with weights of their own that share the layers' kernels g1 and g2; errors come from
    the inverses of their normal equations. Keys with fewer than least rows or kernels that don't tell the layers apart are dropped.
    """
    sums = {f"{a}{t}": f"{e} / (d{t}_error * d{t}_error)" for t in "cs" for a, e in (("m11", "g1 * g1"), ("m12", "g1 * g2"), ("m22", "g2 * g2"), ("y1", f"g1 * d{t}"), ("y2", f"g2 * d{t}"))}
    q = curves.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(a) for a, e in sums.items())).where(F.col("n") >= least)
    for t in "cs":
        q = q.withColumn(f"det{t}", F.expr(f"m11{t} * m22{t} - m12{t} * m12{t}")).where(f"det{t} > 1e-9 * m11{t} * m22{t}")
        q = q.withColumns({f"g{t}1": F.expr(f"(m22{t} * y1{t} - m12{t} * y2{t}) / det{t}"), f"g{t}2": F.expr(f"(m11{t} * y2{t} - m12{t} * y1{t}) / det{t}"), f"v{t}1": F.expr(f"m22{t} / det{t}"), f"v{t}2": F.expr(f"m11{t} / det{t}")})
    out = []
    for k in "12":
        c, s, vc, vs = (F.col(f"{a}{k}") for a in ("gc", "gs", "vc", "vs"))
        a = F.hypot(c, s)
        out += [(50 * a).alias(f"amp{k}"), F.pmod(F.degrees(F.atan2(s, c)) / 2, F.lit(180.0)).alias(f"fast{k}")]
        out += [(50 * F.sqrt(F.try_divide(c * c * vc + s * s * vs, a * a))).alias(f"amp_error{k}"), F.least(F.lit(90.0), F.degrees(F.sqrt(F.try_divide(s * s * vc + c * c * vs, F.pow(a, 4)))) / 2).alias(f"fast_error{k}")]
    return q.select(*keys, "n", *out)
