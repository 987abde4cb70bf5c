"""Queries on models and inversion: parameters to layers, harmonic fits, anisotropy, forward responses, and their closed forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.operators import layers, stacks
from strataspark.sources.fixtures import table

from .registry import query
from .stacking import _BAZ, _baz_bins


@query("gradient_layers", """with k as (select unnest(range(4)) as k) select grid, isample, cast(k as int) as layer, round((20 + 100 * p0) / 4, 6) as h, round(3 + 10 * p0 + (0.5 + p1) * (k + 0.5) / 4, 6) as v from ensemble cross join k where acc = 1""")
def gradient_layers(spark, sf_dir):
    """Layers of a group whose velocity grows evenly, for all accepted models."""
    e = table(spark, sf_dir, "ensemble").where("acc = 1")
    top = 3 + 10 * F.col("p0")
    x = e.select("grid", "isample", F.posexplode(layers.gradient_layers(top, top + 0.5 + F.col("p1"), 20 + 100 * F.col("p0"), 4)).alias("layer", "l"))
    return x.select("grid", "isample", "layer", F.round("l.h", 6).alias("h"), F.round("l.v", 6).alias("v"))


@query("spline_models", """with t as (select cast(unnest(range(0, 9)) as double) / 8 as t) select grid, isample, cast(round(t * 8) as int) as place, round(power(1 - t, 3) * (3.2 + 0.98712437 * p0) + 3 * t * power(1 - t, 2) * (3.4 + 0.98712437 * p1) + 3 * t * t * (1 - t) * (3.6 + 0.98712437 * p0) + power(t, 3) * (3.9 + 0.98712437 * p1), 6) as v from ensemble cross join t where acc = 1""")
def spline_models(spark, sf_dir):
    """Velocities of accepted models as sums of B-splines; with four cubic ones they are Bernstein polynomials."""
    b = layers.basis(4, 3, 9)
    e = table(spark, sf_dir, "ensemble").where("acc = 1")
    weights = [3.2 + 0.98712437 * F.col("p0"), 3.4 + 0.98712437 * F.col("p1"), 3.6 + 0.98712437 * F.col("p0"), 3.9 + 0.98712437 * F.col("p1")]
    v = F.array(*(sum((float(x) * w for x, w in zip(row, weights, strict=True)), F.lit(0.0)) for row in b))
    return e.select("grid", "isample", F.posexplode(v).alias("place", "v")).withColumn("v", F.round("v", 6))


@query("cubic_interpolation", "with x as (select unnest([0.5, 2.25, 3.75]) as x) select sta_key, x, round(elev_m / 1000 + x * (start_day / 97.313 - 2) - 0.30117 * x * x + 0.05137 * x * x * x * (sta_key % 5), 6) as y from stations cross join x")
def cubic_interpolation(spark, sf_dir):
    """Splines through nine samples of cubics, which they reproduce, for a batch of curves at once."""
    x, at = np.arange(9) / 2.0, np.array([0.5, 2.25, 3.75])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = (b["elev_m"].to_numpy() / 1000)[:, None] + x * (b["start_day"].to_numpy() / 97.313 - 2)[:, None] - 0.30117 * x**2 + 0.05137 * x**3 * (b["sta_key"].to_numpy() % 5)[:, None]
                v = layers.spline(x, y, at)
                yield pd.DataFrame({"sta_key": np.repeat(b["sta_key"].to_numpy(), len(at)), "x": np.tile(at, len(b)), "y": np.round(v.ravel(), 6)})

    s = table(spark, sf_dir, "stations").select("sta_key", F.col("elev_m").cast("double").alias("elev_m"), F.col("start_day").cast("double").alias("start_day"))
    return s.mapInPandas(run, "sta_key long, x double, y double")


@query("depth_averages", """with m as (select grid, isample, 10 + 100 * p0 as h1, 10 + 100 * p1 as h2, 3 + p0 as v1, 3.5 + p1 as v2, 4.2 as v3 from ensemble where acc = 1), z as (select unnest([15.0, 30.0]) as z)
  select grid, isample, cast(z as int) as depth, round((least(h1, z) * v1 + least(greatest(z - h1, 0), h2) * v2 + greatest(z - h1 - h2, 0) * v3) / z, 6) as v, case when z < h1 then 0 when z < h1 + h2 then 1 else 2 end as layer from m cross join z""")
def depth_averages(spark, sf_dir):
    """Mean velocity from the surface to two depths through three layers, and the layer that each depth is in."""
    e = table(spark, sf_dir, "ensemble").where("acc = 1").select("grid", "isample", (10 + 100 * F.col("p0")).alias("h1"), (10 + 100 * F.col("p1")).alias("h2"), (3 + F.col("p0")).alias("v1"), (3.5 + F.col("p1")).alias("v2"))
    x = e.withColumn("z", F.explode(F.array(F.lit(15.0), F.lit(30.0))))
    below = [F.least("h1", "z"), F.least(F.greatest(F.col("z") - F.col("h1"), F.lit(0.0)), F.col("h2")), F.greatest(F.col("z") - F.col("h1") - F.col("h2"), F.lit(0.0))]
    v = (below[0] * F.col("v1") + below[1] * F.col("v2") + below[2] * 4.2) / F.col("z")
    return x.select("grid", "isample", F.col("z").cast("int").alias("depth"), F.round(v, 6).alias("v"), F.when(F.col("z") < F.col("h1"), 0).when(F.col("z") < F.col("h1") + F.col("h2"), 1).otherwise(2).alias("layer"))


@query("grid_to_layers", """with g as (select grid, isample, 10 + 100 * p0 as h, 3 + p0 as v1, 3 + p0 + p1 as v2 from ensemble where acc = 1)
  select grid, isample, case when abs(v2 - v1) < 1e-9 then 1 else 0 end as is_layer, round((v1 + v2) / 2, 6) as v, round(h, 6) as h from g""")
def grid_to_layers(spark, sf_dir):
    """Models given at nodes as layers of the mean of each two, and whether they were layers already."""
    e = table(spark, sf_dir, "ensemble").where("acc = 1")
    nodes = F.array(F.struct(F.lit(0.0).alias("z"), (3 + F.col("p0")).alias("v")), F.struct((10 + 100 * F.col("p0")).alias("z"), (3 + F.col("p0") + F.col("p1")).alias("v")))
    tops, ends = F.filter("nodes", lambda x, k: k % 2 == 0), F.filter("nodes", lambda x, k: k % 2 == 1)
    x = e.select("grid", "isample", nodes.alias("nodes")).select("grid", "isample", F.explode(F.arrays_zip(tops.alias("a"), ends.alias("b"))).alias("l"))
    a, b = F.col("l.a"), F.col("l.b")
    return x.select("grid", "isample", (F.abs(b["v"] - a["v"]) < 1e-9).cast("int").alias("is_layer"), F.round((a["v"] + b["v"]) / 2, 6).alias("v"), F.round(b["z"] - a["z"], 6).alias("h"))


@query("layer_bounds", """with m as (select grid, 5 + 0.1 * min(p2) / 1000 as sediment, 30 + 0.05 * avg(p2) / 1000 as moho from ensemble group by grid), d as (select unnest([[0.0, 10.0], [10.0, 35.0], [35.0, 80.0], [80.0, 200.0]]) as b),
  l as (select grid, 'sediment' as part, 0.0 as top, sediment as bottom from m union all select grid, 'crust', sediment, moho from m union all select grid, 'mantle', moho, 200.0 from m)
  select grid, part, cast(b[1] as int) as top, round(least(bottom, b[2]) - greatest(top, b[1]), 6) as inside from l join d on l.top < b[2] and l.bottom > b[1]""")
def layer_bounds(spark, sf_dir):
    """How much of each part of a model lies in each depth range of the anisotropic layers."""
    m = table(spark, sf_dir, "ensemble").groupBy("grid").agg((5 + 0.1 * F.min("p2") / 1000).alias("sediment"), (30 + 0.05 * F.avg("p2") / 1000).alias("moho"))
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.alias("a"), b.alias("b"))
    l = m.select("grid", F.explode(F.array(part("sediment", F.lit(0.0), F.col("sediment")), part("crust", F.col("sediment"), F.col("moho")), part("mantle", F.col("moho"), F.lit(200.0)))).alias("l")).select("grid", "l.*")
    d = F.explode(F.array(*(F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom")) for a, b in ((0.0, 10.0), (10.0, 35.0), (35.0, 80.0), (80.0, 200.0)))))
    x = l.withColumn("d", d).where("a < d.bottom and b > d.top")
    return x.select("grid", "part", F.col("d.top").cast("int").alias("top"), F.round(F.least("b", "d.bottom") - F.greatest("a", "d.top"), 6).alias("inside"))


@query("parameter_volume", """with m as (select ilat, ilon, 25 + avg(vel) as moho, 3 + 0.05 * avg(vel) as vc, 4.2 + 0.05 * avg(vel) as vm from cells group by all), z as (select cast(unnest(range(0, 100, 10)) as double) as z)
  select ilat, ilon, cast(z as int) as depth, round(case when z <= moho then vc + (z / moho) * 0.6 else vm + 0.002 * (z - moho) end, 6) as v from m cross join z""")
def parameter_volume(spark, sf_dir):
    """A volume from maps of parameters: each column is built from its own and read at even depths."""
    m = table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.avg("vel").alias("a")).select("ilat", "ilon", (25 + F.col("a")).alias("moho"), (3 + 0.05 * F.col("a")).alias("vc"), (4.2 + 0.05 * F.col("a")).alias("vm"))
    x = m.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10))))
    z = F.col("depth").cast("double")
    return x.select("ilat", "ilon", "depth", F.round(F.when(z <= F.col("moho"), F.col("vc") + (z / F.col("moho")) * 0.6).otherwise(F.col("vm") + 0.002 * (z - F.col("moho"))), 6).alias("v"))


@query("harmonic_predictors", """select sta_key, it, cast(baz as int) as baz, round(0.02 + 0.01 * sin(radians(baz) + 0.3) + 0.005 * sin(2 * radians(baz) + 1.1), 6) as both, round(0.02 + 0.01 * sin(radians(baz) + 0.3), 6) as one, round(0.02 + 0.005 * sin(2 * radians(baz) + 1.1), 6) as two from (select distinct sta_key, it, baz from rf)""")
def harmonic_predictors(spark, sf_dir):
    """What a constant with one-lobed, two-lobed and both terms predicts at each back-azimuth."""
    x = table(spark, sf_dir, "rf").select("sta_key", "it", "baz").distinct()
    p = lambda **k: F.round(stacks.harmonics(F.col("baz"), 0.02, **k), 6)
    return x.select("sta_key", "it", F.col("baz").cast("int").alias("baz"), p(one=(0.01, 0.3), two=(0.005, 1.1)).alias("both"), p(one=(0.01, 0.3)).alias("one"), p(two=(0.005, 1.1)).alias("two"))


@query("harmonic_match", f"with {_BAZ}, p as (select sta_key, it, amp - (0.01 * sin(radians(bin * 30 + 15) + 0.3)) as d from b) select sta_key, it, round(stddev_pop(d), 6) as spread, round(sqrt(avg(d * d)), 6) as rms from p group by sta_key, it")
def harmonic_match(spark, sf_dir):
    """Spread and root mean square of what is left of binned receiver functions beside a one-lobed term."""
    b = _baz_bins(spark, sf_dir).withColumn("d", F.col("amp") - stacks.harmonics(F.col("bin") * 30 + 15, 0.0, one=(0.01, 0.3)))
    return b.groupBy("sta_key", "it").agg(F.round(F.stddev_pop("d"), 6).alias("spread"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rms"))


def _fit_sql(kind: str, k: int) -> str:
    """Solutions of the three normal equations by Cramer's rule, with terms sin and cos of k times the back-azimuth."""
    d = "(sw * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss) + ss * (sc * scs - scc * ss))"
    return f"""x{k} as (select sta_key, it, cos({k} * radians(bin * 30 + 15)) as c, sin({k} * radians(bin * 30 + 15)) as s, amp as y, 1 / (unc * unc) as w from b),
  g{k} as (select sta_key, it, count(*) as n, sum(w) as sw, sum(w * c) as sc, sum(w * s) as ss, sum(w * c * c) as scc, sum(w * c * s) as scs, sum(w * s * s) as sss, sum(w * y) as sy, sum(w * y * c) as syc, sum(w * y * s) as sys from x{k} group by sta_key, it),
  f{k} as (select sta_key, it, '{kind}' as kind, n, (sy * (scc * sss - scs * scs) - sc * (syc * sss - scs * sys) + ss * (syc * scs - scc * sys)) / {d} as a0, (sw * (syc * sss - scs * sys) - sy * (sc * sss - scs * ss) + ss * (sc * sys - syc * ss)) / {d} as a, (sw * (scc * sys - syc * scs) - sc * (sc * sys - syc * ss) + sy * (sc * scs - scc * ss)) / {d} as b from g{k} where n >= 6 and abs({d}) > 1e-6 * sw * sw * sw)"""


@query("harmonic_fits", f"""with {_BAZ}, {_fit_sql('A0+A1', 1)}, {_fit_sql('A0+A2', 2)}, u as (select sta_key, it, 'A0' as kind, count(*) as n, sum(amp / (unc * unc)) / sum(1 / (unc * unc)) as a0, 0.0 as a, 0.0 as b from b group by sta_key, it having count(*) >= 6 union all select * from f1 union all select * from f2)
  select sta_key, it, kind, n, round(a0, 5) as a0, round(a, 5) as a, round(b, 5) as b from u""")
def harmonic_fits(spark, sf_dir):
    """Weighted fits of a constant, with one-lobed and with two-lobed terms, to binned receiver functions of six bins or more."""
    b = _baz_bins(spark, sf_dir).select("sta_key", "it", (F.col("bin") * 30 + 15).alias("psi"), F.col("amp").alias("value"), (1 / (F.col("unc") * F.col("unc"))).alias("weight"))
    x = stacks.harmonic_fits(b, ["sta_key", "it"], 6)
    return x.select("sta_key", "it", "kind", "n", *(F.round(c, 5).alias(c) for c in ("a0", "a", "b")))


@query("harmonic_five", f"""with {_BAZ}, x as (select sta_key, it, radians(bin * 30 + 15) as r, amp as y from b), g as (select sta_key, it, count(*) as n, avg(y) as a0, avg(y * sin(r)) * 2 as s1, avg(y * cos(r)) * 2 as c1, avg(y * sin(2 * r)) * 2 as s2, avg(y * cos(2 * r)) * 2 as c2 from x group by sta_key, it having count(*) = 12)
  select sta_key, it, round(a0, 5) as a0, round(s1, 5) as s1, round(c1, 5) as c1, round(s2, 5) as s2, round(c2, 5) as c2 from g""")
def harmonic_five(spark, sf_dir):
    """Fits of all five terms to the receiver functions that have all twelve bins, by normal equations solved in batches."""
    b = _baz_bins(spark, sf_dir).select("sta_key", "it", (F.col("bin") * 30 + 15).alias("psi"), F.col("amp").alias("value"))
    x = stacks.five_terms(b, ["sta_key", "it"], 12)
    return x.select("sta_key", "it", *(F.round(c, 5).alias(c) for c in ("a0", "s1", "c1", "s2", "c2")))


@query("hti_inversion", """with k as (select ilat, ilon, ev % 4 as t, avg(vel - 3.5) as a, avg(cos(2 * radians(az))) as c, avg(sin(2 * radians(az))) as s, count(*) as n from cells where reason_n = 0 group by all),
  d as (select ilat, ilon, exp(-0.5 * t) as g1, 1 - exp(-0.5 * t) + 0.1 as g2, a * c as dc, a * s as ds, cast(n as double) as w from k),
  q as (select ilat, ilon, count(*) as n, sum(w * g1 * g1) as m11, sum(w * g1 * g2) as m12, sum(w * g2 * g2) as m22, sum(w * g1 * dc) as c1, sum(w * g2 * dc) as c2, sum(w * g1 * ds) as s1, sum(w * g2 * ds) as s2 from d group by all having count(*) >= 3),
  x as (select *, m11 * m22 - m12 * m12 as det from q), r as (select ilat, ilon, n, (m22 * c1 - m12 * c2) / det as gc1, (m11 * c2 - m12 * c1) / det as gc2, (m22 * s1 - m12 * s2) / det as gs1, (m11 * s2 - m12 * s1) / det as gs2 from x where det > 1e-9)
  select ilat, ilon, n, round(((degrees(atan2(gs1, gc1)) / 2) % 180 + 180) % 180, 3) as fast1, round(sqrt(gc1 * gc1 + gs1 * gs1) / 2 * 100, 5) as amp1, round(((degrees(atan2(gs2, gc2)) / 2) % 180 + 180) % 180, 3) as fast2, round(sqrt(gc2 * gc2 + gs2 * gs2) / 2 * 100, 5) as amp2 from r""")
def hti_inversion(spark, sf_dir):
    """Azimuthal anisotropy of two layers from curves of its cosine and sine terms: two weighted linear problems a point that share their kernels."""
    c = table(spark, sf_dir, "cells").where("reason_n = 0")
    k = c.groupBy("ilat", "ilon", (F.col("ev") % 4).alias("t")).agg(F.avg(F.col("vel") - 3.5).alias("a"), F.avg(F.cos(2 * F.radians("az"))).alias("c"), F.avg(F.sin(2 * F.radians("az"))).alias("s"), F.count("*").cast("double").alias("weight"))
    g = F.exp(-0.5 * F.col("t"))
    d = k.select("ilat", "ilon", g.alias("g1"), (1.1 - g).alias("g2"), (F.col("a") * F.col("c")).alias("dc"), (F.col("a") * F.col("s")).alias("ds"), "weight")
    x = stacks.two_layer_anisotropy(d, ["ilat", "ilon"], 3)
    return x.select("ilat", "ilon", "n", *(F.round(n, d).alias(n) for n, d in (("fast1", 3), ("amp1", 5), ("fast2", 3), ("amp2", 5))))


_HALF = "3 + cast(sta_key % 20 as double) / 20"


@query("rayleigh_dispersion", f"select sta_key, cast(period as int) as period, round(({_HALF}) * sqrt(2 - 2 / sqrt(3)), 5) as c from stations cross join (select unnest([10, 20, 40]) as period)")
def rayleigh_dispersion(spark, sf_dir):
    """Rayleigh-wave velocities of layers that are all alike, so that they are those of a half-space, for a model a station."""
    periods = np.array([10.0, 20.0, 40.0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for vs in b["vs"]:
                c = layers.rayleigh_velocity(np.array([8.0, 14.0, 0.0]), np.full(3, vs * np.sqrt(3)), np.full(3, vs), np.full(3, 2.8), periods)
                rows += [(vs, int(t), round(float(x), 5)) for t, x in zip(periods, c, strict=True)]
            yield pd.DataFrame(rows, columns=["vs", "period", "c"])

    s = table(spark, sf_dir, "stations").select("sta_key", (3 + (F.col("sta_key") % 20).cast("double") / 20).alias("vs"))
    # stations share models: each is solved once
    return s.join(s.select("vs").distinct().mapInPandas(run, "vs double, period int, c double"), "vs").select("sta_key", "period", "c")


@query("receiver_response", """with m as (select sta_key, 40 + sta_key % 40 as k, sqrt(1 / (3.5 * 3.5) - 0.06 * 0.06) - sqrt(1 / (6.2 * 6.2) - 0.06 * 0.06) as dt from stations)
  select sta_key, cast(k as int) as ps, round(k * 0.1 / dt, 5) as thickness, cast(round(k * (sqrt(1 / (3.5 * 3.5) - 0.06 * 0.06) + sqrt(1 / (6.2 * 6.2) - 0.06 * 0.06)) / dt) as int) as pps, round(tan(2 * asin(0.06 * 3.5)), 2) as direct from m""")
def receiver_response(spark, sf_dir):
    """Receiver functions of a crust over a mantle by propagator matrices: samples of the converted wave and of its first multiple, and the direct amplitude."""
    eta = [np.sqrt(1 / v**2 - 0.06**2) for v in (3.5, 6.2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["sta_key"]:
                h = (40 + key % 40) * 0.1 / (eta[0] - eta[1])
                rf = layers.receiver_function(np.array([h, 0.0]), np.array([6.2, 8.0]), np.array([3.5, 4.5]), np.array([2.8, 3.3]), 0.06, 0.1, 512)
                middle = int((40 + key % 40) * 2)  # between the conversion and its multiple
                rows.append((key, 15 + int(rf[15:middle].argmax()), round(h, 5), middle + int(rf[middle:].argmax()), round(float(rf[0]), 2)))
            yield pd.DataFrame(rows, columns=["sta_key", "ps", "thickness", "pps", "direct"])

    return table(spark, sf_dir, "stations").select("sta_key").mapInPandas(run, "sta_key long, ps int, thickness double, pps int, direct double")


@query("smoothest_models", "select grid, isample, acc, round(misfit, 6) as misfit, cast(row_number() over (partition by grid order by misfit, isample) as int) as place from ensemble where acc = 1 qualify place <= 5")
def smoothest_models(spark, sf_dir):
    """The five best models of each grid point, which average models are made of."""
    w = Window.partitionBy("grid").orderBy("misfit", "isample")
    e = table(spark, sf_dir, "ensemble").where("acc = 1").withColumn("place", F.row_number().over(w)).where("place <= 5")
    return e.select("grid", "isample", "acc", F.round("misfit", 6).alias("misfit"), "place")
