"""Surface waves of the ensemble's models: dispersion, eigenfunctions and sensitivities in batches, and predictions for all models by first-order change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.operators import modes, stacks
from strataspark.sources.fixtures import table

from .registry import query

PERIODS = np.array([10.0, 20.0, 40.0])
#: Models that a task computes at a time.
BATCH = 64
#: Of an accepted model of the ensemble: crustal thickness, vertical shear velocities of crust and mantle, and their radial anisotropy in per cent.
_MODEL = "20 + p2 / 5000 as h, 3.2 + 4 * p0 as vs1, 4.3 + 3 * p1 as vs2, 100 * p1 - 4 as g1, 60 * p0 as g2"
#: The best accepted model of each grid point, with horizontal velocities.
_BEST_SQL = f"""best as (select grid, {_MODEL} from ensemble where acc = 1 qualify row_number() over (partition by grid order by misfit, isample) = 1),
  sheared as (select *, vs1 * (1 + g1 / 200) / (1 - g1 / 200) as vh1, vs2 * (1 + g2 / 200) / (1 - g2 / 200) as vh2 from best)"""


def best_models(spark, sf_dir: str) -> DataFrame:
    """The accepted model with the least misfit of each grid point, of equal ones the first sample."""
    w = Window.partitionBy("grid").orderBy("misfit", "isample")
    e = table(spark, sf_dir, "ensemble").where("acc = 1").withColumn("place", F.row_number().over(w)).where("place = 1")
    return e.selectExpr("grid", *(x.strip() for x in _MODEL.split(",")))


def _horizontal(v: np.ndarray, g: np.ndarray) -> np.ndarray:
    return v * (1 + g / 200) / (1 - g / 200)


def crust_over_mantle(b: pd.DataFrame, layers: int = 1) -> modes.Model:
    """A crust over a mantle, whose crust is cut into equal layers; vp is 1.75 times the mean of both shear velocities, density is fixed."""
    one = np.ones((len(b), layers))
    vsv = np.column_stack([one * b["vs1"].to_numpy()[:, None], b["vs2"]])
    vsh = np.column_stack([one * _horizontal(b["vs1"], b["g1"]).to_numpy()[:, None], _horizontal(b["vs2"], b["g2"])])
    h = np.column_stack([one * b["h"].to_numpy()[:, None] / layers, np.zeros(len(b))])
    rho = np.broadcast_to(np.array([2.8] * layers + [3.35]), vsv.shape)
    vp = 1.75 * (vsv + vsh) / 2
    return modes.Model(h, vp, vp, vsv, vsh, np.ones_like(vsv), rho)


def model_modes(models: DataFrame, wave: str, columns: tuple[str, ...], by_layer: bool, spherical: bool = False, layers: int = 1) -> DataFrame:
    """grid, period and the named results of modes.modes for models(grid, h, vs1, vs2, g1, g2); with a row a layer if by_layer."""
    schema = "grid bigint, period int" + (", layer int, depth double" if by_layer else "") + "".join(f", {c} double" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                b = whole.iloc[at : at + BATCH]
                m = crust_over_mantle(b, layers)
                found = modes.modes(m, PERIODS, wave, spherical)
                shape = found["c"].shape + ((m.h.shape[1],) if by_layer else ())
                grid = [np.broadcast_to(x, shape).ravel() for x in np.meshgrid(b["grid"].to_numpy(), PERIODS.astype(np.int32), *([np.arange(shape[2], dtype=np.int32)] if by_layer else []), indexing="ij")]
                full = lambda x, shape=shape: np.broadcast_to(x[..., None] if by_layer and x.ndim == 2 else x, shape).ravel()
                out = {"grid": grid[0], "period": grid[1]}
                if by_layer:
                    out |= {"layer": grid[2], "depth": np.broadcast_to(found["depth"][:, None, :], shape).ravel()}
                yield pd.DataFrame(out | {c: full(found[c]) for c in columns})

    return models.mapInPandas(run, schema)


#: One anisotropic layer over a half-space in closed form: the root by halving, then the integrals of its eigenfunction.
def _love_sql(flat: str) -> str:
    return f"""recursive {_BEST_SQL}, f as (select grid, {flat} from sheared), t as (select *, unnest([10, 20, 40]) as period from f),
  m as (select *, 2 * pi() / period as w, r1 * v1 * v1 as l1, r1 * x1 * x1 as n1, r2 * v2 * v2 as l2, r2 * x2 * x2 as n2 from t),
  lim as (select *, sqrt(n1 / r1) as lo, least(x2, case when r1 > l1 * power(pi() / (2 * hh * w), 2) then sqrt(n1 / (r1 - l1 * power(pi() / (2 * hh * w), 2))) else x2 end) as hi from m),
  cut as (select 0 as k, grid, period, lo, hi from lim where lo < x2
    union all select k + 1, c.grid, c.period, case when below then c.mid else c.lo end, case when below then c.hi else c.mid end from (
      select cut.k, cut.grid, cut.period, cut.lo, cut.hi, (cut.lo + cut.hi) / 2 as mid, l1 * q * sin(q * hh) < l2 * g * cos(q * hh) as below from cut join lim using (grid, period)
        cross join lateral (select w * sqrt(greatest(r1 - n1 / power((cut.lo + cut.hi) / 2, 2), 0) / l1) as q, w * sqrt(greatest(n2 / power((cut.lo + cut.hi) / 2, 2) - r2, 0) / l2) as g) y) c where k < 60),
  r as (select grid, period, (lo + hi) / 2 as c from cut where k = 60),
  i as (select m.*, c, w / c as kk, w * sqrt((r1 - n1 / (c * c)) / l1) as q, w * sqrt((n2 / (c * c) - r2) / l2) as g from m join r using (grid, period)),
  j as (select *, hh / 2 + sin(2 * q * hh) / (4 * q) as s1, power(cos(q * hh), 2) / (2 * g) as s2, q * q * (hh / 2 - sin(2 * q * hh) / (4 * q)) as d1, power(cos(q * hh), 2) * g / 2 as d2 from i),
  e as (select *, kk * (n1 * s1 + n2 * s2) as d, (r1 * s1 + r2 * s2) / 2 as e1 from j)"""


_FLAT = "h as hh, vs1 as v1, vs2 as v2, vh1 as x1, vh2 as x2, 2.8 as r1, 3.35 as r2, 0 as more"
#: On a sphere of radius 6371: layers that stand for it, and what the square of the wavenumber has more.
_ROUND = """6371 * ln(6371 / (6371 - h)) as hh, vs1 * 12742 / (12742 - h) as v1, vs2 * 6371 / (6371 - h) as v2, vh1 * 12742 / (12742 - h) as x1, vh2 * 6371 / (6371 - h) as x2,
  2.8 * power(12742 / (12742 - h), -5) as r1, 3.35 * power(6371 / (6371 - h), -5) as r2, 2.25 as more"""


@query("love_sensitivities", f"""with {_love_sql(_FLAT)}, a as (select grid, period, unnest([0, 1]) as layer, unnest([0, h]) as depth, c, d / (2 * w * e1) as u, unnest([v1, v2]) as v, unnest([x1, x2]) as x, unnest([r1, r2]) as rho,
    c / (2 * kk * d) as s, kk, w, unnest([s1, s2]) as si, unnest([d1, d2]) as di from (select e.*, hh as h from e))
  select grid, cast(period as int) as period, cast(layer as int) as layer, round(depth, 5) as depth, round(c, 6) as c, round(u, 6) as u, round(2 * rho * v * s * di, 6) as dc_vsv, round(2 * rho * x * s * kk * kk * si, 6) as dc_vsh,
    round(s * (v * v * di + x * x * kk * kk * si - w * w * si), 6) as dc_rho from a""")
def love_sensitivities(spark, sf_dir):
    """Love waves of the best model of each grid point: phase and group velocity, and the derivatives by both shear velocities and density of each layer."""
    x = model_modes(best_models(spark, sf_dir), "love", ("c", "u", "dc_vsv", "dc_vsh", "dc_rho"), True).where("c = c")
    return x.select("grid", "period", "layer", F.round("depth", 5).alias("depth"), *(F.round(c, 6).alias(c) for c in ("c", "u", "dc_vsv", "dc_vsh", "dc_rho")))


@query("love_dispersion", f"""with {_love_sql(_ROUND)} select grid, cast(period as int) as period, round(c / sqrt(1 + more / power(kk * 6371, 2)), 6) as c, round(d / (2 * w * e1) * sqrt(1 + more / power(kk * 6371, 2)), 6) as u from e""")
def love_dispersion(spark, sf_dir):
    """Phase and group velocities of Love waves on a sphere, for the best model of each grid point."""
    x = model_modes(best_models(spark, sf_dir), "love", ("c", "u"), False, spherical=True).where("c = c")
    return x.select("grid", "period", F.round("c", 6).alias("c"), F.round("u", 6).alias("u"))


def predicted(kernels: DataFrame, reference: DataFrame, models: DataFrame, parameters: dict[str, str], most: float = 0.1) -> DataFrame:
    """grid, isample, period, c, far: velocities of all models by first-order change from their grid point's reference.

    kernels has grid, period, c and a column of derivatives for each name in parameters, which maps it to a parameter of
    reference and models(grid, isample, ...); far tells whether a parameter differs from the reference's by more than `most` of it.
    Kernels are computed once a grid point; models are joined with them, so their number adds only to the join.
    """
    own = reference.select("grid", *(F.col(p).alias(f"{p}_") for p in parameters.values())).join(kernels, "grid")
    # a parameter of the ensemble may stand for several derivatives: they are summed
    change = sum(((F.col(p) - F.col(f"{p}_")) * F.col(d) for d, p in parameters.items()), F.lit(0.0))
    far = F.greatest(*(F.abs(F.col(p) - F.col(f"{p}_")) / F.abs(F.col(f"{p}_")) for p in set(parameters.values()))) > most
    return models.join(own, "grid").select("grid", "isample", "period", (F.col("c") + change).alias("c"), far.alias("far"))


_HORIZONTAL = {1: "vs1 * (1 + g1 / 200) / (1 - g1 / 200)", 2: "vs2 * (1 + g2 / 200) / (1 - g2 / 200)"}


@query("predicted_love", f"""with {_love_sql(_FLAT)}, k as (select *, c / (2 * kk * d) as s from e),
  a as (select grid, isample, {_MODEL} from ensemble where acc = 1), b as (select *, {_HORIZONTAL[1]} as vh1, {_HORIZONTAL[2]} as vh2 from a),
  p as (select b.grid, isample, period, c + 2 * s * (r1 * v1 * d1 * (vs1 - v1) + r1 * x1 * kk * kk * s1 * (vh1 - x1) + r2 * v2 * d2 * (vs2 - v2) + r2 * x2 * kk * kk * s2 * (vh2 - x2)) as c,
    greatest(abs(vs1 - v1) / v1, abs(vs2 - v2) / v2, abs(vh1 - x1) / x1, abs(vh2 - x2) / x2) > 0.1 as far from b join k on b.grid = k.grid)
  select grid, isample, cast(period as int) as period, round(c, 5) as c, far from p""")
def predicted_love(spark, sf_dir):
    """Love waves of every accepted model, by first-order change of four shear velocities from the best model of its grid point."""
    best = best_models(spark, sf_dir)
    k = model_modes(best, "love", ("c", "dc_vsv", "dc_vsh"), True).where("c = c")
    at = lambda c, n: F.max(F.when(F.col("layer") == n, F.col(c))).alias(f"{c}{n + 1}")
    wide = k.groupBy("grid", "period").agg(F.max("c").alias("c"), *(at(c, n) for c in ("dc_vsv", "dc_vsh") for n in (0, 1)))
    more = lambda d: d.withColumn("vh1", F.expr(_HORIZONTAL[1])).withColumn("vh2", F.expr(_HORIZONTAL[2]))
    every = table(spark, sf_dir, "ensemble").where("acc = 1").selectExpr("grid", "isample", *(x.strip() for x in _MODEL.split(",")))
    x = predicted(wide, more(best), more(every), {"dc_vsv1": "vs1", "dc_vsh1": "vh1", "dc_vsv2": "vs2", "dc_vsh2": "vh2"})
    return x.withColumn("c", F.round("c", 5))


@query("rayleigh_sensitivities")
def rayleigh_sensitivities(spark, sf_dir):
    """Rayleigh waves of the best model of each grid point, its crust in four layers: velocities, motions at the layers' tops and derivatives of phase velocity by depth.

    Tests hold the derivatives to differences of velocities, and the velocities to a published model.
    """
    names = ("c", "u", "ur", "uz", *(f"dc_{p}" for p in modes.KERNELS if p != "vsh"))
    return model_modes(best_models(spark, sf_dir), "rayleigh", names, True, layers=4)


@query("spherical_dispersion")
def spherical_dispersion(spark, sf_dir):
    """Phase and group velocities of Rayleigh waves on a sphere, for the best model of each grid point, its crust in four layers."""
    return model_modes(best_models(spark, sf_dir), "rayleigh", ("c", "u"), False, spherical=True, layers=4)


@query("hti_profile")
def hti_profile(spark, sf_dir):
    """Azimuthal anisotropy of crust and mantle at each grid point: 2-psi terms of its cells' velocities, by the kernels of its best model's Rayleigh waves.

    Amplitudes and directions, with errors of the means, are turned to cosine and sine terms with errors; cells are of three periods by their row.
    """
    k = model_modes(best_models(spark, sf_dir), "rayleigh", ("share",), True, layers=4).where("share = share")
    g = k.groupBy("grid", "period").agg(F.sum(F.when(F.col("layer") < 4, F.col("share"))).alias("g1"), F.sum(F.when(F.col("layer") == 4, F.col("share"))).alias("g2"))
    c = table(spark, sf_dir, "cells").where("reason_n = 0").select(F.col("ev").cast("bigint").alias("grid"), F.array(*map(F.lit, (10, 20, 40)))[F.col("ilat") % 3].alias("period"), F.radians(F.col("az") * 2).alias("r"), (F.col("vel") - 3.5).cast("double").alias("v"))
    t = c.groupBy("grid", "period").agg(F.count("*").alias("m"), (2 * F.avg(F.col("v") * F.cos("r"))).alias("a"), (2 * F.avg(F.col("v") * F.sin("r"))).alias("b"), F.stddev_pop("v").alias("sd")).where("m >= 10 and sd > 0")
    amp, error = F.hypot("a", "b"), F.col("sd") * F.sqrt(2 / F.col("m"))
    psi, psi_error = F.degrees(F.atan2("b", "a")) / 2, F.least(F.lit(90.0), F.degrees(error / F.greatest(amp, F.lit(1e-12))) / 2)
    terms = stacks.cosine_terms(amp, psi, error, psi_error)
    d = t.select("grid", "period", *(x.alias(n) for x, n in zip(terms, ("dc", "ds", "dc_error", "ds_error"), strict=True)))
    return stacks.layered_anisotropy(g.join(d, ["grid", "period"]), ["grid"], 3)
