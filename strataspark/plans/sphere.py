"""Tomography on the sphere from the curves of station pairs: rays and Fresnel zones by cells, regularised maps, and fits to the spread of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.operators import fields, sphere
from strataspark.sources.fixtures import table

from .registry import query

#: Reference velocity in km/s, and cells of isotropic and azimuthal unknowns in degrees.
C0, CELL, COARSE = 3.5, 1.0, 2.5


def pair_residuals(spark, sf_dir: str, period: float) -> DataFrame:
    """ray, its ends and length, res and weight of each pair with a curve: travel time of its mean speed less that of C0, weights by the number of measurements.

    Speeds are C0 and a tenth of what the curve has beyond it.
    """
    c = table(spark, sf_dir, "curves").where(F.col("period") == period).groupBy("sta1", "sta2").agg(F.avg("c").cast("double").alias("c"), F.count("*").alias("n"))
    s = table(spark, sf_dir, "stations").select("sta_key", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    a, b = s.toDF("sta1", "lon1", "lat1"), s.toDF("sta2", "lon2", "lat2")
    d = sphere.geo.distance_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    p = c.join(a, "sta1").join(b, "sta2").withColumn("d", d).where("d > 0.001")
    res = F.col("d") / (C0 + (F.col("c") - 3.5) / 10) - F.col("d") / C0
    return p.select((F.col("sta1") * 10_000_000 + F.col("sta2")).cast("bigint").alias("ray"), "lon1", "lat1", "lon2", "lat2", "d", res.alias("res"), F.sqrt(F.col("n").cast("double")).alias("weight"))


def _rays(r: DataFrame) -> DataFrame:
    return r.select("ray", "lon1", "lat1", "lon2", "lat2")


_SQL_RAYS = """r as (select sta1 * 10000000 + sta2 as ray, radians(a.lon) as o1, radians(a.lat) as t1, radians(b.lon) as o2, radians(b.lat) as t2 from (select distinct sta1, sta2 from curves where period = 10) c join stations a on a.sta_key = sta1 join stations b on b.sta_key = sta2),
  v as (select ray, cos(t1) * cos(o1) as x1, cos(t1) * sin(o1) as y1, sin(t1) as z1, cos(t2) * cos(o2) as x2, cos(t2) * sin(o2) as y2, sin(t2) as z2, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin((t2 - t1) / 2), 2) + cos(t1) * cos(t2) * power(sin((o2 - o1) / 2), 2)))) as d from r),
  n as (select *, greatest(1, cast(ceil(d / 25) as int)) as n from v where d > 0.001), k as (select *, unnest(range(n)) as k from n), f as (select *, (k + 0.5) / n as share, d / n as part, d / 6371.0 as w from k)"""


@query("fresnel_density", f"""with {_SQL_RAYS}, h as (select *, 3.0 / 8 * 35 as e from f), g as (select *, cast(floor(sqrt((d + e) * (d + e) - d * d) / 2 * sqrt(greatest(0.0, 1 - power((2 * share - 1) * d / (d + e), 2))) / (6371.0 * pi() / 180 / 2)) as int) as m from h),
  o as (select *, unnest(range(-m, m + 1)) * (6371.0 * pi() / 180 / 2) / 6371.0 as o, sin((1 - share) * w) / sin(w) as a, sin(share * w) / sin(w) as b from g),
  p as (select ray, part / (2 * m + 1) as g, (a * x1 + b * x2) * cos(o) + (y1 * z2 - z1 * y2) / sin(w) * sin(o) as x, (a * y1 + b * y2) * cos(o) + (z1 * x2 - x1 * z2) / sin(w) * sin(o) as y, (a * z1 + b * z2) * cos(o) + (x1 * y2 - y1 * x2) / sin(w) * sin(o) as z from o),
  c as (select ray, cast(floor(degrees(atan2(y, x)) / 1.0 + 1e-9) as int) as cx, cast(floor(degrees(atan2(z, sqrt(x * x + y * y))) / 1.0 + 1e-9) as int) as cy, g from p)
  select cx, cy, count(distinct ray) as rays, round(sum(g), 4) as length from c group by cx, cy""")
def fresnel_density(spark, sf_dir):
    """Rays and km of them in each cell, each ray as wide as its Fresnel zone at a period of 10 s."""
    g = sphere.zone_cells(_rays(pair_residuals(spark, sf_dir, 10.0)), CELL, F.lit(C0 * 10.0))
    return g.groupBy("cx", "cy").agg(F.count("*").alias("rays"), F.round(F.sum("g"), 4).alias("length"))


@query("azimuth_terms", f"""with {_SQL_RAYS}, p as (select *, sin((1 - share) * w) / sin(w) as a, sin(share * w) / sin(w) as b from f), q as (select ray, part, degrees(atan2(a * y1 + b * y2, a * x1 + b * x2)) as lon, degrees(atan2(a * z1 + b * z2, sqrt(power(a * x1 + b * x2, 2) + power(a * y1 + b * y2, 2)))) as lat, x2, y2, z2 from p),
  e as (select *, radians(lon) as o, radians(lat) as t, atan2(y2, x2) as o2, asin(z2) as t2 from q), z as (select *, atan2(sin(o2 - o) * cos(t2), cos(t) * sin(t2) - sin(t) * cos(t2) * cos(o2 - o)) as az from e),
  u as (select ray, part, cast(floor(lon / 2.5 + 1e-9) as int) as cx, cast(floor(lat / 2.5 + 1e-9) as int) as cy, unnest([4, 5, 8, 9]) as term, unnest([cos(2 * az), sin(2 * az), cos(4 * az), sin(4 * az)]) as f from z)
  select cast(term as int) as term, cx, cy, round(sum(part * f), 3) as g from u group by all""")
def azimuth_terms(spark, sf_dir):
    """The sums over all rays of their km in coarse cells times cosine and sine of twice and four times the azimuth."""
    g = sphere.azimuth_cells(_rays(pair_residuals(spark, sf_dir, 10.0)), COARSE)
    return g.groupBy("term", "cx", "cy").agg(F.round(F.sum("g"), 3).alias("g"))


@query("regularised_tomography")
def regularised_tomography(spark, sf_dir):
    """Velocities of cells of one degree from all pairs' travel times at 10 s along great circles: smoothed over 150 km, damped where few rays go."""
    r = pair_residuals(spark, sf_dir, 10.0)
    g = sphere.ray_cells(_rays(r), CELL).withColumn("term", F.lit(0))
    x = sphere.regularised(g, r.select("ray", "res", "weight"), {0: CELL}, {0: 150.0}, 0.5, 0.2, 1e-4)
    return x.select("cx", "cy", (1 / (1 / C0 + F.col("m"))).alias("velocity"), "rays")


@query("azimuthal_tomography")
def azimuthal_tomography(spark, sf_dir):
    """Isotropic cells of one degree by Fresnel zones, with 2-psi terms on cells of 2.5 degrees by rays, at 16 s: amplitude in per cent and fast direction."""
    r = pair_residuals(spark, sf_dir, 16.0)
    iso = sphere.zone_cells(_rays(r), CELL, F.lit(C0 * 16.0)).withColumn("term", F.lit(0))
    g = iso.select("ray", "term", "cx", "cy", "g").unionByName(sphere.azimuth_cells(_rays(r), COARSE, (2,)).select("ray", "term", "cx", "cy", "g"))
    x = sphere.regularised(g, r.select("ray", "res", "weight"), {0: CELL, 4: COARSE, 5: COARSE}, {0: 150.0, 4: 300.0, 5: 300.0}, 0.5, 0.2, 1e-3)
    wide = x.where("term > 0").groupBy("cx", "cy").agg(*(F.max(F.when(F.col("term") == t, F.col("m"))).alias(n) for t, n in ((4, "c"), (5, "s"))))
    fast = F.pmod(F.degrees(F.atan2(-F.col("s"), -F.col("c"))) / 2, F.lit(180.0))
    flat = x.where("term = 0").select(F.lit(0).alias("kind"), "cx", "cy", (1 / (1 / C0 + F.col("m"))).alias("value"), F.lit(None).cast("double").alias("fast"))
    return flat.unionByName(wide.select(F.lit(2).alias("kind"), "cx", "cy", (100 * C0 * F.hypot("c", "s")).alias("value"), fast.alias("fast")))


@query("response_widths", """with m as (select ilat, ilon, avg(case when reason_n = 0 then vel else vel / 2 end) as v from cells group by all), p as (select a.ilat, a.ilon, 100.0 * sqrt(power(a.ilat - b.ilat, 2) + power(a.ilon - b.ilon, 2)) as d, b.v * exp(-(power(a.ilat - b.ilat, 2) + power(a.ilon - b.ilon, 2)) / 8.0) as m from m a join m b on abs(a.ilat - b.ilat) <= 4 and abs(a.ilon - b.ilon) <= 4),
  t as (select ilat, ilon, max(m) as top from p group by all), w as (select p.* from p join t using (ilat, ilon) where m > 0.05 * top), o as (select ilat, ilon, regr_slope(m, d) as b, regr_intercept(m, d) as a from w group by all),
  i as (select w.* from w join o using (ilat, ilon) where d <= case when b < 0 then least(2000.0, -a / b) else 2000.0 end),
  z as (select ilat, ilon, regr_slope(m, d) as b2, regr_intercept(m, d) as a2, regr_slope(ln(m), d * d) as b3 from i group by all)
  select cast(ilat as bigint) as ilat, cast(ilon as bigint) as ilon, round(case when b2 < 0 then least(2000.0, -a2 / b2) else 2000.0 end, 4) as cone, round(case when b3 < 0 then least(2000.0, sqrt(-1 / (2 * b3))) else 2000.0 end, 4) as sigma from z""")
def response_widths(spark, sf_dir):
    """Cones and Gaussians fitted to responses that fall with distance and vary with the cells' velocities; pairs of cells are joined by their keys' neighbours."""
    m = table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.avg(F.when(F.col("reason_n") == 0, F.col("vel")).otherwise(F.col("vel") / 2)).cast("double").alias("v"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-4, 5) for j in range(-4, 5))))
    p = m.select("ilat", "ilon", near.alias("n")).withColumns({"y": F.col("ilat") + F.col("n.i"), "x": F.col("ilon") + F.col("n.j")})
    p = p.join(m.select(F.col("ilat").alias("y"), F.col("ilon").alias("x"), "v"), ["y", "x"])
    off = F.col("n.i") * F.col("n.i") + F.col("n.j") * F.col("n.j")
    p = p.select(F.col("ilat").cast("bigint").alias("ilat"), F.col("ilon").cast("bigint").alias("ilon"), (100 * F.sqrt(off.cast("double"))).alias("d"), (F.col("v") * F.exp(-off / 8.0)).alias("m"))
    return sphere.response_fits(p, ["ilat", "ilon"]).select("ilat", "ilon", F.round("cone", 4).alias("cone"), F.round("sigma", 4).alias("sigma"))


@query("checkerboard", f"""with {_SQL_RAYS}, p as (select *, sin((1 - share) * w) / sin(w) as a, sin(share * w) / sin(w) as b from f), q as (select ray, part, degrees(atan2(a * y1 + b * y2, a * x1 + b * x2)) as lon, degrees(atan2(a * z1 + b * z2, sqrt(power(a * x1 + b * x2, 2) + power(a * y1 + b * y2, 2)))) as lat from p)
  select ray, round(sum(part), 4) as d, round(sum(part / (3.25 + 0.25 * sin(pi() * (lon + 165) / 5) * sin(pi() * (lat - 55) / 2.5))), 4) as t from q group by ray""")
def checkerboard(spark, sf_dir):
    """Travel times of all pairs with a curve through a checkerboard of velocities."""
    p = sphere._place(sphere._points(_rays(pair_residuals(spark, sf_dir, 10.0)), 25.0))
    v = fields.checkerboard(p, 3.25, 0.25, 5.0, 2.5, -165.0, 55.0)
    return v.groupBy("ray").agg(F.round(F.sum("part"), 4).alias("d"), F.round(F.sum(F.col("part") / F.col("v")), 4).alias("t"))


@query("two_pass_tomography")
def two_pass_tomography(spark, sf_dir):
    """Velocities at 14 s in two passes: a smooth one, without the rays that it leaves beyond two deviations a finer one; rays counts those used."""
    r = pair_residuals(spark, sf_dir, 14.0)
    g = sphere.ray_cells(_rays(r), CELL).withColumn("term", F.lit(0))
    x, _ = sphere.two_passes(g, r.select("ray", "res", "weight"), {0: CELL}, {0: 400.0}, {0: 150.0}, (2.0, 0.5), 0.2)
    return x.select("cx", "cy", (1 / (1 / C0 + F.col("m"))).alias("velocity"), "rays")
