"""Queries on search ranges and priors of models with transverse isotropy, request windows around P, and dispersion of interferograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions.geo import distance_km, sql_distance
from strataspark.operators import pairs
from strataspark.sources.fixtures import table

from .registry import query


@query("transverse_models", """with m as (select grid, isample, 3 + 10 * p0 as vsv, 100 * (p1 - 0.04) * 2.5 as gamma from ensemble where acc = 1)
  select grid, isample, round(vsv * (1 + gamma / 200) / (1 - gamma / 200), 6) as vsh, case when abs(gamma) <= 20 and vsv <= 4.9 then 1 else 0 end as allowed, round(sqrt((2 * vsv * vsv + power(vsv * (1 + gamma / 200) / (1 - gamma / 200), 2)) / 3), 6) as mean_vs from m""")
def transverse_models(spark, sf_dir):
    """Horizontally polarised velocities from an anisotropy in percent, its prior (20 % and 4.9 km/s at most), and the mean velocity."""
    m = table(spark, sf_dir, "ensemble").where("acc = 1").select("grid", "isample", (3 + 10 * F.col("p0")).alias("vsv"), (100 * (F.col("p1") - 0.04) * 2.5).alias("gamma"))
    vsh = F.col("vsv") * (1 + F.col("gamma") / 200) / (1 - F.col("gamma") / 200)
    ok = (F.abs("gamma") <= 20) & (F.col("vsv") <= 4.9)
    return m.select("grid", "isample", F.round(vsh, 6).alias("vsh"), ok.cast("int").alias("allowed"), F.round(F.sqrt((2 * F.col("vsv") * F.col("vsv") + F.pow(vsh, 2)) / 3), 6).alias("mean_vs"))


@query("search_ranges", """with m as (select grid, min(p0) as a, avg(p1) as b, count(*) as n from ensemble group by grid), k as (select grid, 0 as part, 2.5 + a as v from m union all select grid, 1, 3.4 + b from m union all select grid, 2, 4.4 + b from m)
  select grid, part, round(case when part = 0 then v - 1 else 0.8 * v end, 6) as low, round(case when part = 0 then v + 1 else least(1.2 * v, 4.9) end, 6) as high, 0.05 as step from k""")
def search_ranges(spark, sf_dir):
    """Ranges of a search around a model: 1 km/s in sediments, 20 % elsewhere, 4.9 km/s at most."""
    m = table(spark, sf_dir, "ensemble").groupBy("grid").agg(F.min("p0").alias("a"), F.avg("p1").alias("b"))
    k = m.select("grid", F.posexplode(F.array(2.5 + F.col("a"), 3.4 + F.col("b"), 4.4 + F.col("b"))).alias("part", "v"))
    sediment = F.col("part") == 0
    return k.select("grid", "part", F.round(F.when(sediment, F.col("v") - 1).otherwise(0.8 * F.col("v")), 6).alias("low"), F.round(F.when(sediment, F.col("v") + 1).otherwise(F.least(1.2 * F.col("v"), F.lit(4.9))), 6).alias("high"), F.lit(0.05).alias("step"))


@query("p_windows", f"""with e as (select *, datediff('day', date '1992-01-01', cast(otime as date)) % 1000 as day from catalog), x as (select evid, staid, {sql_distance('evlo', 'evla', 'lon', 'lat')} / 111.12 as delta, evdp from e join stations on day between start_day and end_day),
  t as (select evid, delta, 60 + 12.4 * delta - 0.045 * delta * delta - evdp / 9 as p from x where delta between 30 and 90)
  select evid, count(*) as n, round(min(p) - 20, 4) as first, round(max(p) + 30, 4) as last from t group by evid""")
def p_windows(spark, sf_dir):
    """Windows around the P wave of each event at stations from 30 to 90 degrees away, by a travel-time curve: their number, first begin and last end."""
    x = pairs.event_distances(table(spark, sf_dir, "catalog"), table(spark, sf_dir, "stations"), 111.12, (30.0, 90.0), ("evdp",))

    def p(d):
        delta = F.col(d) / 111.12
        return 60 + 12.4 * delta - 0.045 * delta * delta - F.col("evdp") / 9

    # the curve grows up to 137 degrees, so the first wave is that of the nearest station
    return x.groupBy("evid").agg(F.sum("n").alias("n"), F.round(F.min(p("near")) - 20, 4).alias("first"), F.round(F.max(p("far")) + 30, 4).alias("last"))


@query("interferogram_distances", f"""with s as (select sta_key, lon, lat from stations), p as (select a.sta_key as sta1, a.sta_key + 1 as sta2, a.sta_key + 2 as source, {sql_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} as d0, {sql_distance('a.lon', 'a.lat', 'c.lon', 'c.lat')} as d1, {sql_distance('b.lon', 'b.lat', 'c.lon', 'c.lat')} as d2
  from s a join s b on b.sta_key = a.sta_key + 1 join s c on c.sta_key = a.sta_key + 2), k as (select *, d0 - abs(d1 - d2) as hyper, d1 + d2 - d0 as detour from p)
  select sta1, sta2, source, round(d0 + case when detour < hyper then detour else -hyper end, 5) as distance, case when detour < hyper then -2 else 0 end as quarter_turns, case when detour < hyper then 0 else 1 end as symmetrised from k""")
def interferogram_distances(spark, sf_dir):
    """The distance that an interferogram's dispersion is measured over, its phase in quarters of a half turn, and whether its two sides are averaged first."""
    s = table(spark, sf_dir, "stations").select("sta_key", "lon", "lat")
    at = lambda k: s.select((F.col("sta_key") - k).alias("sta1"), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"))
    p = at(0).join(at(1), "sta1").join(at(2), "sta1")
    d = lambda a, b: distance_km(F.col(f"lon{a}"), F.col(f"lat{a}"), F.col(f"lon{b}"), F.col(f"lat{b}"))
    k = p.select("sta1", d(0, 1).alias("d0"), d(0, 2).alias("d1"), d(1, 2).alias("d2")).withColumns({"hyper": F.col("d0") - F.abs(F.col("d1") - F.col("d2")), "detour": F.col("d1") + F.col("d2") - F.col("d0")})
    ell = F.col("detour") < F.col("hyper")
    return k.select("sta1", (F.col("sta1") + 1).alias("sta2"), (F.col("sta1") + 2).alias("source"), F.round(F.col("d0") + F.when(ell, F.col("detour")).otherwise(-F.col("hyper")), 5).alias("distance"), F.when(ell, -2).otherwise(0).alias("quarter_turns"), F.when(ell, 0).otherwise(1).alias("symmetrised"))


@query("weighted_ray_density", """with s as (select sta_key, (lon + 165) * 55 as x, (lat - 55) * 111 as y from stations), r as (select a.sta_key * 10000000 + b.sta_key as ray, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from s a join s b on a.sta_key < b.sta_key),
  p as (select ray, x1 + (k + 0.5) / 32 * (x2 - x1) as x, y1 + (k + 0.5) / 32 * (y2 - y1) as y, -(y2 - y1) as nx, x2 - x1 as ny, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) as l from r cross join (select unnest(range(32)) as k) where x1 <> x2 or y1 <> y2),
  w as (select ray, l / 32 * f as part, cast(floor((x + nx / l * o) / 100) as int) as cell_x, cast(floor((y + ny / l * o) / 100) as int) as cell_y from p cross join (select unnest([-60.0, 0.0, 60.0]) as o, unnest([0.25, 0.5, 0.25]) as f))
  select cell_x, cell_y, count(distinct ray) as rays, round(sum(part), 3) as length from w group by all""")
def weighted_ray_density(spark, sf_dir):
    """Lengths of wide rays in cells: samples on both sides of each ray, at the width of its zone, count by a weight that falls off."""
    from strataspark.operators import tomography

    from .kernels import rays

    g = tomography.path_sums(rays(spark, sf_dir), 32, 100.0, ((-60.0, 0.25), (0.0, 0.5), (60.0, 0.25)))
    return g.withColumn("length", F.round("length", 3))
