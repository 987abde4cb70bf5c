"""Masks and maps, records shifted, rotated and checked, and tables by function."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import geo, tables
from strataspark.operators import arrays, fields, lookup, masks
from strataspark.sources.fixtures import table

from .registry import query

_NEAR = "(select unnest([0, 0, -1, 1]) as i, unnest([-1, 1, 0, 0]) as j)"


def _ring(k: int, least: int) -> str:
    return f"m{k + 1} as (select m{k}.ilat, m{k}.ilon, masked or coalesce(n, 0) >= {least} as masked from m{k} left join (select ilat + i as ilat, ilon + j as ilon, count(*) as n from m{k} cross join {_NEAR} where masked group by all) using (ilat, ilon))"


@query("trimmed_mask", f"""with c as (select ev % 5 as period, ilat, ilon, count(*) filter (where reason_n = 0) as n from cells group by all), b as (select *, n < 0.85 * avg(n) over () as bad from c),
  m0 as (select ilat, ilon, bool_or(bad) as masked from b group by all), {_ring(0, 4)}, {_ring(1, 1)} select cast(ilat as bigint) as ilat, cast(ilon as bigint) as ilon, masked from m2""")
def trimmed_mask(spark, sf_dir):
    """Cells with too few measurements at any period, without holes, and one ring of neighbours more."""
    c = table(spark, sf_dir, "cells").groupBy((F.col("ev") % 5).alias("period"), "ilat", "ilon").agg(F.count_if(F.col("reason_n") == 0).alias("n"))
    low = c.agg((0.85 * F.avg("n")).alias("low"))
    return masks.combined_mask(c.join(F.broadcast(low)).withColumn("bad", F.col("n") < F.col("low")), 1).select(F.col("ilat").cast("bigint").alias("ilat"), F.col("ilon").cast("bigint").alias("ilon"), "masked")


@query("overwritten_map", """with g as (select cast(ilon as double) - 5 as lon, cast(ilat as double) as lat, avg(vel) as v from cells group by ilat, ilon), r as (select (cast(ilon as double) + 355) % 360 + 0.01 * (ilat % 10) as lon, cast(ilat as double) as lat, avg(case when az > 0 then vel end) as v from cells where reason_n = 0 group by ilat, ilon),
  h as (select g.lon, g.lat, r.v from g join r on abs((g.lon + 360) % 360 - r.lon) < 0.05 and abs(g.lat - r.lat) < 0.05 and abs(g.v - r.v) < 0.03)
  select g.lon, g.lat, round(coalesce(h.v, g.v), 6) as v, h.v is not null as changed from g left join h on g.lon = h.lon and g.lat = h.lat""")
def overwritten_map(spark, sf_dir):
    """A map with the values of a regional one where that has a node close by and doesn't differ too much."""
    c = table(spark, sf_dir, "cells")
    lon, lat = F.col("ilon").cast("double"), F.col("ilat").cast("double")
    g = c.groupBy("ilat", "ilon").agg(F.avg("vel").alias("v")).select((lon - 5).alias("lon"), lat.alias("lat"), F.col("v").cast("double").alias("v"))
    r = c.where("reason_n = 0").groupBy("ilat", "ilon").agg(F.avg(F.when(F.col("az") > 0, F.col("vel"))).alias("v")).select(((lon + 355) % 360 + 0.01 * (F.col("ilat") % 10)).alias("lon"), lat.alias("lat"), F.col("v").cast("double").alias("v"))
    return masks.overwritten(g, r, 0.05, 0.03).withColumn("v", F.round("v", 6))


@query("cell_geometry", """with p as (select *, cast(floor((lat + 90) / 2) as int) as belt from stations), n as (select *, least(180, greatest(2, cast(round(360 * cos(radians(-90 + 2.0 * belt + 1)) / 2) as int))) as n from p), c as (select belt, n, cast(floor(((lon + 360) % 360) * n / 360) as int) as place from n)
  select belt, place, count(*) as stations, round(6371.0 * 6371.0 * 2 * pi() / n * (sin(radians(-90 + 2.0 * belt + 2)) - sin(radians(-90 + 2.0 * belt))), 4) as area from c group by belt, place, n""")
def cell_geometry(spark, sf_dir):
    """Stations in cells of nearly equal area, in belts of two degrees, with the cells' areas."""
    b = fields.belts(spark, 2.0)
    n = b.groupBy("belt").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "stations").withColumn("belt", F.floor((F.col("lat") + 90) / 2).cast("int")).join(F.broadcast(n), "belt")
    s = s.groupBy("belt", F.floor(F.pmod(F.col("lon"), F.lit(360.0)) * F.col("n") / 360).cast("int").alias("place")).agg(F.count("*").alias("stations"))
    return s.join(b, ["belt", "place"]).select("belt", "place", "stations", F.round("area", 4).alias("area"))


def _double_traces(spark, sf_dir):
    return table(spark, sf_dir, "traces").select("sta_key", "day", "label", F.col("data").cast("array<double>").alias("data"))


@query("rotated_records", """with t as (select sta_key, day, list_transform(data, lambda v: cast(v as double)) as e from traces), p as (select a.sta_key, a.day, a.e, b.e as n, radians(a.sta_key * 37 % 360) as b from t a join t b on a.sta_key = b.sta_key and b.day = a.day + 1),
  r as (select sta_key, day, list_transform(range(1, 65), lambda i: -e[i] * sin(b) - n[i] * cos(b)) as r, list_transform(range(1, 65), lambda i: -e[i] * cos(b) + n[i] * sin(b)) as t from p)
  select sta_key, day, round(list_sum(list_transform(range(1, 65), lambda i: r[i] * i)), 6) as radial, round(list_sum(list_transform(range(1, 65), lambda i: t[i] * i)), 6) as transverse, round(list_max(r), 6) as top from r""")
def rotated_records(spark, sf_dir):
    """Radial and transverse records from two components of a station, turned by its back-azimuth: their moments over time."""
    t = _double_traces(spark, sf_dir)
    p = t.select("sta_key", "day", F.col("data").alias("e")).join(t.select("sta_key", (F.col("day") - 1).alias("day"), F.col("data").alias("n")), ["sta_key", "day"])
    r, q = arrays.rotate(F.col("e"), F.col("n"), (F.col("sta_key") * 37 % 360).cast("double"))
    moment = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6)
    return p.select("sta_key", "day", moment(r).alias("radial"), moment(q).alias("transverse"), F.round(F.array_max(r), 6).alias("top"))


@query("precursor_flags", """with t as (select sta_key, day, label, list_transform(data, lambda v: cast(v as double)) as x, least(20 + sta_key % 40, 450) / 4.5 as s from traces), e as (select *, cast(floor(least(s, 100.0)) as int) as early from t),
  q as (select *, sqrt(list_sum(list_transform(range(33 - early + 1, 33 + early), lambda i: x[i] * x[i])) / (2 * early - 1)) as head, sqrt((list_sum(list_transform(range(1, 11), lambda i: x[i] * x[i])) + list_sum(list_transform(range(55, 65), lambda i: x[i] * x[i]))) / 20) as tail from e)
  select sta_key, day, label, round(head, 6) as head, round(tail, 6) as tail, head > 1.2 * tail as noisy from q""")
def precursor_flags(spark, sf_dir):
    """Records, taken as two-sided correlations, whose noise before the fastest wave is over 1.2 times that at their ends."""
    t = _double_traces(spark, sf_dir).withColumn("distance", F.least(20 + F.col("sta_key") % 40, F.lit(450)).cast("double"))
    p = arrays.precursor_noise(F.col("data"), 1.0, F.col("distance"))
    return t.withColumn("p", p).select("sta_key", "day", "label", F.round("p.head", 6).alias("head"), F.round("p.tail", 6).alias("tail"), (F.col("p.head") > 1.2 * F.col("p.tail")).alias("noisy"))


@query("shifted_records", """with x as (select row_number() over (order by sta_key, day, label) as id, sta_key, day, label, data, 0.25 * (1 + sta_key % 7) as tau from traces), s as (select id, tau, unnest(data)::double as v, generate_subscripts(data, 1) - 1 as n from x),
  f as (select id, tau, k, sum(v * cos(2 * pi() * k * n / 4096)) as re, -sum(v * sin(2 * pi() * k * n / 4096)) as im from s cross join (select unnest(range(0, 2049)) as k) group by id, tau, k),
  y as (select id, t, sum(case when k in (0, 2048) then 1 else 2 end * (re * cos(2 * pi() * k * (t - tau) / 4096) - im * sin(2 * pi() * k * (t - tau) / 4096))) / 4096 as v from f cross join (select unnest([10, 40]) as t) group by id, t)
  select sta_key, day, label, round(max(case when t = 10 then v end), 6) as early, round(max(case when t = 40 then v end), 6) as late from y join x using (id) group by all""")
def shifted_records(spark, sf_dir):
    """Two samples of records that are delayed by a fraction of a sample or more, by a phase ramp."""
    t = _double_traces(spark, sf_dir)
    return arrays.time_shifted(t.withColumn("shift", 0.25 * (1 + F.col("sta_key") % 7)), 1.0).select("sta_key", "day", "label", F.round(F.get("data", F.lit(10)), 6).alias("early"), F.round(F.get("data", F.lit(40)), 6).alias("late"))


@query("station_ray_samples", """with p as (select sta_key, unnest(range(4)) as k, radians(lon) as o1, radians(lat) as t1, radians(-150.0) as o2, radians(60.0) as t2 from stations), v as (select *, cos(t1) * cos(o1) as x1, cos(t1) * sin(o1) as y1, sin(t1) as z1, cos(t2) * cos(o2) as x2, cos(t2) * sin(o2) as y2, sin(t2) as z2, (k + 0.5) / 4 as s from p),
  d as (select *, acos(greatest(-1.0, least(1.0, x1 * x2 + y1 * y2 + z1 * z2))) as d from v), w as (select *, sin((1 - s) * d) / sin(d) as a, sin(s * d) / sin(d) as b from d where sin(d) >= 1e-12)
  select sta_key, cast(k as int) as k, round(degrees(atan2(a * y1 + b * y2, a * x1 + b * x2)), 6) as lon, round(degrees(atan2(a * z1 + b * z2, sqrt(power(a * x1 + b * x2, 2) + power(a * y1 + b * y2, 2)))), 6) as lat from w""")
def station_ray_samples(spark, sf_dir):
    """Four points along the great circle from each station to one place, by a table function in SQL."""
    tables.register(spark)
    s = table(spark, sf_dir, "stations").selectExpr("sta_key", "cast(lon as double) as lon", "cast(lat as double) as lat")
    return spark.sql("select s.sta_key, r.k, round(r.lon, 6) as lon, round(r.lat, 6) as lat from {s} s, lateral ray_samples(s.lon, s.lat, -150D, 60D, 4) r", s=s)


@query("blended_depths", f"""with g as (select ilat * 10 + ilon as pid, cast(-165 as double) + 2.5 * ilon as lon, cast(55 as double) + ilat as lat, avg(az) / 50 as topo, 1 + avg(vel) / pi() / 3 as sed, 30 + avg(vel) / pi() as crust from cells group by ilat, ilon), s as (select sta_key, lon, lat, elev_m / 3000 as topo, 0.5 + sta_key % 5 * 0.4 as sed, 28 + sta_key % 9 as crust from stations),
  d as (select g.*, s.topo as ts, s.sed as ss, s.crust as cs, sta_key, {geo.sql_distance('g.lon', 'g.lat', 's.lon', 's.lat')} as d from g join s on abs(g.lon - s.lon) <= 2.5 and abs(g.lat - s.lat) <= 2.5),
  n as (select *, d / 75 as w, row_number() over (partition by pid order by round(d, 6), sta_key) as k from d where d <= 75), m as (select *, w * (sed - topo) + (1 - w) * (ss - ts) as base, w * (sed + crust - topo) + (1 - w) * (ss + cs - ts) as moho from n where k = 1)
  select g.pid, coalesce(sta_key, -1) as sta_key, round(case when m.pid is null then g.sed when base + m.topo > 0 then base + m.topo else w * m.sed + (1 - w) * ss end, 5) as sed, round(case when m.pid is null then g.crust else moho - base end, 5) as crust from g left join m on g.pid = m.pid""")
def blended_depths(spark, sf_dir):
    """Thicknesses of sediments and crust of a grid with those of the nearest station mixed in, as depths below sea level."""
    g = table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg((F.avg("az") / 50).alias("topo"), (1 + F.avg("vel") / F.pi() / 3).alias("sed"), (30 + F.avg("vel") / F.pi()).alias("crust"))
    g = g.select((F.col("ilat") * 10 + F.col("ilon")).alias("pid"), (F.lit(-165.0) + 2.5 * F.col("ilon")).alias("lon"), (F.lit(55.0) + F.col("ilat")).alias("lat"), *(F.col(c).cast("double").alias(c) for c in ("topo", "sed", "crust")))
    s = table(spark, sf_dir, "stations").select(F.col("sta_key").alias("sid"), F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"), (F.col("elev_m") / 3000).cast("double").alias("topo_s"), (0.5 + F.col("sta_key") % 5 * 0.4).cast("double").alias("sed_s"), (28 + F.col("sta_key") % 9).cast("double").alias("crust_s"))
    x = lookup.blend_depths(g, s, 75.0, 2.5)
    return x.select("pid", F.coalesce("sid", F.lit(-1)).alias("sta_key"), F.round("sed", 5).alias("sed"), F.round("crust", 5).alias("crust"))
