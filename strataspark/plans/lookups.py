"""Queries that look things up: correlation tables, model grids, earth models, list edits and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.operators import lookup
from strataspark.sources.fixtures import table

from .registry import curves_by_pair, query


def _curve_table(spark, sf_dir) -> DataFrame:
    """A row a pair with three numbers, smallest, mean and largest velocity, in place of a correlation's lags."""
    k = curves_by_pair(spark, sf_dir, "c").groupBy("sta1", "sta2").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.avg("c").alias("mid"), F.max("c").alias("hi"))
    return k.select("sta1", "sta2", "n", F.array("lo", "mid", "hi").alias("data"))


@query("correlation_lookup", """with k as (select sta1, sta2, count(*) as n, min(c) as lo, avg(c) as mid, max(c) as hi from curves group by all),
  r as (select sta_key as a, cast(sta_key * 7 % (select count(*) from supplier) + 1 as bigint) as b from stations)
  select a, b, case when a > b then 1 else 0 end as reversed, coalesce(n, 0) as n, round(case when a > b then hi else lo end, 6) as first, round(mid, 6) as middle, round(case when a > b then lo else hi end, 6) as last
  from r left join k on k.sta1 = least(a, b) and k.sta2 = greatest(a, b) where a <> b""")
def correlation_lookup(spark, sf_dir):
    """What the table has for requested pairs, in either order: reversed pairs get their lags reversed, unknown ones null."""
    s = table(spark, sf_dir, "stations")
    n = s.agg(F.count("*").alias("n"))
    r = s.crossJoin(F.broadcast(n)).select(F.col("sta_key").alias("a"), (F.col("sta_key") * 7 % F.col("n") + 1).cast("bigint").alias("b")).where("a <> b")
    x = lookup.correlations(_curve_table(spark, sf_dir), r)
    return x.select("a", "b", "reversed", F.coalesce("n", F.lit(0)).alias("n"), *(F.round(F.get("data", F.lit(k)), 6).alias(c) for k, c in enumerate(("first", "middle", "last"))))


@query("curve_merge", """with k as (select sta1, sta2, period, inbound, round(avg(c), 6) as c, max(snr) as snr from curves group by all), d as (select * from k where inbound = 1), e as (select * from k where inbound = 0)
  select coalesce(d.sta1, e.sta1) as sta1, coalesce(d.sta2, e.sta2) as sta2, coalesce(d.period, e.period) as period, case when d.c is not null and not coalesce(e.snr > 2 * d.snr, false) then d.c else e.c end as c,
  case when d.c is not null and not coalesce(e.snr > 2 * d.snr, false) then 2 else 3 end as kind from d full outer join e on d.sta1 = e.sta1 and d.sta2 = e.sta2 and d.period = e.period""")
def curve_merge(spark, sf_dir):
    """Two-station curves with three-station ones where they are missing or half as clear."""
    k = table(spark, sf_dir, "curves").groupBy("sta1", "sta2", "period", "inbound").agg(F.round(F.avg("c"), 6).alias("c"), F.max("snr").alias("snr"))
    return lookup.merge_curves(k.where("inbound = 1").drop("inbound"), k.where("inbound = 0").drop("inbound"), 2.0)


@query("grid_dispersion", """with c as (select ilat, ilon, cast(8 + 2 * (ev % 5) as double) as period, vel, az from cells where reason_n = 0),
  g as (select ilat, ilon, period, avg(vel) as c, 1.5 * stddev_pop(vel) / sqrt(count(*)) as unc, least(90, 20 * stddev_pop(az) / sqrt(count(*))) as psi from c group by all having count(*) >= 3)
  select ilat, ilon, count(*) as n_periods, round(min_by(c, period), 6) as c_short, round(max_by(c, period), 6) as c_long, round(max(unc), 6) as unc, round(max(psi), 6) as psi_unc, round(sum(c * period), 5) as moment from g group by ilat, ilon""")
def grid_dispersion(spark, sf_dir):
    """Dispersion curves of grid points out of the stacked maps of all periods: errors times 1.5, those of directions 90 at most."""
    c = table(spark, sf_dir, "cells").where("reason_n = 0").select("ilat", "ilon", (8 + 2 * (F.col("ev") % 5)).cast("double").alias("period"), "vel", "az")
    g = lookup.grid_curves(c, ["ilat", "ilon"], 1.5, 3)
    arr = lambda f, n: F.aggregate("curve", F.lit(n), f)
    at = lambda k, n: F.round(F.element_at("curve", k)["c"], 6).alias(n)
    return g.select("ilat", "ilon", F.size("curve").cast("bigint").alias("n_periods"), at(1, "c_short"), at(-1, "c_long"), F.round(arr(lambda a, x: F.greatest(a, x["unc"]), 0.0), 6).alias("unc"), F.round(arr(lambda a, x: F.greatest(a, x["psi_unc"]), 0.0), 6).alias("psi_unc"), F.round(arr(lambda a, x: a + x["c"] * x["period"], 0.0), 5).alias("moment"))


@query("crust_at_points", """with n as (select ceil(lon) as lon, ceil(lat) as lat, avg(elev_m) as thickness from stations group by all), p as (select sta_key, lon + 0.3 as lon, lat + 0.4 as lat from stations)
  select p.sta_key, round(n.thickness, 4) as thickness, case when n.lon is null then 1 else 0 end as missing from p left join n on n.lon = ceil(p.lon) and n.lat = ceil(p.lat)""")
def crust_at_points(spark, sf_dir):
    """The value of the first one-degree node to the north-east of each point; missing where none is within a degree."""
    s = table(spark, sf_dir, "stations")
    nodes = s.groupBy(F.ceil("lon").alias("lon"), F.ceil("lat").alias("lat")).agg(F.avg("elev_m").alias("thickness"))
    x = lookup.directional_node(s.select("sta_key", (F.col("lon") + 0.3).alias("lon"), (F.col("lat") + 0.4).alias("lat")), nodes)
    return x.select("sta_key", F.round("thickness", 4).alias("thickness"), F.when(F.col("thickness").isNull(), 1).otherwise(0).alias("missing"))


@query("rf_inputs", """with n as (select sta_key, count(*) as n from rf group by sta_key having count(*) >= 40) select sta_key, it, n, round(avg(amp), 6) as amp, round(stddev_pop(amp), 6) as unc from rf join n using (sta_key) group by sta_key, it, n""")
def rf_inputs(spark, sf_dir):
    """Average receiver functions of the stations that have 40 traces or more."""
    rf = table(spark, sf_dir, "rf")
    n = rf.groupBy("sta_key").agg(F.count("*").alias("n")).where("n >= 40")
    return rf.join(n, "sta_key").groupBy("sta_key", "it", "n").agg(F.round(F.avg("amp"), 6).alias("amp"), F.round(F.stddev_pop("amp"), 6).alias("unc"))


@query("station_dispersion", """with k as (select sta1 as sta, period, c from curves union all select sta2, period, c from curves), m as (select sta, period, avg(c) as c from k group by all)
  select s.staid, count(m.period) as n_periods, round(min(c), 6) as slowest, round(max(c), 6) as fastest from stations s left join m on m.sta = s.sta_key group by s.staid""")
def station_dispersion(spark, sf_dir):
    """The mean curve at each station, from all pairs that it belongs to; stations without one stay with no periods."""
    c = table(spark, sf_dir, "curves")
    m = c.select(F.explode(F.array("sta1", "sta2")).alias("sta_key"), "period", "c").groupBy("sta_key", "period").agg(F.avg("c").alias("c"))
    return table(spark, sf_dir, "stations").join(m, "sta_key", "left").groupBy("staid").agg(F.count("period").alias("n_periods"), F.round(F.min("c"), 6).alias("slowest"), F.round(F.max("c"), 6).alias("fastest"))


@query("cartesian_grid", """with p as (select sta_key, cast(unnest(range(0, 60, 20)) as double) as depth, lon, lat from stations) select sta_key, cast(depth as int) as depth, round((6371 - depth) * cos(radians(lat)) * cos(radians(lon)), 5) as x,
  round((6371 - depth) * cos(radians(lat)) * sin(radians(lon)), 5) as y, round((6371 - depth) * sin(radians(lat)), 5) as z from p""")
def cartesian_grid(spark, sf_dir):
    """Cartesian coordinates of a volume's points below stations, for export."""
    p = table(spark, sf_dir, "stations").select("sta_key", "lon", "lat", F.explode(F.array(*map(F.lit, (0, 20, 40)))).alias("depth"))
    x, y, z = geo.cartesian(F.col("lon"), F.col("lat"), F.lit(6371.0) - F.col("depth"))
    return p.select("sta_key", "depth", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


@query("grid_reshape", """with v as (select ilat, ilon, avg(vel) as v, count(distinct ev) as n from cells where reason_n = 1 group by all having count(*) % 3 > 0), g as (select cast(a as int) as ilat, cast(b as bigint) as ilon from (select unnest(range(12)) as a) cross join (select unnest(range(12)) as b))
  select g.ilat, g.ilon, round(v.v, 6) as v, case when v.v is null then 1 else 0 end as mask1, case when v.n is null or v.n < 2 then 1 else 0 end as mask2 from g left join v on g.ilat = v.ilat and g.ilon = v.ilon""")
def grid_reshape(spark, sf_dir):
    """A flat map on its whole grid: masked where it has no value, and where fewer than two fields made it."""
    v = table(spark, sf_dir, "cells").where("reason_n = 1").groupBy("ilat", "ilon").agg(F.avg("vel").alias("v"), F.count_distinct("ev").alias("n"), F.count("*").alias("k")).where("k % 3 > 0")
    x = lookup.on_grid(v, 12, 12)
    return x.select("ilat", "ilon", F.round("v", 6).alias("v"), F.col("v").isNull().cast("int").alias("mask1"), (F.col("n").isNull() | (F.col("n") < 2)).cast("int").alias("mask2"))


@query("rf_list_edits", """with a as (select distinct sta_key, cast(baz as int) as baz from rf where it <= 2), b as (select distinct sta_key, cast(baz as int) as baz from rf where it >= 6), u as (select * from a union all select * from b),
  d as (select distinct sta_key, cast(baz as int) as baz from rf where it = 4), k as (select * from u where not exists (select 1 from d where d.sta_key = u.sta_key and d.baz = u.baz))
  select sta_key, baz, cast(row_number() over (partition by sta_key order by baz) - 1 as int) as place from k""")
def rf_list_edits(spark, sf_dir):
    """Two lists of receiver functions put together, without those of a third; each gets its place in its station's list."""
    of = lambda c: table(spark, sf_dir, "rf").where(c).select("sta_key", F.col("baz").cast("int").alias("baz")).distinct()
    kept = of("it <= 2").union(of("it >= 6")).join(of("it = 4"), ["sta_key", "baz"], "left_anti")
    return kept.withColumn("place", (F.row_number().over(Window.partitionBy("sta_key").orderBy("baz")) - 1).cast("int"))


@query("chain_merge", """with a as (select grid, 0 as chain, isample, misfit from ensemble where isample % 2 = 0), b as (select grid, 1 as chain, isample, misfit from ensemble where isample % 2 = 1), u as (select * from a union all select * from b)
  select grid, count(*) as n, count(distinct chain) as chains, round(min(misfit), 6) as least, arg_min(chain, misfit * 1e9 + isample) as best_chain from u group by grid""")
def chain_merge(spark, sf_dir):
    """Chains of each grid point put together, with the one that holds the best sample."""
    e = table(spark, sf_dir, "ensemble")
    u = e.where("isample % 2 = 0").withColumn("chain", F.lit(0)).unionByName(e.where("isample % 2 = 1").withColumn("chain", F.lit(1)))
    return u.groupBy("grid").agg(F.count("*").alias("n"), F.count_distinct("chain").alias("chains"), F.round(F.min("misfit"), 6).alias("least"), F.min_by("chain", F.col("misfit") * 1e9 + F.col("isample")).alias("best_chain"))


@query("largest_run", """with r as (select sta1, cast(rec % 5 as int) as run, count(*) as size, avg(res) as res from residuals group by all), o as (select *, row_number() over (partition by sta1 order by size desc, run) as k from r) select sta1, run, size, round(res, 6) as res from o where k = 1""")
def largest_run(spark, sf_dir):
    """Of several runs from different starting points the one that kept most, the first of equals."""
    r = table(spark, sf_dir, "residuals").groupBy("sta1", (F.col("rec") % 5).cast("int").alias("run")).agg(F.count("*").alias("size"), F.avg("res").alias("res"))
    b = r.groupBy("sta1").agg(F.max_by(F.struct("run", "size", "res"), F.struct("size", -F.col("run"))).alias("b"))
    return b.select("sta1", "b.run", "b.size", F.round("b.res", 6).alias("res"))


@query("stations_by_distance", f"""with d as (select evid, sta_key, {geo.sql_distance('evlo', 'evla', 'lon', 'lat')} as d from (select * from catalog where evid % 97 = 0) cross join stations) select evid, sta_key, round(d, 5) as d, cast(row_number() over (partition by evid order by round(d, 5), sta_key) as int) as place from d""".replace("(select * from catalog where evid % 97 = 0)", "(select evlo, evla, evid from (select *, row_number() over (partition by cast(floor(mag * 10) as bigint) order by evid) as k from catalog) where k = 1)"))
def stations_by_distance(spark, sf_dir):
    """Stations by distance from the first event of each magnitude step."""
    c = table(spark, sf_dir, "catalog").groupBy(F.floor(F.col("mag") * 10).alias("step")).agg(F.min_by(F.struct("evid", "evlo", "evla"), "evid").alias("e")).select("e.*")
    d = F.broadcast(c).crossJoin(table(spark, sf_dir, "stations")).select("evid", "sta_key", F.round(geo.distance_km(F.col("evlo"), F.col("evla"), F.col("lon"), F.col("lat")), 5).alias("d"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("evid").orderBy("d", "sta_key")))


@query("earth_model_at", """with m as (select k, k * k as z, 5.8 + 0.1 * k as vp from (select unnest(range(0, 25)) as k)), d as (select sta_key, cast(sta_key * 13 % 500 as double) as depth from stations),
  o as (select sta_key, depth, k, vp, row_number() over (partition by sta_key order by abs(depth - z), k) as r from d cross join m) select sta_key, cast(depth as int) as depth, cast(k as int) as node, round(vp, 4) as vp from o where r = 1""")
def earth_model_at(spark, sf_dir):
    """The nearest node of a one-dimensional earth model to each depth, the upper of two as near; the model is a short table."""
    nodes = [(float(k * k), 5.8 + 0.1 * k) for k in range(25)]
    d = table(spark, sf_dir, "stations").select("sta_key", (F.col("sta_key") * 13 % 500).cast("int").alias("depth"))
    n = lookup.nearest_node([z for z, _ in nodes], F.col("depth").cast("double"))
    return d.select("sta_key", "depth", n.alias("node"), F.round(F.get(F.array(*(F.lit(v) for _, v in nodes)), n), 4).alias("vp"))


@query("slowness_lookup", """with p as (select evid, cast(30 + evid % 600 as double) / 10 + 27 as delta, evdp from catalog), t as (select cast(a as double) as delta, cast(b as double) as depth, 8.8 - 0.05 * a - 0.0008 * b + 0.00001 * a * b as p from (select unnest(range(0, 200, 5)) as a) cross join (select unnest(range(0, 800, 50)) as b)),
  q as (select evid, delta, evdp, floor(delta / 5) * 5 as d0, floor(evdp / 50) * 50 as h0 from p),
  v as (select q.*, a.p as p00, b.p as p10, c.p as p01, e.p as p11, (q.delta - d0) / 5 as x, (evdp - h0) / 50 as y from q join t a on a.delta = d0 and a.depth = h0 join t b on b.delta = d0 + 5 and b.depth = h0 join t c on c.delta = d0 and c.depth = h0 + 50 join t e on e.delta = d0 + 5 and e.depth = h0 + 50)
  select evid, round((1 - x) * (1 - y) * p00 + x * (1 - y) * p10 + (1 - x) * y * p01 + x * y * p11, 7) as sec_per_degree, round(((1 - x) * (1 - y) * p00 + x * (1 - y) * p10 + (1 - x) * y * p01 + x * y * p11) / 111.12, 7) as sec_per_km from v""")
def slowness_lookup(spark, sf_dir):
    """Slowness of events by a table over distance and depth, linear between its nodes."""
    t = spark.sql("select cast(a as double) as delta, cast(b as double) as depth, 8.8D - 0.05D * a - 0.0008D * b + 0.00001D * a * b as p from range(0, 200, 5) as r1(a) cross join range(0, 800, 50) as r2(b)")
    p = table(spark, sf_dir, "catalog").select("evid", ((30 + F.col("evid") % 600).cast("double") / 10 + 27).alias("delta"), F.col("evdp").alias("depth"))
    x = lookup.bilinear(p, t, "delta", "depth", 5.0, 50.0, "p")
    return x.select("evid", F.round("p", 7).alias("sec_per_degree"), F.round(F.col("p") / geo.KM_PER_DEGREE, 7).alias("sec_per_km"))


@query("grid_station_blend", f"""with g as (select ilat * 10 + ilon as pid, cast(-165 as double) + 2.5 * ilon as lon, cast(55 as double) + ilat as lat, avg(vel) as v from cells group by all), s as (select sta_key, lon, lat, 2.5 + elev_m / 10000 as v from stations),
  d as (select pid, g.v as gv, s.v as sv, sta_key, {geo.sql_distance('g.lon', 'g.lat', 's.lon', 's.lat')} as d from g join s on abs(g.lon - s.lon) <= 2.5 and abs(g.lat - s.lat) <= 2.5),
  n as (select *, row_number() over (partition by pid order by round(d, 6), sta_key) as k from d where d <= 75)
  select g.pid, coalesce(n.sta_key, -1) as sta_key, round(case when n.d is null then g.v else n.d / 75 * g.v + (1 - n.d / 75) * n.sv end, 6) as v from g left join (select * from n where k = 1) n using (pid)""")
def grid_station_blend(spark, sf_dir):
    """Grid values blended with the nearest station's within 75 km: its weight falls to nothing with the distance."""
    g = table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.avg("vel").alias("v")).select((F.col("ilat") * 10 + F.col("ilon")).alias("pid"), (F.lit(-165.0) + 2.5 * F.col("ilon")).alias("lon"), (F.lit(55.0) + F.col("ilat")).alias("lat"), "v")
    s = table(spark, sf_dir, "stations").select(F.col("sta_key").alias("sid"), F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"), (2.5 + F.col("elev_m") / 10000).alias("sv"))
    x = lookup.blend(g, s, 75.0, 2.5)
    return x.select("pid", F.coalesce("sid", F.lit(-1)).alias("sta_key"), F.round("v", 6).alias("v"))
