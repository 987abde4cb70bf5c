"""Queries that keep, flag or rank rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.operators import stacks
from strataspark.operators.pairs import first_by, prefer
from strataspark.sources.fixtures import table

from .registry import curves_by_pair, query

#: Waves of this many km/s set the shortest distance of a period.
REFERENCE_SPEED = 3.5


@query("ray_qc", f"""select rec, sta1, sta2, period, round(c, 6) as c, round(u, 6) as u from curves
  where abs(sta1 - sta2) * 10 >= 3 * period * {REFERENCE_SPEED} and inbound = 1 and c between 0 and 10 and u between 0 and 10 and snr <= 1e10 and snr >= 15""")
def ray_qc(spark, sf_dir):
    """Rays of three wavelengths or more with sound velocities and signal."""
    x = table(spark, sf_dir, "curves").where(f"abs(sta1 - sta2) * 10 >= 3 * period * {REFERENCE_SPEED} and inbound = 1 and c between 0 and 10 and u between 0 and 10 and snr <= 1e10 and snr >= 15")
    return x.select("rec", "sta1", "sta2", "period", F.round("c", 6).alias("c"), F.round("u", 6).alias("u"))


@query("field_qc", "select period, sta1, count(*) as n from curves where inbound = 1 and c between 0 and 4.4 and u between 0 and 10 and snr <= 1e10 group by period, sta1")
def field_qc(spark, sf_dir):
    return table(spark, sf_dir, "curves").where("inbound = 1 and c between 0 and 4.4 and u between 0 and 10 and snr <= 1e10").groupBy("period", "sta1").agg(F.count("*").alias("n"))


@query("eikonal_input_qc", """with x as (select * from curves where c <> 0 and snr >= 10), y as (select *, count(*) over (partition by sta1, period) as n,
  avg(cast(1 - inbound as double)) over (partition by sta1, period) as share from x) select rec, sta1, period, n from y where n > 5 and share <= 0.5""")
def eikonal_input_qc(spark, sf_dir):
    """Points of fields that have more than five points, at most half of them borrowed."""
    w = Window.partitionBy("sta1", "period")
    x = table(spark, sf_dir, "curves").where("c <> 0 and snr >= 10").withColumns({"n": F.count("*").over(w), "share": F.avg((1 - F.col("inbound")).cast("double")).over(w)})
    return x.where("n > 5 and share <= 0.5").select("rec", "sta1", "period", "n")


@query("spectrum_qc", "select sta_key, day from traces where not list_bool_or(list_transform(data, lambda x: isnan(x) or abs(x) > 0.35))")
def spectrum_qc(spark, sf_dir):
    """Days whose spectra have neither NaN nor outsize amplitudes."""
    return table(spark, sf_dir, "traces").where(~F.exists("data", lambda x: F.isnan(x) | (F.abs(x) > 0.35))).select("sta_key", "day")


@query("residual_mad_qc", """with m as (select period_idx, median(res) as med from residuals group by period_idx), d as (select r.*, med from residuals r join m using (period_idx)),
  k as (select period_idx, median(abs(res - med)) as mad from d group by period_idx)
  select rec, period_idx from residuals join k using (period_idx) where abs(res) < 3 * mad or abs(res) < least(0.5 * (6 + 2 * period_idx), 10.0) * 0.1""")
def residual_mad_qc(spark, sf_dir):
    """Residuals within three median absolute deviations of the period, or small against it."""
    r = table(spark, sf_dir, "residuals")
    mad = stacks.grouped_mad(r, "period_idx", "res")
    return r.join(F.broadcast(mad), "period_idx").where("abs(res) < 3 * mad or abs(res) < least(0.5D * (6 + 2 * period_idx), 10.0D) * 0.1D").select("rec", "period_idx")


@query("moveout_flags", """select sta_key, baz, it, amp, case when baz / 2000 <= 0.04 or baz / 2000 > 0.1 then -3 when amp > 0.04 then -2 when amp < 0 then -1 else 1 end as flag from rf""")
def moveout_flags(spark, sf_dir):
    """First failing rule: slowness, amplitude, sign; 1 where none fails."""
    slow = F.col("baz") / 2000
    return table(spark, sf_dir, "rf").withColumn("flag", F.when((slow <= 0.04) | (slow > 0.1), -3).when(F.col("amp") > 0.04, -2).when(F.col("amp") < 0, -1).otherwise(1))


@query("rf_qc", "select sta_key, baz, count(*) as n, round(max(amp), 6) as top from rf group by sta_key, baz having max(amp) <= 1 and min(amp) >= -0.04 and count(*) >= 2")
def rf_qc(spark, sf_dir):
    return table(spark, sf_dir, "rf").groupBy("sta_key", "baz").agg(F.count("*").alias("n"), F.round(F.max("amp"), 6).alias("top"), F.min("amp").alias("low")).where("top <= 1 and low >= -0.04 and n >= 2").drop("low")


@query("excluded_networks", "select staid from stations where split_part(staid, '.', 1) not in ('N1', 'N7') and staid not in (select staid from stations where elev_m < 0)")
def excluded_networks(spark, sf_dir):
    s = table(spark, sf_dir, "stations")
    low = s.where("elev_m < 0").select("staid")
    return s.where(~F.split_part("staid", F.lit("."), F.lit(1)).isin("N1", "N7")).join(low, "staid", "left_anti").select("staid")


@query("path_rejector", """with m as (select period, avg(c) as mean_c from curves group by period) select rec, period from curves join m using (period)
  where abs(sta1 - sta2) * 10 > 2 * period * mean_c and abs(c / mean_c - 1) * 100 <= 20""")
def path_rejector(spark, sf_dir):
    """Paths of two wavelengths or more whose velocity is within a fifth of the period's mean."""
    c = table(spark, sf_dir, "curves")
    return c.join(c.groupBy("period").agg(F.avg("c").alias("mean_c")), "period").where("abs(sta1 - sta2) * 10 > 2 * period * mean_c and abs(c / mean_c - 1) * 100 <= 20").select("rec", "period")


@query("region_paths", """select a.sta_key as sta1, b.sta_key as sta2 from stations a join stations b on a.sta_key < b.sta_key
  where (a.lon + 360) % 360 between 200 and 212 and (b.lon + 360) % 360 between 200 and 212 and a.lat between 56 and 62 and b.lat between 56 and 62""")
def region_paths(spark, sf_dir):
    """Pairs whose ends lie in a window of longitudes from 0 to 360; stations are filtered before they are joined."""
    s = table(spark, sf_dir, "stations").where("(lon + 360) % 360 between 200 and 212 and lat between 56 and 62")
    a, b = (s.select(F.col("sta_key").alias(n)) for n in ("sta1", "sta2"))
    return a.join(b, F.col("sta1") < F.col("sta2"))


@query("posterior_selection", """with m as (select grid, min(misfit) as low from ensemble where acc = 1 group by grid), t as (select grid, case when low <= 0.5 then low + 0.5 else 2 * low end as thr from m),
  r as (select e.*, thr, row_number() over (partition by grid order by misfit, isample) as k from ensemble e join t using (grid) where acc = 1) select grid, isample from r where misfit <= thr and k <= 200""")
def posterior_selection(spark, sf_dir):
    """Accepted models whose misfit is near their grid point's least, the best 200 at most: a top-k by design."""
    e = table(spark, sf_dir, "ensemble").where("acc = 1")
    w = Window.partitionBy("grid")
    low = F.min("misfit").over(w)
    x = e.withColumns({"thr": F.when(low <= 0.5, low + 0.5).otherwise(2 * low), "k": F.row_number().over(w.orderBy("misfit", "isample"))})
    return x.where("misfit <= thr and k <= 200").select("grid", "isample")


@query("channel_priority", """with x as (select user_id, event_type, case event_type when 'purchase' then 0 when 'click' then 1 when 'view' then 2 else 3 end as r, count(*) as n from events group by all),
  y as (select *, row_number() over (partition by user_id order by r, event_type) as k from x) select user_id, event_type, n from y where k = 1""")
def channel_priority(spark, sf_dir):
    """Each station's channel type that comes first in the order of preference."""
    r = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    x = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return first_by(x, ["user_id"], [r, F.col("event_type")])


@query("longest_trace", "select sta_key, max(day) as day from (select sta_key, day, rank() over (partition by sta_key order by len(list_filter(data, lambda x: x > 0)) desc) as r from traces) t where r = 1 group by sta_key")
def longest_trace(spark, sf_dir):
    """The day with most samples above zero; of several the last."""
    n = F.size(F.filter("data", lambda x: x > 0))
    return table(spark, sf_dir, "traces").groupBy("sta_key").agg(F.max_by("day", F.struct(n, "day")).alias("day"))


@query("catalog_union", "select evid, mag from catalog where mag >= 7 union select evid, mag from catalog where evdp >= 500 except select evid, mag from catalog where evla < -60")
def catalog_union(spark, sf_dir):
    """Two selections of a catalog as one, without its far south; the same rows as distinct, set union and difference."""
    c = table(spark, sf_dir, "catalog").select("evid", "mag", "evdp", "evla")
    return c.where("(mag >= 7 or evdp >= 500) and not evla < -60").select("evid", "mag").distinct()


@query("prefer_two_station", """with p as (select sta1, sta2, period, avg(c) as c from curves where inbound = 1 group by all), q as (select sta1, sta2, period, avg(u) as c from curves where inbound = 0 group by all)
  select sta1, sta2, period, round(c, 6) as c, 0 as borrowed from p union all select q.sta1, q.sta2, q.period, round(q.c, 6), 1 from q anti join p using (sta1, sta2, period)""")
def prefer_two_station(spark, sf_dir):
    """Two-station measurements, and three-station ones where there is none."""
    c = table(spark, sf_dir, "curves")
    keys = ["sta1", "sta2", "period"]
    x = prefer(c.where("inbound = 1").groupBy(*keys).agg(F.avg("c").alias("c")), c.where("inbound = 0").groupBy(*keys).agg(F.avg("u").alias("c")), keys)
    return x.withColumn("c", F.round("c", 6))


@query("grid_reason_codes", """with s as (select ev, ilat, ilon, avg(1 / vel) as slow, count(*) as n, max(reason_n) as bad from cells group by all)
  select ev, ilat, ilon, case when bad > 0 and n > 2 then 1 when n < 1 then 2 when slow < 0.24 or slow > 0.35 then 3 else 0 end as reason from s""")
def grid_reason_codes(spark, sf_dir):
    s = table(spark, sf_dir, "cells").groupBy("ev", "ilat", "ilon").agg(F.avg(1 / F.col("vel")).alias("slow"), F.count("*").alias("n"), F.max("reason_n").alias("bad"))
    return s.select("ev", "ilat", "ilon", F.when(F.expr("bad > 0 and n > 2"), 1).when(F.col("n") < 1, 2).when(F.expr("slow < 0.24 or slow > 0.35"), 3).otherwise(0).alias("reason"))


@query("mask_combine", "select ilat, ilon, bool_or(reason_n = 1) as any_bad, count(*) filter (where reason_n = 0) < 30 as masked, count(distinct ev) as n_events from cells group by ilat, ilon")
def mask_combine(spark, sf_dir):
    return table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.bool_or(F.col("reason_n") == 1).alias("any_bad"), (F.count_if(F.col("reason_n") == 0) < 30).alias("masked"), F.count_distinct("ev").alias("n_events"))


@query("period_resample", """with p as (select unnest([7.0, 9.0, 11.0, 13.0, 15.0]) as period), c as (select sta1, sta2, period, avg(c) as c from curves group by all)
  select l.sta1, l.sta2, cast(p.period as double) as period, round(case when lo is null then hc when hi is null then lc when hi = lo then lc else lc + (hc - lc) * (p.period - lo) / (hi - lo) end, 6) as c, lo is not null and hi is not null as inbound
  from (select distinct sta1, sta2 from c) l cross join p
  left join lateral (select max(period) as lo, max_by(c, period) as lc from c where c.sta1 = l.sta1 and c.sta2 = l.sta2 and c.period <= p.period) a on true
  left join lateral (select min(period) as hi, min_by(c, period) as hc from c where c.sta1 = l.sta1 and c.sta2 = l.sta2 and c.period >= p.period) b on true""")
def period_resample(spark, sf_dir):
    """Curves at other periods: linear between the neighbours, the end value outside, and whether it is inside."""
    c = curves_by_pair(spark, sf_dir, "period", "c").groupBy("sta1", "sta2", "period").agg(F.avg("c").alias("c"))
    curve = c.groupBy("sta1", "sta2").agg(F.array_sort(F.collect_list(F.struct("period", "c"))).alias("p"))
    x = curve.withColumn("period", F.explode(F.array(*(F.lit(float(t)) for t in (7, 9, 11, 13, 15)))))
    from strataspark.operators.arrays import interpolate

    xs, ys = F.transform("p", lambda e: e["period"]), F.transform("p", lambda e: e["c"])
    inside = (F.get(xs, F.lit(0)) <= F.col("period")) & (F.get(xs, F.size(xs) - 1) >= F.col("period"))
    return x.select("sta1", "sta2", "period", F.round(interpolate(xs, ys, F.col("period")), 6).alias("c"), inside.alias("inbound"))
