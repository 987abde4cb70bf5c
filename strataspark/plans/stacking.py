"""Queries that aggregate: stacks, counts, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.operators import arrays, blocks, stacks
from strataspark.sources.fixtures import table

from .registry import query


@query("pair_stack", """with t as (select sta_key, day, data from traces), p as (select a.sta_key as sta1, b.sta_key as sta2, a.day as day, a.data as x, b.data as y from t a join t b on a.day = b.day and a.sta_key < b.sta_key),
  l as (select sta1, sta2, day, lag, list_sum(list_transform(range(1, 65), lambda i: case when i + lag between 1 and 64 then cast(x[i] as double) * y[i + lag] else 0 end)) as v from p cross join (select unnest(range(-2, 3)) as lag) k)
  select sta1, sta2, cast(lag as int) as lag, round(sum(v), 6) as value, count(*) as n from l group by sta1, sta2, lag""")
def pair_stack(spark, sf_dir):
    """Short-lag correlations of all station pairs, summed over days with their number: a product of matrices a lag and block of stations."""
    x = blocks.lag_sums(table(spark, sf_dir, "traces").select("sta_key", "day", "data"), 2)
    lags = F.array(*(F.struct(F.lit(k - 2).alias("lag"), F.round(f"v{k}", 6).alias("value")) for k in range(5)))
    return x.select("sta1", "sta2", F.explode(lags).alias("l"), "n").select("sta1", "sta2", "l.lag", "l.value", "n")


@query("station_stack", """with e as (select sta_key, label, unnest(data) as x, generate_subscripts(data, 1) as i from traces), s as (select sta_key, i, sum(cast(x as double)) as x, count(*) as n from e group by sta_key, i)
  select sta_key, round(sum(x * i), 4) as moment, round(max(x), 5) as top, max(n) as n from s group by sta_key""")
def station_stack(spark, sf_dir):
    """Unnormalised element-wise sum of a station's traces and the number of days."""
    t = table(spark, sf_dir, "traces").select("sta_key", F.col("data").cast("array<double>").alias("data"))
    s = arrays.element_sum(t, ["sta_key"])
    moment = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select("sta_key", F.round(moment, 4).alias("moment"), F.round(F.array_max("data"), 5).alias("top"), "n")


@query("monthly_stack", "select user_id, event_type, date_trunc('month', ts) as month, round(sum(value), 4) as total, count(*) as n, count(distinct cast(ts as date)) as days from events group by all")
def monthly_stack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@query("append_stacks", """with a as (select user_id, sum(value) as v, count(*) as n from events where day(ts) <= 15 group by user_id), b as (select user_id, sum(value) as v, count(*) as n from events where day(ts) > 10 group by user_id)
  select user_id, round(sum(v), 4) as v, cast(sum(n) as bigint) as n from (select * from a union all select * from b) u group by user_id""")
def append_stacks(spark, sf_dir):
    """Two stacks as one: sums where a key is in both, else as it is."""
    e = table(spark, sf_dir, "events")
    part = lambda c: e.where(c).groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return part("day(ts) <= 15").unionByName(part("day(ts) > 10")).groupBy("user_id").agg(F.round(F.sum("v"), 4).alias("v"), F.sum("n").alias("n"))


@query("data_counts", """with d as (select user_id, count(distinct cast(ts as date)) as days from events group by user_id) select cast(t as bigint) as threshold, count(*) filter (where days >= t) as n from d cross join (select unnest([1, 5, 10, 20, 30]) as t) k group by t""")
def data_counts(spark, sf_dir):
    """How many stations have as many days, for several thresholds; the thresholds go to the counts, not rows to them."""
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.col("ts").cast("date")).alias("days"))
    g = d.agg(*(F.count_if(F.col("days") >= t).alias(str(t)) for t in (1, 5, 10, 20, 30)))
    return g.select(F.explode(F.array(*(F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"`{t}`").alias("n")) for t in (1, 5, 10, 20, 30)))).alias("x")).select("x.*")


@query("job_status", "select coalesce(event_type, 'all') as status, coalesce(cast(user_id % 7 as varchar), 'all') as month, count(*) as n from events group by rollup(user_id % 7, event_type)")
def job_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("month"), F.col("event_type").alias("status"))
    x = e.rollup("month", "status").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce(F.col("month").cast("string"), F.lit("all")).alias("month"), "n")


@query("block_median", "select cast(floor(lon / 2) as bigint) as bx, cast(floor(lat / 2) as bigint) as byy, round(median(elev_m), 4) as z, round(avg(elev_m), 4) as z_mean, count(*) as n from stations group by all")
def block_median(spark, sf_dir):
    s = table(spark, sf_dir, "stations")
    return s.groupBy(F.floor(F.col("lon") / 2).alias("bx"), F.floor(F.col("lat") / 2).alias("byy")).agg(F.round(F.median("elev_m"), 4).alias("z"), F.round(F.avg("elev_m"), 4).alias("z_mean"), F.count("*").alias("n"))


def _azimuths(spark, sf_dir):
    c = table(spark, sf_dir, "cells")
    return c.select("rec", "ilat", "ilon", F.col("az").cast("int").alias("az"), (1 / F.col("vel")).alias("slow"), (F.col("reason_n") == 0).alias("valid"))


_NEAR = """c as (select rec, ilat, ilon, cast(az as int) as az, 1 / vel as slow, reason_n = 0 as valid from cells), h as (select ilat, ilon, az, count(*) as n from c group by all),
  nn as (select a.ilat, a.ilon, a.az, cast(sum(b.n) as bigint) as near from h a join h b using (ilat, ilon) where abs(a.az - b.az) <= 20 or abs(a.az - b.az) >= 340 group by a.ilat, a.ilon, a.az),
  k as (select c.*, case when valid then near else 0 end as near from c join nn using (ilat, ilon, az))"""


@query("azimuth_weights", f"with {_NEAR} select rec, cast(near as bigint) as near from k")
def azimuth_weights(spark, sf_dir):
    return stacks.azimuth_weights(_azimuths(spark, sf_dir), ["ilat", "ilon"]).select("rec", F.col("near").cast("bigint").alias("near"))


@query("isotropic_stack", f"""with {_NEAR}, x0 as (select *, count(*) over (partition by ilat, ilon) as n, cast(1 as double) / near as w0 from k where near > 0),
  x1 as (select *, avg(w0) over p + 3 * stddev_pop(w0) over p as cap from x0 where n >= 20 window p as (partition by ilat, ilon)),
  x2 as (select *, least(w0, cap) / sum(least(w0, cap)) over (partition by ilat, ilon) as w from x1), x3 as (select *, sum(w * slow) over (partition by ilat, ilon) as m from x2),
  x4 as (select *, sqrt(sum(w * power(slow - m, 2)) over (partition by ilat, ilon)) as sd from x3)
  select ilat, ilon, max(n) as n, count(*) as n_kept, round(sum(w * slow) / sum(w), 6) as slowness, round(sum(w) / sum(w * slow), 5) as velocity, round(stddev_pop(slow) / sqrt(count(*)), 6) as sem from x4 where abs(slow - m) <= 2 * sd group by ilat, ilon""")
def isotropic_stack(spark, sf_dir):
    x = stacks.isotropic_stack(stacks.azimuth_weights(_azimuths(spark, sf_dir), ["ilat", "ilon"]), ["ilat", "ilon"], 20)
    return x.select("ilat", "ilon", "n", "n_kept", F.round("slowness", 6).alias("slowness"), F.round("velocity", 5).alias("velocity"), F.round("sem", 6).alias("sem"))


@query("azimuth_bins", """with m as (select *, 1 / vel - avg(1 / vel) over (partition by ilat, ilon) as d from cells where reason_n = 0), o as (select unnest([-1, 0, 1]) as o),
  e as (select m.ilat + a.o as ilat, m.ilon + b.o as ilon, cast(floor((az + 180) / 20) as bigint) as bin, d from m cross join o a cross join o b)
  select ilat, ilon, bin, count(*) as n, round(avg(d), 6) as slow, round(stddev_samp(d) / sqrt(count(*)), 6) as sem from e where ilat between 0 and 9 and ilon between 0 and 9 group by ilat, ilon, bin having count(*) >= 2""")
def azimuth_bins(spark, sf_dir):
    """Mean slowness deviation by azimuth over each cell and its eight neighbours; bins of one value are left out."""
    c = table(spark, sf_dir, "cells").where("reason_n = 0")
    m = c.groupBy("ilat", "ilon").agg(F.avg(1 / F.col("vel")).alias("m"))
    c = c.join(m, ["ilat", "ilon"]).withColumn("d", 1 / F.col("vel") - F.col("m"))
    # three sums a cell and bin go to the neighbours, not the rows
    own = c.groupBy("ilat", "ilon", F.floor((F.col("az") + 180) / 20).alias("bin")).agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    near = F.array(*(F.struct((F.col("ilat") + i).alias("ilat"), (F.col("ilon") + j).alias("ilon")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    e = own.select(F.explode(near).alias("k"), "bin", "n", "s", "ss").select("k.*", "bin", "n", "s", "ss").where("ilat between 0 and 9 and ilon between 0 and 9")
    g = e.groupBy("ilat", "ilon", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).where("n >= 2")
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    return g.select("ilat", "ilon", "bin", "n", F.round(F.col("s") / F.col("n"), 6).alias("slow"), F.round(spread / F.sqrt("n"), 6).alias("sem"))


@query("azimuth_fit", """with x as (select ilat, ilon, cos(2 * radians(az)) as c, sin(2 * radians(az)) as s, vel as y from cells where reason_n = 0),
  g as (select ilat, ilon, count(*) as n, cast(count(*) as double) as sw, sum(c) as sc, sum(s) as ss, sum(c * c) as scc, sum(c * s) as scs, sum(s * s) as sss, sum(y) as sy, sum(y * c) as syc, sum(y * s) as sys, sum(y * y) as syy from x group by all),
  d as (select *, sw * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss) + ss * (sc * scs - scc * ss) as det from g),
  f as (select *, (sy * (scc * sss - scs * scs) - sc * (syc * sss - scs * sys) + ss * (syc * scs - scc * sys)) / det as a0, (sw * (syc * sss - scs * sys) - sy * (sc * sss - scs * ss) + ss * (sc * sys - syc * ss)) / det as a,
   (sw * (scc * sys - syc * scs) - sc * (sc * sys - syc * ss) + sy * (sc * scs - scc * ss)) / det as b from d where abs(det) > 1e-9)
  select ilat, ilon, n, round(a0, 5) as a0, round(sqrt(a * a + b * b), 5) as amplitude, round(((degrees(atan2(b, a)) / 2) % 180 + 180) % 180, 3) as fast, round(sqrt(greatest(syy - a0 * sy - a * syc - b * sys, 0) / sw), 5) as misfit from f""")
def azimuth_fit(spark, sf_dir):
    c = table(spark, sf_dir, "cells").where("reason_n = 0").withColumn("weight", F.lit(1.0))
    x = stacks.azimuth_fit(c, ["ilat", "ilon"], "az", "vel")
    return x.select("ilat", "ilon", "n", F.round("a0", 5).alias("a0"), F.round("amplitude", 5).alias("amplitude"), F.round("fast", 3).alias("fast"), F.round("misfit", 5).alias("misfit"))


_BAZ = "b as (select sta_key, it, cast(floor(baz / 30) as bigint) as bin, count(*) as n, avg(amp) as amp, case when count(*) = 1 or stddev_pop(amp) < 1e-12 then 0.1 else stddev_pop(amp) / sqrt(count(*)) end as unc from rf group by all)"


def _baz_bins(spark, sf_dir):
    sd = F.stddev_pop("amp")
    g = table(spark, sf_dir, "rf").groupBy("sta_key", "it", F.floor(F.col("baz") / 30).alias("bin"))
    return g.agg(F.count("*").alias("n"), F.avg("amp").alias("amp"), F.when((F.count("*") == 1) | (sd < 1e-12), 0.1).otherwise(sd / F.sqrt(F.count("*"))).alias("unc"))


@query("back_azimuth_bins", f"with {_BAZ} select sta_key, it, bin, n, round(amp, 6) as amp, round(unc, 6) as unc from b")
def back_azimuth_bins(spark, sf_dir):
    return _baz_bins(spark, sf_dir).select("sta_key", "it", "bin", "n", F.round("amp", 6).alias("amp"), F.round("unc", 6).alias("unc"))


@query("bin_weighted_mean", f"with {_BAZ} select sta_key, it, round(sum(amp / unc) / sum(1 / unc), 6) as amp, count(*) as bins from b group by sta_key, it")
def bin_weighted_mean(spark, sf_dir):
    """Means of bins weighted by the inverse of their uncertainty, not of its square."""
    return _baz_bins(spark, sf_dir).groupBy("sta_key", "it").agg(F.round(F.sum(F.col("amp") / F.col("unc")) / F.sum(1 / F.col("unc")), 6).alias("amp"), F.count("*").alias("bins"))


@query("harmonic_strip", f"""with {_BAZ}, x as (select sta_key, it, cos(2 * radians(bin * 30 + 15)) as c, sin(2 * radians(bin * 30 + 15)) as s, amp as y, 1 / (unc * unc) as w from b),
  g as (select sta_key, it, count(*) as n, sum(w) as sw, sum(w * c) as sc, sum(w * s) as ss, sum(w * c * c) as scc, sum(w * c * s) as scs, sum(w * s * s) as sss, sum(w * y) as sy, sum(w * y * c) as syc, sum(w * y * s) as sys, sum(w * y * y) as syy from x group by sta_key, it),
  d as (select *, sw * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss) + ss * (sc * scs - scc * ss) as det from g),
  f as (select *, (sy * (scc * sss - scs * scs) - sc * (syc * sss - scs * sys) + ss * (syc * scs - scc * sys)) / det as a0, (sw * (syc * sss - scs * sys) - sy * (sc * sss - scs * ss) + ss * (sc * sys - syc * ss)) / det as a,
   (sw * (scc * sys - syc * scs) - sc * (sc * sys - syc * ss) + sy * (sc * scs - scc * ss)) / det as b from d where n >= 6 and abs(det) > 1e-6 * sw * sw * sw)
  select sta_key, it, n, round(a0, 5) as a0, round(sqrt(a * a + b * b), 5) as amplitude, round(sqrt(greatest(syy - a0 * sy - a * syc - b * sys, 0) / sw), 4) as misfit from f""")
def harmonic_strip(spark, sf_dir):
    """Constant and two-lobed parts of receiver functions by station and sample, with weights 1 / unc ** 2."""
    b = _baz_bins(spark, sf_dir).select("sta_key", "it", (F.col("bin") * 30.0 + 15).alias("psi"), F.col("amp").alias("value"), (1 / (F.col("unc") * F.col("unc"))).alias("weight"))
    x = stacks.azimuth_fit(b, ["sta_key", "it"], least=6, regular=1e-6)
    return x.select("sta_key", "it", "n", F.round("a0", 5).alias("a0"), F.round("amplitude", 5).alias("amplitude"), F.round("misfit", 4).alias("misfit"))


@query("ensemble_statistics", """select grid, count(*) as n, round(min(misfit), 6) as least, min_by(isample, misfit * 1e9 + isample) as best, round(avg(p0), 6) as mean0, round(median(p1), 6) as median1, round(stddev_pop(p0), 6) as sd0,
  round(avg(p2) - sqrt(2) * stddev_pop(p2), 3) as low2, round(avg(p2) + sqrt(2) * stddev_pop(p2), 3) as high2 from ensemble where acc = 1 group by grid""")
def ensemble_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "ensemble").where("acc = 1")
    return e.groupBy("grid").agg(
        F.count("*").alias("n"), F.round(F.min("misfit"), 6).alias("least"), F.min_by("isample", F.col("misfit") * 1e9 + F.col("isample")).alias("best"), F.round(F.avg("p0"), 6).alias("mean0"), F.round(F.median("p1"), 6).alias("median1"), F.round(F.stddev_pop("p0"), 6).alias("sd0"),
        F.round(F.avg("p2") - F.sqrt(F.lit(2.0)) * F.stddev_pop("p2"), 3).alias("low2"), F.round(F.avg("p2") + F.sqrt(F.lit(2.0)) * F.stddev_pop("p2"), 3).alias("high2"),
    )


@query("posterior_histogram", "select grid, cast(floor(misfit * 20 + 1e-9) as bigint) as bin, count(*) as n from ensemble where acc = 1 group by all")
def posterior_histogram(spark, sf_dir):
    return table(spark, sf_dir, "ensemble").where("acc = 1").groupBy("grid", F.floor(F.col("misfit") * 20 + 1e-9).alias("bin")).agg(F.count("*").alias("n"))


@query("area_weighted_mean", "with m as (select sum(vel * abs(cos(radians(55 + ilat)))) / sum(abs(cos(radians(55 + ilat)))) as mean from cells) select ilat, ilon, round((avg(vel) / min(mean) - 1) * 100, 5) as percent from cells cross join m group by ilat, ilon")
def area_weighted_mean(spark, sf_dir):
    """Each cell's deviation in percent from the mean that latitudes weigh by area."""
    c = table(spark, sf_dir, "cells")
    w = F.abs(F.cos(F.radians(F.col("ilat") + 55)))
    mean = c.agg((F.sum(F.col("vel") * w) / F.sum(w)).alias("mean"))
    return c.groupBy("ilat", "ilon").agg(F.avg("vel").alias("v")).crossJoin(F.broadcast(mean)).select("ilat", "ilon", F.round((F.col("v") / F.col("mean") - 1) * 100, 5).alias("percent"))


@query("subset_misfit", "select grid, round(sqrt(avg(case when p0 <= 0.03 then misfit * misfit end)), 6) as low, round(sqrt(avg(case when p0 > 0.03 and p0 < 0.07 then misfit * misfit end)), 6) as mid, round(sqrt(avg(case when p0 >= 0.07 then misfit * misfit end)), 6) as high from ensemble group by grid")
def subset_misfit(spark, sf_dir):
    rms = lambda c: F.round(F.sqrt(F.avg(F.when(F.expr(c), F.col("misfit") * F.col("misfit")))), 6)
    return table(spark, sf_dir, "ensemble").groupBy("grid").agg(rms("p0 <= 0.03D").alias("low"), rms("p0 > 0.03D and p0 < 0.07D").alias("mid"), rms("p0 >= 0.07D").alias("high"))


@query("likelihood", "with s as (select grid, isample, power((p0 - 0.05) / 0.02, 2) + power((p1 - 0.04) / 0.01, 2) as s from ensemble) select grid, isample, round(sqrt(s / 2), 6) as misfit, round(exp(-0.5 * case when s > 50 then sqrt(50 * s) else s end), 9) as l from s")
def likelihood(spark, sf_dir):
    """Misfit and likelihood of two observations; sums of squares over 50 grow by the root only."""
    s = F.pow((F.col("p0") - 0.05) / 0.02, 2) + F.pow((F.col("p1") - 0.04) / 0.01, 2)
    x = table(spark, sf_dir, "ensemble").select("grid", "isample", s.alias("s"))
    return x.select("grid", "isample", F.round(F.sqrt(F.col("s") / 2), 6).alias("misfit"), F.round(F.exp(-0.5 * F.when(F.col("s") > 50, F.sqrt(50 * F.col("s"))).otherwise(F.col("s"))), 9).alias("l"))


@query("love_parameters", """with m as (select grid, isample, 2.7 + p1 as rho, 5.8 + p0 as vph, 5.7 + p1 as vpv, 3.3 + p0 as vsv, 3.4 + p1 as vsh, 0.9 + p0 as eta from ensemble)
  select grid, isample, round(rho * vph * vph, 6) as a, round(rho * vpv * vpv, 6) as c, round(rho * vsv * vsv, 6) as l, round(rho * vsh * vsh, 6) as n, round(eta * (rho * vph * vph - 2 * rho * vsv * vsv), 6) as f from m""")
def love_parameters(spark, sf_dir):
    m = table(spark, sf_dir, "ensemble").selectExpr("grid", "isample", "2.7D + p1 as rho", "5.8D + p0 as vph", "5.7D + p1 as vpv", "3.3D + p0 as vsv", "3.4D + p1 as vsh", "0.9D + p0 as eta")
    return m.selectExpr("grid", "isample", "round(rho * vph * vph, 6) as a", "round(rho * vpv * vpv, 6) as c", "round(rho * vsv * vsv, 6) as l", "round(rho * vsh * vsh, 6) as n", "round(eta * (rho * vph * vph - 2 * rho * vsv * vsv), 6) as f")


@query("lag_symmetric", "select sta_key, day, round(list_sum(list_transform(range(0, 32), lambda i: (cast(data[32 + i] as double) + data[32 - i]) / 2 * (i + 1))), 5) as moment from (select sta_key, day, data[1:63] as data from traces) t")
def lag_symmetric(spark, sf_dir):
    """The mean of both sides of a trace of 63 lags, told by its first moment."""
    t = table(spark, sf_dir, "traces").select("sta_key", "day", F.slice(F.col("data").cast("array<double>"), 1, 63).alias("data"))
    s = t.withColumn("s", arrays.symmetric(F.col("data")))
    return s.select("sta_key", "day", F.round(arrays.total(F.transform("s", lambda x, i: x * (i + 1))), 5).alias("moment"))
