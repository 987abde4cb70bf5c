"""Queries on curves and model parameters: trimmed statistics, smoothing, timing, conversions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.operators import arrays, stacks
from strataspark.sources.fixtures import table

from .registry import curves_by_pair, query


@query("trimmed_curve_statistics", """with a as (select sta1, period, c, avg(c) over w as m, stddev_pop(c) over w as s from curves window w as (partition by sta1, period)),
  b as (select sta1, period, c from a where abs(c - m) <= 3 * s + 1e-9), y as (select sta1, period, c, avg(c) over (partition by sta1, period) as m from b),
  t as (select sta1, period, 100 / (100 / c - period * round((100 / c - 100 / m) / period)) as c from y), d as (select sta1, period, c, avg(c) over w as m, stddev_pop(c) over w as s from t window w as (partition by sta1, period)),
  e as (select sta1, period, c from d where abs(c - m) <= 2 * s + 1e-9)
  select sta1, period, count(*) as n, round(avg(c), 6) as mean, round(stddev_pop(c) * sqrt(count(*)) / count(*), 6) as uncertainty from e group by sta1, period having count(*) >= 3""")
def trimmed_curve_statistics(spark, sf_dir):
    """Means after values beyond three deviations are dropped, whole cycles over 100 km taken out, and values beyond two dropped; the uncertainty is the root of the squares' sum over n."""
    x = table(spark, sf_dir, "curves").select("sta1", "period", "c")
    x = stacks.trimmed(stacks.without_cycles(stacks.trimmed(x, ["sta1", "period"], "c", 3), ["sta1", "period"], "c", 100.0), ["sta1", "period"], "c", 2)
    n = F.count("*")
    return x.groupBy("sta1", "period").agg(n.alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c") * F.sqrt(n) / n, 6).alias("uncertainty")).where("n >= 3")


@query("smoothed_profile", """with k as (select sta1, sta2, period, round(avg(c), 6) as c from curves group by all)
  select sta1, sta2, period, round(avg(c) over (partition by sta1, sta2 order by period range between 2 preceding and 2 following), 5) as c from k""")
def smoothed_profile(spark, sf_dir):
    """Moving means over two units to either side of the depth or period."""
    k = curves_by_pair(spark, sf_dir, "period", "c").groupBy("sta1", "sta2", "period").agg(F.round(F.avg("c"), 6).alias("c"))
    w = Window.partitionBy("sta1", "sta2").orderBy("period").rangeBetween(-2, 2)
    return k.select("sta1", "sta2", "period", F.round(F.avg("c").over(w), 5).alias("c"))


@query("timing_asymmetry", """with t as (select sta_key, day, list_transform(data[32:63], lambda x: cast(x as double)) as p, list_reverse(list_transform(data[1:32], lambda x: cast(x as double))) as n from traces),
  s as (select *, list_max(p) / sqrt(list_sum(list_transform(p, lambda x: x * x)) / 32) as sp, list_max(n) / sqrt(list_sum(list_transform(n, lambda x: x * x)) / 32) as sn from t)
  select sta_key, day, cast(list_position(p, list_max(p)) - 1 as int) as positive, cast(list_position(n, list_max(n)) - 1 as int) as negative, round(list_max(p) / list_max(n), 5) as ratio from s where least(sp, sn) >= 1.8""")
def timing_asymmetry(spark, sf_dir):
    """Lags of the largest values on both sides of a two-sided trace of 63 samples, where both stand out of their side's mean square."""
    d = F.col("data").cast("array<double>")
    t = table(spark, sf_dir, "traces").select("sta_key", "day", F.slice(d, 32, 32).alias("p"), F.reverse(F.slice(d, 1, 32)).alias("n"))
    clear = lambda c: F.array_max(c) / arrays.rms(F.col(c))
    at = lambda c: (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")
    t = t.where(F.least(clear("p"), clear("n")) >= 1.8)
    return t.select("sta_key", "day", at("p").alias("positive"), at("n").alias("negative"), F.round(F.array_max("p") / F.array_max("n"), 5).alias("ratio"))


@query("density_from_velocity", """with m as (select grid, isample, cast(3.0 as double) + 20 * p0 as vs from ensemble) select grid, isample, round(case when vs < 4.0 then 0.541 + 0.3601 * (vs * 1.75) else 3.4268 + (vs - 4.5) / 4.5 end, 6) as rho from m""")
def density_from_velocity(spark, sf_dir):
    """Crustal densities from vp = 1.75 vs, mantle ones from vs."""
    vs = F.lit(3.0) + 20 * F.col("p0")
    return table(spark, sf_dir, "ensemble").select("grid", "isample", F.round(F.when(vs < 4.0, 0.541 + 0.3601 * (vs * 1.75)).otherwise(3.4268 + (vs - 4.5) / 4.5), 6).alias("rho"))


@query("azimuthal_parameters", """with m as (select grid, isample, p0 - 0.05 as gc, p1 - 0.035 as gs from ensemble)
  select grid, isample, round(((degrees(atan2(gs, gc)) / 2) % 180 + 180) % 180, 4) as fast, round(sqrt(gs * gs + gc * gc) / 2 * 100, 6) as amplitude,
  round(degrees(sqrt(power(gc * 0.01, 2) + power(gs * 0.01, 2)) / (2 * (gs * gs + gc * gc))), 5) as fast_unc from m""")
def azimuthal_parameters(spark, sf_dir):
    """Fast direction and strength of azimuthal anisotropy from its cosine and sine terms, with the direction's propagated error."""
    m = table(spark, sf_dir, "ensemble").select("grid", "isample", (F.col("p0") - 0.05).alias("gc"), (F.col("p1") - 0.035).alias("gs"))
    return m.selectExpr("grid", "isample", "round(pmod(degrees(atan2(gs, gc)) / 2, 180D), 4) as fast", "round(sqrt(gs * gs + gc * gc) / 2 * 100, 6) as amplitude", "round(degrees(sqrt(power(gc * 0.01D, 2) + power(gs * 0.01D, 2)) / (2 * (gs * gs + gc * gc))), 5) as fast_unc")


@query("kernel_perturbation", "select sta_key, day, round(list_sum(list_transform(range(1, 65), lambda i: cast(data[i] as double) * exp(-cast(i as double) / 16) * 0.01)), 6) as change from traces")
def kernel_perturbation(spark, sf_dir):
    """First-order change of a velocity: the product of a sensitivity kernel and a model change, summed over depth."""
    k = F.transform(F.col("data").cast("array<double>"), lambda x, i: x * F.exp(-(i + 1).cast("double") / 16) * 0.01)
    return table(spark, sf_dir, "traces").select("sta_key", "day", F.round(F.aggregate(k, F.lit(0.0), lambda a, x: a + x), 6).alias("change"))


@query("network_codes", """select staid, case when length(split_part(staid, '.', 1)) < 2 then lpad(split_part(staid, '.', 1), 2, '0') else split_part(staid, '.', 1) end as net, split_part(staid, '.', 2) as sta,
  case when lon < -180 then lon + 360 when lon >= 180 then lon - 360 else lon end as lon180, round((lon + 360) % 360, 6) as lon360 from stations""")
def network_codes(spark, sf_dir):
    """Codes of networks and stations from their ids, one-letter networks with a leading 0, and longitudes in both conventions."""
    net = F.split_part("staid", F.lit("."), F.lit(1))
    return table(spark, sf_dir, "stations").select(
        "staid", F.when(F.length(net) < 2, F.lpad(net, 2, "0")).otherwise(net).alias("net"), F.split_part("staid", F.lit("."), F.lit(2)).alias("sta"),
        F.when(F.col("lon") < -180, F.col("lon") + 360).when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon180"), F.round((F.col("lon") + 360) % 360, 6).alias("lon360"),
    )
