"""Queries with windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspark.sources.fixtures import table

from .registry import curves_by_pair, query


@query("running_minimum", "select grid, isample, min(misfit) over (partition by grid order by isample, misfit rows unbounded preceding) as least from ensemble")
def running_minimum(spark, sf_dir):
    w = Window.partitionBy("grid").orderBy("isample", "misfit").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "ensemble").select("grid", "isample", F.min("misfit").over(w).alias("least"))


_CURVE = "k as (select sta1, sta2, period, round(avg(c), 6) as c from curves group by all)"
def _pair():
    return Window.partitionBy("sta1", "sta2").orderBy("period")


def _curves(spark, sf_dir):
    return curves_by_pair(spark, sf_dir, "period", "c").groupBy("sta1", "sta2", "period").agg(F.round(F.avg("c"), 6).alias("c"))


_JUMPS = f"""with {_CURVE}, n as (select *, lag(period) over w as p0, lag(c) over w as c0, lead(period) over w as p1, lead(c) over w as c1 from k window w as (partition by sta1, sta2 order by period)),
  d as (select sta1, sta2, period, c, ((c1 - c) / (p1 - period) - (c - c0) / (period - p0)) / ((p1 - p0) / 2) * 100 as bend from n),
  j as (select sta1, sta2, period, case when bend > 40 then 1 when bend < -40 then -1 else 0 end as jump from d)"""


def jumps(curves, threshold: float):
    """Sign of the second difference at uneven spacing, times 100, where it is beyond threshold; 0 elsewhere and at the ends."""
    x = curves.withColumns({"p0": F.lag("period").over(_pair()), "c0": F.lag("c").over(_pair()), "p1": F.lead("period").over(_pair()), "c1": F.lead("c").over(_pair())})
    bend = ((F.col("c1") - F.col("c")) / (F.col("p1") - F.col("period")) - (F.col("c") - F.col("c0")) / (F.col("period") - F.col("p0"))) / ((F.col("p1") - F.col("p0")) / 2) * 100
    return x.select("sta1", "sta2", "period", F.when(bend > threshold, 1).when(bend < -threshold, -1).otherwise(0).alias("jump"))


@query("curve_jumps", _JUMPS + " select sta1, sta2, period, jump from j")
def curve_jumps(spark, sf_dir):
    return jumps(_curves(spark, sf_dir), 40.0)


@query("longest_smooth_segment", _JUMPS + """, s as (select *, sum(abs(jump)) over (partition by sta1, sta2 order by period rows unbounded preceding) as island from j),
  g as (select sta1, sta2, island, min(period) as first, max(period) as last, count(*) as n from s where jump = 0 group by sta1, sta2, island),
  r as (select *, row_number() over (partition by sta1, sta2 order by n desc, first) as k from g) select sta1, sta2, first, last, n from r where k = 1""")
def longest_smooth_segment(spark, sf_dir):
    """The longest run of periods without a jump; of equal ones the first."""
    s = jumps(_curves(spark, sf_dir), 40.0).withColumn("island", F.sum(F.abs("jump")).over(_pair().rowsBetween(Window.unboundedPreceding, 0)))
    g = s.where("jump = 0").groupBy("sta1", "sta2", "island").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("n"))
    best = g.groupBy("sta1", "sta2").agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("sta1", "sta2", "b.*")


#: Runs of hours in which a station has records, in SQL.
RUNS = """hr as (select distinct user_id, date_diff('hour', timestamp '2024-01-01', ts) as h from events), hi as (select user_id, h, h - row_number() over (partition by user_id order by h) as g from hr),
  runs as (select user_id, cast(min(h) as bigint) as h0, cast(max(h) as bigint) as h1, count(*) as n from hi group by user_id, g)"""


def hour_runs(spark, sf_dir):
    h = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    e = table(spark, sf_dir, "events").select("user_id", h.cast("bigint").alias("h")).distinct()
    g = e.withColumn("g", F.col("h") - F.row_number().over(Window.partitionBy("user_id").orderBy("h")))
    return g.groupBy("user_id", "g").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.count("*").alias("n")).drop("g")


@query("record_runs", f"with {RUNS} select user_id, h0, h1, n from runs")
def record_runs(spark, sf_dir):
    """Runs of hours in which a station has records, ends included."""
    return hour_runs(spark, sf_dir)


@query("local_extrema", f"""with {_CURVE}, n as (select *, lag(c) over w as c0, lead(c) over w as c1 from k window w as (partition by sta1, sta2 order by period))
  select sta1, sta2, period, case when c > c0 and c > c1 then 1 else -1 end as kind from n where c > c0 and c > c1 or c < c0 and c < c1""")
def local_extrema(spark, sf_dir):
    x = _curves(spark, sf_dir).withColumns({"c0": F.lag("c").over(_pair()), "c1": F.lead("c").over(_pair())})
    return x.where("c > c0 and c > c1 or c < c0 and c < c1").select("sta1", "sta2", "period", F.when(F.expr("c > c0 and c > c1"), 1).otherwise(-1).alias("kind"))


_FIELD = "f as (select ilat, ilon, avg(vel) as v from cells group by all)"


def _field(spark, sf_dir):
    return table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.avg("vel").alias("v"))


@query("neighbour_flags", "with b as (select ilat, ilon, bool_or(reason_n = 1 and vel > 4.45) as bad from cells group by all) select a.ilat, a.ilon, a.bad or coalesce(bool_or(n.bad), false) as flagged from b a left join b n on abs(a.ilat - n.ilat) + abs(a.ilon - n.ilon) = 1 group by a.ilat, a.ilon, a.bad")
def neighbour_flags(spark, sf_dir):
    """Bad cells grown by their four neighbours: each cell tells its neighbours, an equi-grouping instead of a distance join."""
    b = table(spark, sf_dir, "cells").groupBy("ilat", "ilon").agg(F.bool_or(F.expr("reason_n = 1 and vel > 4.45")).alias("bad"))
    told = b.select(F.explode(F.array(*(F.struct((F.col("ilat") + i).alias("ilat"), (F.col("ilon") + j).alias("ilon"), F.col("bad"), F.lit(not (i or j)).alias("own")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))).alias("t")).select("t.*")
    return told.groupBy("ilat", "ilon").agg(F.bool_or("bad").alias("flagged"), F.bool_or("own").alias("own")).where("own").drop("own")


@query("field_gradient", f"""with {_FIELD}, g as (select ilat, ilon, v, lag(v) over x as w, lead(v) over x as e, lag(v) over y as s, lead(v) over y as n from f
  window x as (partition by ilat order by ilon), y as (partition by ilon order by ilat))
  select ilat, ilon, round((e - w) / 2, 6) as dx, round((n - s) / 2, 6) as dy, round(degrees(atan2((n - s) / 2, (e - w) / 2)), 4) as angle, round(e + w + n + s - 4 * v, 6) as laplacian from g where e is not null and w is not null and n is not null and s is not null""")
def field_gradient(spark, sf_dir):
    """Central differences, their direction, and the five-point Laplacian of the inner cells."""
    x, y = Window.partitionBy("ilat").orderBy("ilon"), Window.partitionBy("ilon").orderBy("ilat")
    g = _field(spark, sf_dir).withColumns({"w": F.lag("v").over(x), "e": F.lead("v").over(x), "s": F.lag("v").over(y), "n": F.lead("v").over(y)}).dropna()
    return g.selectExpr("ilat", "ilon", "round((e - w) / 2, 6) as dx", "round((n - s) / 2, 6) as dy", "round(degrees(atan2((n - s) / 2, (e - w) / 2)), 4) as angle", "round(e + w + n + s - 4 * v, 6) as laplacian")


@query("sliding_windows", "select sta_key, day, i as at, round(list_sum(list_transform(data[i + 1 : i + 16], lambda x: cast(x as double) * x)), 6) as energy from traces cross join (select unnest([0, 8, 16, 24, 32, 40, 48]) as i) k")
def sliding_windows(spark, sf_dir):
    """Energy of windows of 16 samples that overlap by half."""
    x = table(spark, sf_dir, "traces").withColumn("at", F.explode(F.sequence(F.lit(0), F.size("data") - 16, F.lit(8))))
    part = F.slice(F.col("data").cast("array<double>"), F.col("at") + 1, F.lit(16))
    return x.select("sta_key", "day", "at", F.round(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"))


@query("dispersion_sanity", f"""with {_CURVE}, n as (select *, lag(c) over (partition by sta1, sta2 order by period) as c0 from k)
  select sta1, sta2, count(*) as n, bool_and(c >= coalesce(c0, c)) as rising, round(max(abs(c / c0 - 1)) * 100, 6) as max_percent from n group by sta1, sta2""")
def dispersion_sanity(spark, sf_dir):
    x = _curves(spark, sf_dir).withColumn("c0", F.lag("c").over(_pair()))
    return x.groupBy("sta1", "sta2").agg(F.count("*").alias("n"), F.bool_and(F.expr("c >= coalesce(c0, c)")).alias("rising"), F.round(F.max(F.abs(F.col("c") / F.col("c0") - 1)) * 100, 6).alias("max_percent"))


@query("depth_from_thickness", "select grid, isample, round(sum(p0 + 0.1) over (partition by grid order by isample, p0 rows unbounded preceding), 6) as depth from ensemble where acc = 1")
def depth_from_thickness(spark, sf_dir):
    w = Window.partitionBy("grid").orderBy("isample", "p0").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "ensemble").where("acc = 1").select("grid", "isample", F.round(F.sum(F.col("p0") + 0.1).over(w), 6).alias("depth"))
