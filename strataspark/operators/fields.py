"""Fields and maps as DataFrames: grids, sampling along great circles, averages, coverage, smoothing and curvature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.operators.tomography import path_sums


def grid(spark: SparkSession, lat0: float, lon0: float, step: float, rows: int, columns: int) -> DataFrame:
    """ilat, ilon, lat and lon of a regular grid."""
    g = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("ilat"), (F.col("id") % columns).cast("int").alias("ilon"))
    return g.withColumns({"lat": lat0 + step * F.col("ilat"), "lon": lon0 + step * F.col("ilon")})


def checkerboard(g: DataFrame, v0: float, dv: float, width: float, height: float, lon0: float, lat0: float) -> DataFrame:
    """g(lat, lon) with v, which swings by dv around v0 over fields of width by height degrees."""
    pi = F.lit(math.pi)
    return g.withColumn("v", v0 + dv * F.sin(pi * (F.col("lon") - lon0) / width) * F.sin(pi * (F.col("lat") - lat0) / height))


def sampled(paths: DataFrame, n: int) -> DataFrame:
    """paths(lon, lat, lon2, lat2, ...) with dist in km, and k, lon and lat of n midpoints along the great circle of each; ends that are the same or opposite give nulls.

    What is a path's is computed before its points are made, each step in a column of its own: as one expression it would be worked out anew for every use.
    """
    keep = [c for c in paths.columns if c not in ("lon", "lat", "lon2", "lat2")]
    ends = (*geo.cartesian(F.col("lon"), F.col("lat"), F.lit(1.0)), *geo.cartesian(F.col("lon2"), F.col("lat2"), F.lit(1.0)))
    p = paths.select(*keep, *(c.alias(f"_{k}{i}") for c, (i, k) in zip(ends, [(i, k) for i in (1, 2) for k in "xyz"], strict=True)))
    p = p.withColumn("_d", F.expr("acos(greatest(-1.0D, least(1.0D, _x1 * _x2 + _y1 * _y2 + _z1 * _z2)))")).withColumn("_sin", F.expr("nullif(sin(_d), 0.0D)"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_s", (F.col("k") + 0.5) / n)
    p = p.withColumns({"_a": F.expr("sin((1 - _s) * _d) / _sin"), "_b": F.expr("sin(_s * _d) / _sin")}).withColumns({f"_{c}": F.expr(f"_a * _{c}1 + _b * _{c}2") for c in "xyz"})
    lon, lat = F.degrees(F.atan2("_y", "_x")), F.degrees(F.atan2(F.col("_z"), F.sqrt(F.expr("_x * _x + _y * _y"))))
    return p.select(*keep, (geo.RADIUS * F.col("_d")).alias("dist"), "k", lon.alias("lon"), lat.alias("lat"))


def path_average(points: DataFrame, cells: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """keys, velocity (the inverse of the mean slowness) and cells of points(lon, lat) in cells(cx, cy, c); points are counted by path and cell before the join."""
    n = points.groupBy(*keys, F.floor(F.col("lon") / step).alias("cx"), F.floor(F.col("lat") / step).alias("cy")).agg(F.count("*").alias("n"))
    return n.join(cells, ["cx", "cy"]).groupBy(*keys).agg((F.sum("n") / F.sum(F.col("n") / F.col("c"))).alias("velocity"), F.count("*").alias("cells"))


def azimuth_coverage(rays: DataFrame, samples: int, cell: float, bins: int = 10) -> DataFrame:
    """cell_x, cell_y, hits, bins, spread and evenness of straight rays(x1, y1, x2, y2, n) by azimuth; n counts the rays of a row.

    spread is the sum of hits over the fullest bin's, in degrees of its width; evenness the squared sum over the sum of
    squares, 0 for under five hits.
    """
    width = 180.0 / bins
    az = F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(180.0))
    binned = rays.withColumn("bin", (F.floor(az / width + 1e-9) % bins).cast("int"))
    h = path_sums(binned, samples, cell, by=("bin",)).withColumnRenamed("rays", "n")
    total = F.sum("n")
    return h.groupBy("cell_x", "cell_y").agg(total.alias("hits"), F.count("*").alias("bins"), (total / F.max("n") * width).alias("spread"), F.when(total > 4.5, F.pow(total, 2) / F.sum(F.col("n") * F.col("n"))).otherwise(0.0).alias("evenness"))


def gaussian(m: DataFrame, value: str, sigma: float, reach: int) -> DataFrame:
    """m(ilat, ilon, value) smoothed by a Gaussian of sigma cells, cut off at reach in each direction: every cell gives its share to those around it."""
    near = F.array(*(F.struct((F.col("ilat") + i).alias("ilat"), (F.col("ilon") + j).alias("ilon"), F.lit(math.exp(-(i * i + j * j) / (2 * sigma * sigma))).alias("w")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    g = m.select(F.explode(near).alias("k"), F.col(value).alias("_v")).select("k.*", "_v").groupBy("ilat", "ilon").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
    return g.join(m.select("ilat", "ilon"), ["ilat", "ilon"], "left_semi")


def curvature(m: DataFrame, value: str, most: float) -> DataFrame:
    """m(ilat, ilon, value) with curvature, the sum of second differences in both directions, and reason (4 edge, 6 over most, else 0)."""
    y, x = Window.partitionBy("ilon").orderBy("ilat"), Window.partitionBy("ilat").orderBy("ilon")
    c = m.withColumn("curvature", F.lag(value).over(y) + F.lead(value).over(y) + F.lag(value).over(x) + F.lead(value).over(x) - 4 * F.col(value))
    return c.withColumn("reason", F.when(F.col("curvature").isNull(), 4).when(F.abs("curvature") > most, 6).otherwise(0))


def reasons(bend: Column, most: float, unsteady: Column, lonely: Column, slowness: Column, lowest: float, highest: float, close: Column) -> Column:
    """The reason why a cell doesn't count, 0 for none; bend (curvature, null at an edge) is tried first and so overrides the others."""
    by = F.when(F.abs(F.coalesce(bend, F.lit(0.0))) > most, 6).when(unsteady, 1).when(lonely, 2)
    return by.when((slowness < lowest) | (slowness > highest), 3).when(bend.isNull(), 4).when(close, 5).otherwise(0)


def residuals(segments: DataFrame, cells: DataFrame, times: DataFrame) -> DataFrame:
    """ray, t and residual, observed minus predicted, of segments(ray, cell_x, cell_y, length) through cells(cell_x, cell_y, c) and times(ray, t)."""
    p = segments.join(cells, ["cell_x", "cell_y"]).groupBy("ray").agg(F.sum(F.col("length") / F.col("c")).alias("p"))
    return times.join(p, "ray").select("ray", "t", (F.col("t") - F.col("p")).alias("residual"))


def belts(spark: SparkSession, step: float) -> DataFrame:
    """belt, place, lat, lon and area (km2) of cells of nearly equal area: belts of step degrees, each cut into as many cells as its circle allows."""
    k = spark.range(int(180 / step)).select(F.col("id").cast("int").alias("belt"), (F.lit(-90.0) + step * F.col("id")).alias("south"))
    n = F.least(F.lit(int(360 / step)), F.greatest(F.lit(2), F.round(360 * F.cos(F.radians(F.col("south") + step / 2)) / step).cast("int")))
    c = k.withColumn("n", n).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    area = F.lit(geo.RADIUS**2 * 2 * math.pi) / F.col("n") * (F.sin(F.radians(F.col("south") + step)) - F.sin(F.radians("south")))
    return c.select("belt", "place", (F.col("south") + step / 2).alias("lat"), ((F.col("place") + 0.5) * 360 / F.col("n")).alias("lon"), area.alias("area"))
