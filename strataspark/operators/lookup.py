"""Lookups of correlations, nodes of grids and tables, and merges of what two sources have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.operators.pairs import nearest_within


def correlations(known: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(a, b) with what known(sta1 < sta2, data, ...) has for the pair: reversed is 1 and data turned round where a > b; null if unknown."""
    r = requests.withColumns({"sta1": F.least("a", "b"), "sta2": F.greatest("a", "b"), "reversed": (F.col("a") > F.col("b")).cast("int")})
    x = r.join(known, ["sta1", "sta2"], "left")
    return x.withColumn("data", F.when(F.col("reversed") == 1, F.reverse("data")).otherwise(F.col("data"))).drop("sta1", "sta2")


def merge_curves(direct: DataFrame, three: DataFrame, clearer: float) -> DataFrame:
    """sta1, sta2, period, c and kind (2 or 3) of two curve tables(sta1, sta2, period, c, snr): the direct value, or the three-station one where that is missing or its snr is over clearer times as large."""
    keys = ["sta1", "sta2", "period"]
    x = direct.select(*keys, F.col("c").alias("c2"), F.col("snr").alias("s2")).join(three.select(*keys, F.col("c").alias("c3"), F.col("snr").alias("s3")), keys, "full_outer")
    own = F.col("c2").isNotNull() & ~F.coalesce(F.col("s3") > clearer * F.col("s2"), F.lit(False))
    return x.select(*keys, F.when(own, F.col("c2")).otherwise(F.col("c3")).alias("c"), F.when(own, 2).otherwise(3).alias("kind"))


def grid_curves(values: DataFrame, keys: list[str], factor: float, least: int) -> DataFrame:
    """keys and curve, an array of (period, c, unc, psi_unc) by period, from values(period, vel, az): errors of means times factor, those of directions 90 at most."""
    n = F.count("*")
    g = values.groupBy(*keys, "period").agg(n.alias("n"), F.avg("vel").alias("c"), (factor * F.stddev_pop("vel") / F.sqrt(n)).alias("unc"), F.least(F.lit(90.0), 20 * F.stddev_pop("az") / F.sqrt(n)).alias("psi_unc")).where(F.col("n") >= least)
    return g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", "c", "unc", "psi_unc"))).alias("curve"))


def directional_node(points: DataFrame, nodes: DataFrame, step: float = 1.0) -> DataFrame:
    """points(lon, lat, ...) with the columns of the node(lon, lat, ...) that is the first at or beyond them in both directions; an equi-join on the grid's keys."""
    key = lambda c: F.ceil(F.col(c) / step)
    p = points.withColumns({"_x": key("lon"), "_y": key("lat")})
    n = nodes.withColumns({"_x": key("lon"), "_y": key("lat")}).drop("lon", "lat")
    return p.join(n, ["_x", "_y"], "left").drop("_x", "_y")


def on_grid(values: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every (ilat, ilon) of a grid with the columns of values, null where it has none."""
    spark = values.sparkSession
    g = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("ilat"), (F.col("id") % columns).alias("ilon"))
    return g.join(values, ["ilat", "ilon"], "left")


def nearest_node(nodes: list[float], at: Column) -> Column:
    """The place of the nearest of a short list of ascending nodes, the lower of two as near."""
    return F.array_min(F.array(*(F.struct(F.abs(at - z).alias("d"), F.lit(k).alias("k")) for k, z in enumerate(nodes))))["k"]


def bilinear(points: DataFrame, nodes: DataFrame, x: str, y: str, dx: float, dy: float, value: str) -> DataFrame:
    """points with value between the nodes(x, y, value) of a regular table; points beyond it are dropped. Four nodes a point by one equi-join."""
    i, j = F.floor(F.col(x) / dx), F.floor(F.col(y) / dy)
    corners = F.array(*(F.struct((i + a).alias("_i"), (j + b).alias("_j"), (F.abs(1 - a - (F.col(x) / dx - i)) * F.abs(1 - b - (F.col(y) / dy - j))).alias("_w")) for a in (0, 1) for b in (0, 1)))
    p = points.withColumn("_c", F.explode(corners)).select(*points.columns, "_c.*")
    n = nodes.select(F.round(F.col(x) / dx).cast("bigint").alias("_i"), F.round(F.col(y) / dy).cast("bigint").alias("_j"), F.col(value).alias("_v"))
    g = p.join(n, ["_i", "_j"]).groupBy(*points.columns).agg(F.sum(F.col("_w") * F.col("_v")).alias(value), F.count("*").alias("_n"))
    return g.where("_n % 4 = 0").withColumn(value, F.col(value) / (F.col("_n") / 4)).drop("_n")


def blend(grid: DataFrame, stations: DataFrame, max_km: float, box_deg: float) -> DataFrame:
    """grid(pid, lon, lat, v) with sid and v of the nearest of stations(sid, lon_r, lat_r, sv) within max_km mixed in: v * d / max_km + sv * (1 - d / max_km)."""
    near = nearest_within(grid.select("pid", "lon", "lat"), stations.select("sid", "lon_r", "lat_r"), max_km, box_deg).join(stations.select("sid", "sv"), "sid")
    w = F.col("weight")
    return grid.select("pid", "v").join(near, "pid", "left").select("pid", "sid", F.coalesce(w * F.col("v") + (1 - w) * F.col("sv"), F.col("v")).alias("v"))


def smoothed_mask(cells: DataFrame, mask: str = "mask", every: bool = False) -> DataFrame:
    """ilat, ilon and mask on a grid of twice the density: points between cells take any (or all) of the two or four neighbours; those without all neighbours are dropped."""
    near = F.array(*(F.struct((2 * F.col("ilat") + a).alias("ilat"), (2 * F.col("ilon") + b).alias("ilon"), F.lit((a, b) == (0, 0)).alias("own"), F.lit(2 if 0 in (a, b) else 4).alias("want")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    x = cells.select(F.explode(near).alias("k"), F.col(mask).cast("boolean").alias("m")).select("k.*", "m")
    g = x.groupBy("ilat", "ilon").agg((F.bool_and if every else F.bool_or)("m").alias(mask), F.count("*").alias("n"), F.bool_or("own").alias("own"), F.max("want").alias("want"))
    return g.where("own or n = want").select("ilat", "ilon", F.col(mask).cast("int").alias(mask))


def blend_depths(grid: DataFrame, stations: DataFrame, max_km: float, box_deg: float) -> DataFrame:
    """pid, sid, sed and crust (thicknesses in km) of grid(pid, lon, lat, topo, sed, crust) with the nearest of stations(sid, lon_r, lat_r, topo_s, sed_s, crust_s) within max_km mixed in.

    What is mixed are the depths of the sediments' base and of the crust's below sea level, thicknesses less the height of the surface (km), since
    grid point and station lie at different heights. Where the mixed base would lie above the point's surface the sediments' thicknesses are mixed.
    """
    near = nearest_within(grid.select("pid", "lon", "lat"), stations.select("sid", "lon_r", "lat_r"), max_km, box_deg).join(stations.drop("lon_r", "lat_r"), "sid")
    mix = lambda a, b: F.col("weight") * a + (1 - F.col("weight")) * b
    c = {n: F.col(n) for n in ("topo", "sed", "crust", "topo_s", "sed_s", "crust_s")}
    base = mix(c["sed"] - c["topo"], c["sed_s"] - c["topo_s"])
    moho = mix(c["sed"] + c["crust"] - c["topo"], c["sed_s"] + c["crust_s"] - c["topo_s"])
    x = grid.select("pid", "topo", "sed", "crust").join(near, "pid", "left").withColumns({"_base": base, "_moho": moho})
    sed = F.when(F.col("_base") + F.col("topo") > 0, F.col("_base") + F.col("topo")).otherwise(mix(c["sed"], c["sed_s"]))
    return x.select("pid", "sid", F.coalesce(sed, "sed").alias("sed"), F.coalesce(F.col("_moho") - F.col("_base"), "crust").alias("crust"))
