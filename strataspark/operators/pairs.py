"""Joins of stations, sources, curves and grid points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.geo import RADIUS, distance_km
from strataspark.operators.iteration import cut


def station_pairs(stations: DataFrame) -> DataFrame:
    """Ordered pairs sta1 < sta2 by id whose deployments overlap, with both positions.

    A join on an inequality; stations are a catalog of bounded size, pairs grow with its square by nature.
    """
    a = stations.select(*(F.col(c).alias(f"{c}1") for c in ("staid", "lon", "lat", "start_day", "end_day")))
    b = stations.select(*(F.col(c).alias(f"{c}2") for c in ("staid", "lon", "lat", "start_day", "end_day")))
    return a.join(b, (F.col("staid1") < F.col("staid2")) & (F.col("start_day1") <= F.col("end_day2")) & (F.col("start_day2") <= F.col("end_day1")))


def near_join(left: DataFrame, right: DataFrame, radius_deg: float, left_xy=("lon", "lat"), right_xy=("lon_r", "lat_r")) -> DataFrame:
    """Rows of both sides whose coordinates differ by radius_deg at most, by an equi-join on square buckets of that size.

    Each right row is put in its bucket, each left row looks in the nine around its own. Longitudes are the same after a
    full turn, so buckets wrap: the last one of a circle, which may be narrower, has one more to its side.
    """
    columns = int(-(-360.0 // radius_deg))
    turn = lambda c: F.pmod(F.col(c), F.lit(360.0))
    x, y = F.floor(turn(left_xy[0]) / radius_deg).cast("int"), F.floor(F.col(left_xy[1]) / radius_deg).cast("int")
    # two to each side in longitude where the circle's last bucket is narrower than the others
    reach = (-1, 0, 1) if abs(360.0 / radius_deg - columns) < 1e-9 else (-2, -1, 0, 1, 2)
    near = F.array_distinct(F.array(*(F.struct(F.pmod(x + i, F.lit(columns)).alias("i"), (y + j).alias("j")) for i in reach for j in (-1, 0, 1))))
    a = left.withColumn("_n", F.explode(near)).withColumns({"_bx": F.col("_n.i"), "_by": F.col("_n.j")}).drop("_n")
    b = right.withColumns({"_bx": F.floor(turn(right_xy[0]) / radius_deg).cast("int"), "_by": F.floor(F.col(right_xy[1]) / radius_deg).cast("int")})
    off = F.abs(turn(left_xy[0]) - turn(right_xy[0]))
    close = (F.least(off, 360 - off) <= radius_deg) & (F.abs(F.col(left_xy[1]) - F.col(right_xy[1])) <= radius_deg)
    return a.join(b, ["_bx", "_by"]).where(close).drop("_bx", "_by")


def nearest_within(points: DataFrame, stations: DataFrame, max_km: float, box_deg: float) -> DataFrame:
    """For each of points(pid, lon, lat) the nearest of stations(sid, lon_r, lat_r) within max_km, with its blending weight d / max_km.

    box_deg is the bucket size and must span max_km in both directions. Ties go to the smaller sid.
    """
    d = near_join(points, stations, box_deg).withColumn("d", distance_km(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r"))).where(F.col("d") <= max_km)
    return d.groupBy("pid").agg(F.min_by(F.struct("sid", "d"), F.struct(F.round("d", 6), "sid")).alias("n")).select("pid", "n.sid", "n.d", (F.col("n.d") / max_km).alias("weight"))


def nearest_other(points: DataFrame, key: str, apart_deg: float, box_deg: float) -> DataFrame:
    """key and d, the distance in km to the nearest of points(key, lon, lat) that is over apart_deg away in either direction.

    Boxes of box_deg first; points whose nearest may lie outside are looked up again in boxes of twice the size. Points
    without any other are left out.
    """
    others = points.select(F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"))
    left, found, size = points.select(key, "lon", "lat"), None, box_deg
    while True:
        off = (F.abs(F.col("lon") - F.col("lon_r")) > apart_deg) | (F.abs(F.col("lat") - F.col("lat_r")) > apart_deg)
        d = distance_km(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r"))
        near = near_join(left, others, size).where(off).groupBy(key, "lat").agg(F.min(d).alias("d"))
        # a box holds all within its size, less towards the poles
        held = F.radians(F.lit(size)) * RADIUS * F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(90.0))))
        last = size >= 180
        near = cut(near.where(F.lit(last) | (F.col("d") <= 0.99 * held)).select(key, "d"))
        found = near if found is None else found.union(near)
        left = cut(left.join(near, key, "left_anti"))
        if last or left.isEmpty():
            return found
        size = min(180.0, 2 * size)


def quadrants(points: DataFrame, others: DataFrame, max_km: float, box_deg: float, min_km: float = 1.0) -> DataFrame:
    """For each point the number of quadrants around it that hold another within min_km <= d < 2 * max_km."""
    d = near_join(points, others, box_deg).withColumn("d", distance_km(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r")))
    side = F.when(F.col("lon_r") < F.col("lon"), 0).otherwise(1) + 2 * F.when(F.col("lat_r") < F.col("lat"), 0).otherwise(1)
    return d.where((F.col("d") >= min_km) & (F.col("d") < 2 * max_km)).groupBy("pid").agg(F.count_distinct(side).alias("n_quadrants"))


def three_station(pairs: DataFrame, legs: DataFrame, alpha: float, min_difference: float) -> DataFrame:
    """Interferometry geometry: pairs(sta1, sta2, d0) with each source that legs(sta1, sta2, d) links to both ends.

    legs are looked up in either orientation. detour is the elliptic, hyper the hyperbolic path difference; sources whose
    differences are nearly equal, or that are outside the stationary zone min(detour, hyper) <= alpha * d0, are dropped.
    """
    both = legs.select(F.col("sta1").alias("sta"), F.col("sta2").alias("source"), "d").union(legs.select(F.col("sta2").alias("sta"), F.col("sta1").alias("source"), "d"))
    x = pairs.join(both.select(F.col("sta").alias("sta1"), "source", F.col("d").alias("d1")), "sta1").join(both.select(F.col("sta").alias("sta2"), "source", F.col("d").alias("d2")), ["sta2", "source"])
    x = x.withColumns({"hyper": F.col("d0") - F.abs(F.col("d1") - F.col("d2")), "detour": F.col("d1") + F.col("d2") - F.col("d0")})
    x = x.where((F.abs(F.col("hyper") - F.col("detour")) >= min_difference) & (F.least("hyper", "detour") <= alpha * F.col("d0")))
    return x.withColumns({"zone": F.when(F.col("detour") < F.col("hyper"), "ELL").otherwise("HYP"), "difference": F.when(F.col("detour") < F.col("hyper"), F.col("detour")).otherwise(-F.col("hyper"))})


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second whose keys it lacks, with borrowed 0 or 1."""
    return first.withColumn("borrowed", F.lit(0)).unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn("borrowed", F.lit(1)))


def event_windows(events: DataFrame, stations: DataFrame, vmin: float, vmax: float, bucket: int = 100) -> DataFrame:
    """Request window of each event at each station deployed then: distance over vmax to distance over vmin, in seconds.

    An equi-join on buckets of days: a station stands in each that its deployment touches, an event in its own.
    """
    e = events.withColumn("day", F.datediff(F.col("otime"), F.lit("1992-01-01").cast("date")) % 1000).withColumn("_b", F.floor(F.col("day") / bucket))
    s = stations.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_day") / bucket), F.floor(F.col("end_day") / bucket))))
    x = e.join(s, "_b").where("day >= start_day and day <= end_day").drop("_b")
    d = distance_km(F.col("evlo"), F.col("evla"), F.col("lon"), F.col("lat"))
    return x.withColumn("dist", d).withColumns({"begin_s": F.col("dist") / vmax, "end_s": F.col("dist") / vmin})


#: Positions of events and places of stations that a task compares.
EVENT_PLACES, STATION_PLACES = 1024, 2048


def event_distances(events: DataFrame, stations: DataFrame, unit: float = 1.0, within: tuple[float, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """evid, keep, n, near, far and total: of the distances in km of each event to the stations deployed then, their number, least, largest and sum; within counts those in a range of units.

    event_windows summed by event. A task has a block of the events' positions and one of the stations' places: a distance is taken once for two of these, and an event
    looks up how many stations each place had on its day, so no row an event and station is made.
    """
    x = events.withColumn("day", F.datediff(F.col("otime"), F.lit("1992-01-01").cast("date")) % 1000).select("evid", *keep, "day", *(F.col(c).cast("double").alias(c) for c in ("evlo", "evla")))
    many = lambda d, c, size: max(1, -(-d.select(*c).distinct().count() // size))
    ne, ns = many(x, ("evlo", "evla"), EVENT_PLACES), many(stations, ("lon", "lat"), STATION_PLACES)
    block = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = x.withColumns({"be": block(("evlo", "evla"), ne), "bs": every(ns)})
    b = stations.select("lon", "lat", "start_day", "end_day").withColumns({"bs": block(("lon", "lat"), ns), "be": every(ne)})
    kinds = dict(x.dtypes)

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(e) and len(s):
            at, place = np.unique(s[["lon", "lat"]].to_numpy(float), axis=0, return_inverse=True)
            place = place.ravel()
            sites, site = np.unique(e[["evlo", "evla"]].to_numpy(), axis=0, return_inverse=True)
            d = _distances(sites[:, 0], sites[:, 1], at)
            inside = (d / unit >= within[0]) & (d / unit <= within[1]) if within else np.ones(d.shape, bool)
            least, most, some = np.where(inside, d, np.inf), np.where(inside, d, -np.inf), np.where(inside, d, 0.0)
            one = inside.astype(float)
            first, last = s["start_day"].to_numpy(), s["end_day"].to_numpy()
            out = np.zeros((4, len(e)))
            for day, at_ in e.reset_index(drop=True).groupby("day").indices.items():
                there = np.bincount(place[(first <= day) & (day <= last)], minlength=len(at)).astype(float)
                # places without a station that day are out of reach
                off = np.where(there > 0, 0.0, np.inf)
                for k in range(0, len(at_), 1024):
                    rows = at_[k : k + 1024]
                    own = site.ravel()[rows]
                    out[:, rows] = one[own] @ there, (least[own] + off).min(axis=1), (most[own] - off).max(axis=1), some[own] @ there
            p = e[["evid", *keep]].assign(n=out[0].astype(np.int64), near=out[1], far=out[2], total=out[3])
            parts.append(p[p["n"] > 0])
        return pd.concat(parts) if parts else pd.DataFrame(columns=["evid", *keep, "n", "near", "far", "total"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("evid", *keep)) + ", n long, near double, far double, total double"
    tasks = min(2000, max(8, 2 * ne * ns))
    g = a.repartition(tasks, "be", "bs").groupBy("be", "bs").cogroup(b.repartition(tasks, "be", "bs").groupBy("be", "bs")).applyInPandas(run, schema)
    return g.groupBy("evid", *keep).agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"), F.sum("total").alias("total"))


def _distances(lon: np.ndarray, lat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """distance_km of every position to every one of at(lon, lat)."""
    o, a = np.radians(lon), np.radians(lat)
    p, b = np.radians(at[:, 0]), np.radians(at[:, 1])
    h = np.sin((b - a[:, None]) / 2) ** 2 + np.cos(a)[:, None] * np.cos(b) * np.sin((p - o[:, None]) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def nearest_earlier(points: DataFrame, key: str) -> DataFrame:
    """key, near and d: for each of points(key, lon, lat, at) the nearest of those with a smaller at, the smaller key of two as near; the first has none.

    Of the points of a place and time, only the one with the smallest key can be the nearest, so all places and times are compared, not all points;
    those with an equal `at` are looked up by it.
    """
    p = points.groupBy("lon", "lat", "at").agg(F.min(key).alias("near"))
    n = p.count()
    b = p.select("near", F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("at").alias("_at"))
    d = distance_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    order = lambda x: F.struct(F.round(x["d"], 6).alias("r"), x["near"].alias("near"))
    best = lambda x, *keys: x.groupBy(*keys).agg(F.min_by("c", order(F.col("c"))).alias("c"))
    before = p.drop("near").repartition(min(2000, max(8, n // 4))).join(b, F.col("_at") < F.col("at")).select("lon", "lat", "at", F.struct("near", d.alias("d")).alias("c"))
    one = points.join(best(before, "lon", "lat", "at"), ["lon", "lat", "at"]).select(key, "c")
    same = points.join(b, (F.col("_at") == F.col("at")) & (F.col("near") < F.col(key))).select(key, F.struct("near", d.alias("d")).alias("c"))
    return best(one.unionByName(same), key).select(key, "c.near", "c.d")


def overlap_counts(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """Samples that two records have in common at each lag from -max_lag to max_lag, where there are any.

    a and b have key, i0 and i1 (last index, inclusive); the sum over pairs of intervals of their overlap, the second
    shifted. Pairs that don't meet within max_lag are dropped before lags are formed.
    """
    x = a.select("key", F.col("i0").alias("a0"), F.col("i1").alias("a1")).join(b.select("key", F.col("i0").alias("b0"), F.col("i1").alias("b1")), "key")
    x = x.where((F.col("a0") <= F.col("b1") + max_lag) & (F.col("b0") <= F.col("a1") + max_lag)).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    n = F.least(F.col("a1"), F.col("b1") - F.col("lag")) - F.greatest(F.col("a0"), F.col("b0") - F.col("lag")) + 1
    return x.select("key", "lag", n.alias("n")).where("n > 0").groupBy("key", "lag").agg(F.sum("n").alias("n"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
