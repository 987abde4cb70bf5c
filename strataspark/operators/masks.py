"""Masks of grids: over periods, without holes, with rings trimmed off, and regional values written over a global map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CROSS = ((0, -1), (0, 1), (-1, 0), (1, 0))


def _around(m: DataFrame) -> DataFrame:
    """ilat, ilon and n, how many of its four neighbours are masked, of the cells beside masked ones of m(ilat, ilon, masked)."""
    near = F.explode(F.array(*(F.struct((F.col("ilat") + i).alias("ilat"), (F.col("ilon") + j).alias("ilon")) for i, j in _CROSS)))
    return m.where("masked").select(near.alias("k")).groupBy("k.ilat", "k.ilon").agg(F.count("*").alias("n"))


def combined_mask(cells: DataFrame, rings: int) -> DataFrame:
    """ilat, ilon, masked of cells(period, ilat, ilon, bad): masked at any period, then also where all four neighbours are, then `rings` rings of neighbours more."""
    m = cells.groupBy("ilat", "ilon").agg(F.bool_or("bad").alias("masked"))
    for k in range(rings + 1):
        n = _around(m)
        m = m.join(n, ["ilat", "ilon"], "left").select("ilat", "ilon", (F.col("masked") | (F.coalesce("n", F.lit(0)) >= (4 if k == 0 else 1))).alias("masked"))
    return m


def merged_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a, masked where either of a and b (ilat, ilon, masked) is."""
    x = a.join(b.withColumnRenamed("masked", "_b"), ["ilat", "ilon"], "left")
    return x.select("ilat", "ilon", (F.col("masked") | F.coalesce("_b", F.lit(False))).alias("masked"))


def overwritten(whole: DataFrame, part: DataFrame, near: float = 0.05, most: float = 0.5) -> DataFrame:
    """whole(lon, lat, v) with v of part(lon, lat, v) where a node lies within `near` degrees in both directions, isn't 0 and differs by less than `most`.

    changed tells where; longitudes of either sign mean the same. Nodes are joined by buckets of `near` and those around, then exactly; of several the last by (lat, lon) counts.
    """
    own = lambda d: d.withColumn("_x", F.pmod("lon", F.lit(360.0)))
    key = lambda c: F.floor(F.col(c) / near).cast("bigint")
    near_ = F.explode(F.array(*(F.struct((key("_x") + i).alias("i"), (key("lat") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    p = own(part).where("v <> 0").withColumn("k", near_).select(F.col("k.i").alias("i"), F.col("k.j").alias("j"), F.col("_x").alias("px"), F.col("lat").alias("py"), F.col("v").alias("pv"))
    w = own(whole).withColumns({"i": key("_x"), "j": key("lat")})
    hit = w.join(p, ["i", "j"]).where(f"abs(_x - px) < {near} and abs(lat - py) < {near} and abs(v - pv) < {most}").groupBy("lon", "lat").agg(F.max_by("pv", F.struct("py", "px")).alias("pv"))
    return whole.join(hit, ["lon", "lat"], "left").select("lon", "lat", F.coalesce("pv", "v").alias("v"), F.col("pv").isNotNull().alias("changed"))
