"""Functions that give tables, to be registered by name for SQL."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class RaySamples:
    """k, lon and lat of the middles of n equal parts of the great circle between two points; nothing for points that are the same or opposite, or a null."""

    def eval(self, lon1: float, lat1: float, lon2: float, lat2: float, n: int) -> Iterator[tuple]:
        if None in (lon1, lat1, lon2, lat2, n):
            return
        a, b = ((math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))) for x, y in ((lon1, lat1), (lon2, lat2)))
        d = math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b, strict=True)))))
        if math.sin(d) < 1e-12:
            return
        for k in range(n):
            s = (k + 0.5) / n
            u, v = math.sin((1 - s) * d) / math.sin(d), math.sin(s * d) / math.sin(d)
            x, y, z = (u * p + v * q for p, q in zip(a, b, strict=True))
            yield k, math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y)))


class GridCells:
    """ilat, ilon, lat and lon of a regular grid of degrees."""

    def eval(self, lat0: float, lon0: float, step: float, rows: int, columns: int) -> Iterator[tuple]:
        for i in range(rows or 0):
            for j in range(columns or 0):
                yield i, j, lat0 + step * i, lon0 + step * j


def register(spark: SparkSession) -> None:
    """ray_samples(lon1, lat1, lon2, lat2, n) and grid_cells(lat0, lon0, step, rows, columns) for spark.sql."""
    spark.udtf.register("ray_samples", udtf(RaySamples, returnType="k int, lon double, lat double"))
    spark.udtf.register("grid_cells", udtf(GridCells, returnType="ilat int, ilon int, lat double, lon double"))
