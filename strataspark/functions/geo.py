"""Geodesy and angles as column expressions, in degrees and kilometres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean earth radius in km.
RADIUS = 6371.0
#: Squared ratio of the axes of the reference ellipsoid: tan of geocentric over tan of geographic latitude.
GEOCENTRIC = 0.993277
#: Kilometres of a degree, as travel-time tables use it.
KM_PER_DEGREE = 111.12


def distance_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance on the sphere, by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def azimuth(lon1, lat1, lon2, lat2) -> Column:
    """Azimuth from the first to the second point, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def wrap180(angle: Column) -> Column:
    """The angle from -180 to under 180."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of directions that are the same after half a turn, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def geocentric(lat: Column) -> Column:
    """Geocentric latitude of a geographic one."""
    return F.degrees(F.atan(GEOCENTRIC * F.tan(F.radians(lat))))


def cartesian(lon: Column, lat: Column, radius: Column) -> tuple[Column, Column, Column]:
    """x, y and z of a point at a radius."""
    a, b = F.radians(lon), F.radians(lat)
    return radius * F.cos(b) * F.cos(a), radius * F.cos(b) * F.sin(a), radius * F.sin(b)


def along(lon1: Column, lat1: Column, lon2: Column, lat2: Column, share: Column) -> tuple[Column, Column]:
    """Longitude and latitude at a share of the great circle between two points, by spherical interpolation; ends that are the same or opposite give null."""
    x1, y1, z1 = cartesian(lon1, lat1, F.lit(1.0))
    x2, y2, z2 = cartesian(lon2, lat2, F.lit(1.0))
    d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x1 * x2 + y1 * y2 + z1 * z2)))
    a, b = F.sin((1 - share) * d) / F.nullif(F.sin(d), F.lit(0.0)), F.sin(share * d) / F.nullif(F.sin(d), F.lit(0.0))
    x, y, z = a * x1 + b * x2, a * y1 + b * y2, a * z1 + b * z2
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def next_pow2(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("bigint")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("distance", "azimuth", "back_azimuth")]))
def wgs84_inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    """Distance in km and azimuths on the WGS84 ellipsoid, by Vincenty's inverse formula on whole batches.

    Points that are nearly opposite, for which the iteration doesn't settle, and nulls give nulls.
    """
    f, a = 1 / 298.257223563, 6378.137
    b = (1 - f) * a
    x1, y1, x2, y2 = (np.radians(s.to_numpy(float)) for s in (lon1, lat1, lon2, lat2))
    u1, u2, d = np.arctan((1 - f) * np.tan(y1)), np.arctan((1 - f) * np.tan(y2)), x2 - x1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = d.copy(), np.zeros(len(d), bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0)
            ca2 = 1 - sa**2
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0)
            k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = d + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        uu = ca2 * (a * a - b * b) / (b * b)
        aa = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        bb = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm**2 - 1) - bb / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = np.stack([b * aa * (sigma - ds), np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360, np.degrees(np.arctan2(-c1 * sl, s1 * c2 - c1 * s2 * cl)) % 360], axis=1)
    out[~settled] = np.nan
    return pd.DataFrame(out, columns=["distance", "azimuth", "back_azimuth"])


def sql_distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """DuckDB text of distance_km."""
    h = f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"(2 * {RADIUS} * asin(sqrt(least({h}, 1.0))))"
