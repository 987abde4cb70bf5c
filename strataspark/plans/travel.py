"""Travel-time fields of the stations as sources: cycle skips, surfaces in tension, reasons, and velocities corrected by amplitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.operators import travel
from strataspark.sources.fixtures import table

from .registry import query

#: x0, y0, spacing (km), columns and rows of the stations' region.
GRID = (0.0, 0.0, 75.0, 19, 15)
RULES = travel.Rules(mode=3, near=200.0, far=400.0, quadrants=3, smooth=0.001, wavelengths=2.0)


def field_points(spark, sf_dir: str) -> DataFrame:
    """Times at all stations from each station as a source, by the speeds of the pairs' curves; one in eleven pairs is late by a period.

    Speeds are 3.2 km/s and a thousandth of what the curve has above 3.5 km/s, and 0.01 km/s more a second of period, so fields are even but for the skips.
    """
    c = table(spark, sf_dir, "curves").groupBy("sta1", "sta2", "period").agg(F.avg("c").cast("double").alias("c"), F.avg("snr").cast("double").alias("amplitude"))
    s = table(spark, sf_dir, "stations").select("sta_key", ((F.col("lon") + 165) * 55).cast("double").alias("x"), ((F.col("lat") - 55) * 111).cast("double").alias("y"))
    ways = F.explode(F.array(F.struct(F.col("sta1").alias("event"), F.col("sta2").alias("sta")), F.struct(F.col("sta2").alias("event"), F.col("sta1").alias("sta"))))
    late = F.when((F.col("event") + F.col("sta") + F.col("period").cast("int")) % 11 == 0, F.col("period")).otherwise(0.0)
    p = c.withColumn("w", ways).select("w.event", "w.sta", "period", "c", "amplitude").join(s.select(F.col("sta_key").alias("sta"), "x", "y"), "sta").join(s.select(F.col("sta_key").alias("event"), F.col("x").alias("ex"), F.col("y").alias("ey")), "event")
    t = F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) / (3.2 + (F.col("c") - 3.5) / 1000 + F.col("period") / 100)
    return p.where("x <> ex or y <> ey").select("period", F.col("event").cast("bigint").alias("event"), "ex", "ey", "x", "y", (t + late).alias("t"), "amplitude")


def _parts(spark, sf_dir: str) -> int:
    """Groups for the fields: a measurement gives two points at most, and tables know how many rows they have."""
    return max(1, 2 * table(spark, sf_dir, "lineitem").count() // travel.TASK_POINTS)


@query("travel_time_fields")
def travel_time_fields(spark, sf_dir):
    """A row a grid point of each station's field at each period: time, velocity, direction, its deflection, and the reason why it doesn't count."""
    return travel.travel_fields(field_points(spark, sf_dir).drop("amplitude"), GRID, RULES, parts=_parts(spark, sf_dir))


@query("amplitude_corrected_fields")
def amplitude_corrected_fields(spark, sf_dir):
    """Velocities of the same fields corrected by the curvature of amplitudes (the curves' signal to noise), with reasons 7 and 8."""
    return travel.corrected_fields(field_points(spark, sf_dir), GRID, RULES, parts=_parts(spark, sf_dir))
