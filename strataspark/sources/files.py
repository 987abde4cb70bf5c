"""Text lists of stations, fields and models, read and written as distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_LIST = (("staid", "string"), ("lon", "double"), ("lat", "double"), ("elev_m", "double"))
FIELD = (("lon", "double"), ("lat", "double"), ("c", "double"), ("u", "double"), ("snr", "double"), ("dist", "double"))
LAYERS = (("h", "double"), ("vs", "double"), ("vp", "double"), ("rho", "double"), ("qs", "double"), ("qp", "double"))


def read_columns(spark: SparkSession, path: str, columns=STATION_LIST, at: tuple[int, ...] | None = None) -> DataFrame:
    """The columns (name, type) of white-space separated text; at has their places, by default in order.

    Blank lines and those that begin with # are skipped; fields that are missing or don't fit their type are null.
    """
    places = at or tuple(range(len(columns)))
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\s+")
    return lines.select(*(F.get(parts, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in zip(places, columns, strict=True)))


def write_columns(df: DataFrame, path: str, columns=STATION_LIST) -> None:
    """The columns as white-space separated text that read_columns reads back; nulls are written as '-'."""
    df.select(F.concat_ws(" ", *(F.coalesce(F.col(n).cast("string"), F.lit("-")) for n, _ in columns)).alias("value")).write.mode("overwrite").text(path)


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with those rows of new whose keys it lacks, so that a load that runs again adds nothing."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns))


#: One measured curve as text: period or time, value, uncertainty.
CURVE = (("period", "double"), ("value", "double"), ("uncertainty", "double"))
#: A frequency-time analysis: nominal and instantaneous period, group and phase velocity, amplitude and signal-to-noise ratio.
DISPERSION = (("nominal", "double"), ("period", "double"), ("group", "double"), ("phase", "double"), ("amplitude", "double"), ("snr", "double"))
#: Model parameters: their group, kind and place, the value, and the range and step of a search around it.
PARAMETERS = (("part", "int"), ("kind", "int"), ("place", "int"), ("value", "double"), ("space", "double"), ("step", "double"))
#: Buckets of a correlation table: a pair is looked up in one of them.
BUCKETS = 64


def write_curves(df: DataFrame, path: str, keys: list[str], columns=CURVE) -> None:
    """Curves as white-space separated text, in a folder of their own for each combination of keys."""
    lines = F.concat_ws(" ", *(F.coalesce(F.col(n).cast("string"), F.lit("-")) for n, _ in columns))
    df.select(*keys, lines.alias("value")).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def read_curves(spark: SparkSession, path: str, keys: list[str], columns=CURVE) -> DataFrame:
    """What write_curves has written; keys are read from the folders' names."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(*keys, *(F.get(parts, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(columns)))


def _bucket(a, b):
    return F.pmod(F.xxhash64(F.least(a, b).cast("string"), F.greatest(a, b).cast("string")), F.lit(BUCKETS)).cast("int")


def write_correlations(df: DataFrame, path: str) -> None:
    """df(sta1, sta2, channels, data, ...) as Parquet in buckets of pairs; pairs with sta1 > sta2 are turned round with their lags."""
    turned = F.col("sta1") > F.col("sta2")
    own = {"sta1": F.least("sta1", "sta2"), "sta2": F.greatest("sta1", "sta2"), "data": F.when(turned, F.reverse("data")).otherwise(F.col("data"))}
    df.select(*(own.get(c, F.col(c)).alias(c) for c in df.columns)).withColumn("bucket", _bucket(F.col("sta1"), F.col("sta2"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def find_correlation(spark: SparkSession, path: str, a, b, channels: str | None = None) -> DataFrame:
    """The rows of a pair in either order, as if a were first; empty if it isn't there. Only one bucket's files are read."""
    k = spark.range(1).select(_bucket(F.lit(a), F.lit(b))).first()[0]
    x = spark.read.parquet(path).where((F.col("bucket") == k) & (F.col("sta1") == min(a, b)) & (F.col("sta2") == max(a, b)))
    x = x if channels is None else x.where(F.col("channels") == channels)
    return x.withColumn("data", F.reverse("data")).withColumns({"sta1": F.lit(a), "sta2": F.lit(b)}).drop("bucket") if a > b else x.drop("bucket")
