"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a component: x becomes floor(UNITS * x).
UNITS = 256


def usable(vector: Column) -> Column:
    """Whether the vector is there and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vector: Column) -> Column:
    """The components as floor(UNITS * x), each x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * UNITS).cast("bigint"))


def padded(rows: DataFrame, vector: str = "x") -> tuple[DataFrame, int]:
    """The rows with vectors of one length, and that; zeros follow the shorter ones."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        rows = rows.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0).cast("bigint"), F.lit(high) - F.size(vector))))
    return rows, high or 0
