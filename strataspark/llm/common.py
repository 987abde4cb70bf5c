"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters that separate words in every operator here.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it, or where the session has set one (setCheckpointDir).

    On a local master without either, a temporary folder; elsewhere executors couldn't read that, so it is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-shared-"))
    return configured or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a reliable checkpoint, for small frames in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that go to a Python worker at a time while a table is stored: whole texts and sets of shingles are large rows.
ARROW_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, for frames that are read more than once.

    Tables stay as long as the folder does: a frame that was built on one may be computed at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that value is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of rows rows at most, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def chunks(values: list, weight=len, limit: int = 4_000_000) -> Iterator[slice]:
    """Slices of values whose weights add up to about limit, so that arrays over a slice stay small."""
    start = total = 0
    for k, v in enumerate(values):
        total += weight(v) if v is not None else 0
        if total >= limit:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(values):
        yield slice(start, len(values))
