"""A bounded sample of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, about.
MAX_TRAIN_ROWS = 20_000


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def training_ids(labels: DataFrame, label: str, keep, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """id and y of about max_rows of the labels that keep holds for, picked by a hash of the id; small enough to broadcast.

    Rows with a null id or label are left out; of an id with several labels the largest counts.
    """
    usable = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = usable.count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < share)
    return F.broadcast(usable)
