"""Rows of large tables dealt to as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts or groups, about; 100 to 300 MB where they have a few columns.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has about so many rows, by keys in partitions of about TASK_ROWS: groups, windows and joins by these keys (and more) need no other shuffle.

    A fixed number of partitions would let each task's memory grow with the table. There are as many as there are cores at least.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)
