"""The table of queries that plan modules fill."""

from __future__ import annotations

from strataspark.operators.dealing import dealt
from strataspark.sources.fixtures import table, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under name, with DuckDB SQL over driver and derived tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


def curves_by_pair(spark, sf_dir: str, *columns: str):
    """sta1, sta2 and columns of the curves, by pair in as many tasks as their rows ask for; most pairs have a few rows, so counting them first would save nothing."""
    c = table(spark, sf_dir, "curves").select("sta1", "sta2", *columns)
    return dealt(c, table(spark, sf_dir, "lineitem").count(), "sta1", "sta2")
