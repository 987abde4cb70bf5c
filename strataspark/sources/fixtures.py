"""Seismic tables derived from the driver's tables: stations, curves, catalogs, traces, fields, ensembles and residuals.

Each is a piece of SQL that means the same in Spark and in DuckDB, so a query and its oracle read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Name, and SQL over the driver's tables.
FIXTURES = {
    "stations": """select s_suppkey as sta_key, concat('N', cast(s_nationkey % 10 as varchar(4)), '.S', lpad(cast(s_suppkey as varchar(10)), 5, '0')) as staid,
      cast(-165 as double) + cast(s_suppkey * 37 % 1000 as double) / 40 as lon, cast(55 as double) + cast(s_suppkey * 53 % 400 as double) / 40 as lat, s_acctbal as elev_m,
      s_suppkey % 365 as start_day, s_suppkey % 365 + 400 + (s_suppkey % 7) * 100 as end_day from supplier""",
    "curves": """select least(l_suppkey, l_partkey % n) as sta1, greatest(l_suppkey, l_partkey % n) as sta2, cast(6 + 2 * (l_linenumber - 1) as double) as period,
      cast(2.5 as double) + l_quantity / 25 as c, cast(2.2 as double) + l_quantity / 25 - l_discount as u, l_extendedprice / 1000 as snr, case when l_returnflag = 'A' then 0 else 1 end as inbound,
      l_orderkey * 10 + l_linenumber as rec from lineitem cross join (select count(*) as n from supplier) k where l_suppkey <> l_partkey % n""",
    "catalog": """select o_orderkey as evid, o_orderdate as otime, cast(o_custkey * 71 % 3600 as double) / 10 - 180 as evlo, cast(o_custkey * 29 % 1700 as double) / 10 - 85 as evla,
      cast(o_orderkey % 600 as double) as evdp, cast(5 as double) + cast(o_orderkey % 30 as double) / 10 as mag from orders""",
    "traces": "select vec_id % n as sta_key, cast(floor(vec_id / n) as bigint) as day, label, embedding as data from embeddings cross join (select count(*) as n from supplier) k",
    "cells": """select l_suppkey as ev, cast(l_partkey % 10 as int) as ilat, cast(floor(l_partkey / 10) as bigint) % 10 as ilon, cast(l_orderkey % 360 as double) - 180 as az,
      cast(2.5 as double) + l_quantity / 25 as vel, case when l_tax > cast(0.06 as double) then 1 else 0 end as reason_n, l_orderkey * 10 + l_linenumber as rec from lineitem""",
    "rf": "select l_suppkey as sta_key, cast(l_partkey % 360 as double) as baz, l_linenumber as it, l_discount - cast(0.05 as double) as amp from lineitem",
    "ensemble": """select l_suppkey as grid, l_orderkey * 10 + l_linenumber as isample, case when l_returnflag = 'R' then -1 else 1 end as acc, l_quantity / 50 as misfit,
      l_discount as p0, l_tax as p1, l_extendedprice as p2 from lineitem""",
    "residuals": "select l_orderkey as ray, l_suppkey as sta1, l_linenumber as period_idx, (l_extendedprice - 30000) / 10000 as res, l_orderkey * 10 + l_linenumber as rec from lineitem",
}
_TABLES = ("supplier", "lineitem", "orders", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", FIXTURES[name])]
    text = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", FIXTURES[name])
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_tables(sql: str) -> str:
    """sql for DuckDB, with the derived tables that it names in front."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    own = ", ".join(f"{n} as ({FIXTURES[n]})" for n in used)
    body = sql.strip()
    if not own:
        return body
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{own}, {body[len(start):]}"
    return f"with {own} {body}"
