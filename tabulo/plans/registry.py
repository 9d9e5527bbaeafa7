"""Registered queries: one per operator group of the inventory, each reading
the driver tables (or data Spark derives from them) in full.

Each entry is ``name -> fn(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds an
independent DuckDB SQL for the same result over the same tables.  Messy
inputs for the cleaners are built by deterministic expressions over integer
keys; those few input expressions are plain SQL text shared by both sides
(the ``*_RAW`` / staged expression lists), the operator logic is not.  Floating results are rounded to 6
decimals on both sides; money is summed as DECIMAL(18,2).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the session settings the results depend
    on (UTC, ANSI, checkpoint folder) are applied first, whatever session
    the caller brings."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
