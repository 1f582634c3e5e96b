"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def report(df: DataFrame) -> DataFrame:
    """Report form of a feature table: double columns as FLOAT, for comparison only (stores keep DOUBLE).

    Feature tables feed gradient-boosted trees, which bin features in 32-bit
    floats; storing the report at that precision also makes the output
    independent of the summation order of the partial aggregates.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.col(f.name).cast("float").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
