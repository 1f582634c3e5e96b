"""First, last and middle rows of an order without reading the rest (L1).

A table is numbered once (:func:`ordered_index`) and written in blocks of ``block`` consecutive rows, one folder each.
A slice by row numbers then names its blocks, and the reader prunes every other folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorkit.operators.ranking import ordered_index


def write_ordered(df: DataFrame, order: Sequence[Column | str], path: str, block: int = 1_000_000, name: str = "rn") -> None:
    """Write ``df`` with its 0-based row number in ``order`` (which must be total), in blocks of ``block`` rows."""
    ranked = ordered_index(df, order, name=name).withColumn(name, F.col(name) - 1)
    ranked.withColumn("block", F.floor(F.col(name) / block).cast("long")).write.partitionBy("block").parquet(path)


def read_slice(spark: SparkSession, path: str, first: int, last: int, block: int = 1_000_000, name: str = "rn") -> DataFrame:
    """Rows ``first`` to ``last`` - 1 of a table of :func:`write_ordered`; none if ``last`` <= ``first``."""
    rows = spark.read.parquet(path)
    last = max(first, last)
    return rows.where(F.col("block").between(first // block, max(last - 1, 0) // block) & (F.col(name) >= first) & (F.col(name) < last)).drop("block")


def head(spark: SparkSession, path: str, n: int, block: int = 1_000_000) -> DataFrame:
    """The first ``n`` rows."""
    return read_slice(spark, path, 0, n, block)


def tail(spark: SparkSession, path: str, n: int, total: int, block: int = 1_000_000) -> DataFrame:
    """The last ``n`` of ``total`` rows."""
    return read_slice(spark, path, max(total - n, 0), total, block)
