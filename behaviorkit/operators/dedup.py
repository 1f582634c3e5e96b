"""De-duplication and row selection (D1, D2; D3 is ``decode.learned_domains``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_spine(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys (a group key never includes NULL, as in pandas)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def last_per_key(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Keep-last per key by an explicit order (later = larger ``order`` tuple).

    Written as ``max_by(struct(keep), struct(order))`` -- a partial aggregate, so
    a key holding a large share of the rows is reduced map-side to one
    candidate per task instead of being sorted in one window partition.
    """
    best = F.max_by(F.struct(*[F.col(c) for c in keep]), F.struct(*[F.col(c) for c in order]))
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_last"))
              .select(key, *[F.col(f"_last.{c}").alias(c) for c in keep]))

