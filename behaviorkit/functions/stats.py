"""Aggregate Column builders with pandas-compatible null and small-n rules.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen and supports partial (map-side) aggregation.

Rules kept from the pandas semantics the features were defined with:

* ``var``/``std``/``sem`` are sample statistics (ddof=1): one value -> NULL.
* ``skew`` is the bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2);
  fewer than three values -> NULL, zero variance with n >= 3 -> 0.0.
  (Spark's own ``skewness`` is the population g1.)
* ``sum`` of an all-null group is 0, not NULL.
* ``quantile`` interpolates linearly; its default level 0.5 equals ``median``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NINE = ("mean", "median", "max", "min", "var", "skew", "sem", "std", "quantile")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def skew_adj(x) -> Column:
    x = col_(x)
    n = F.count(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise(F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)))


def sem(x) -> Column:
    x = col_(x)
    return F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))


def quantile(x, q: float = 0.5, exact: bool = True, accuracy: int = 10000) -> Column:
    """Linear-interpolated quantile; ``exact=False`` uses a bounded-memory sketch."""
    x = col_(x)
    if exact:
        return F.median(x) if q == 0.5 else F.percentile(x, F.lit(q))
    return F.percentile_approx(x.cast("double"), F.lit(q), F.lit(accuracy)).cast("double")


def stat(x, name: str, q: float = 0.5, exact: bool = True) -> Column:
    x = col_(x)
    if name == "mean":
        return F.avg(x)
    if name == "median":
        return quantile(x, 0.5, exact)
    if name == "quantile":
        return quantile(x, q, exact)
    if name == "max":
        return F.max(x)
    if name == "min":
        return F.min(x)
    if name == "var":
        return F.var_samp(x)
    if name == "std":
        return F.stddev_samp(x)
    if name == "skew":
        return skew_adj(x)
    if name == "sem":
        return sem(x)
    if name == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    if name == "count":
        return F.count(x)
    if name == "nunique":
        return F.count_distinct(x)
    raise ValueError(f"unknown statistic {name!r}")


QUANTILE_NAMES = ("median", "quantile")


def stats(x, prefix: str, names: Sequence[str] = NINE, q: float = 0.5, quantiles: str = "exact") -> list[Column]:
    """``[stat(x, n).alias(f"{prefix}_{n}") for n in names]``.

    ``quantiles``: ``"exact"`` -- Spark's ``percentile`` (a value map per group);
    ``"approx"`` -- the bounded ``percentile_approx`` sketch; ``"ranked"`` --
    median / quantile are left out here and computed by
    :func:`behaviorkit.operators.quantiles.keyed_quantiles` (exact and hot-key safe).
    """
    if quantiles == "ranked":
        names = [n for n in names if n not in QUANTILE_NAMES]
    return [stat(x, n, q, quantiles != "approx").alias(f"{prefix}_{n}") for n in names]


def ratio(a, b) -> Column:
    """a / b as double; a zero or NULL divisor gives NULL (ANSI-safe)."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def count_where(cond: Column, x=None) -> Column:
    """Non-null count of ``x`` over rows where ``cond`` holds (all rows when x is None)."""
    return F.count(F.when(cond, F.lit(1) if x is None else col_(x)))


def guarded(cond: Column, agg: Column) -> Column:
    """``agg`` when at least one row satisfies ``cond``, else NULL.

    Mirrors filter-then-aggregate followed by a left join: a key without any
    matching row gets NULL, a key with matching rows whose values are all NULL
    gets the aggregate of nothing (0 for counts).
    """
    return F.when(F.count_if(cond) > 0, agg)
