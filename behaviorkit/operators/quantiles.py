"""Exact, distributed quantiles per key (A4, A11, A19) that survive hot keys.

Spark's exact ``percentile`` keeps a value -> count map per group and merges
all partial maps of a group in one task: a subscriber holding a third of the
rows with continuous values would put billions of entries in one task.  Here
a key with few rows (``CAP``) is sorted by itself, and the order statistics of
a larger one are found by *brackets*: its values are counted in equal-width
buckets (map-side combined), only the bucket that holds the wanted order
statistic is looked into again, and so on until few values are left.  Values are
neither sorted across tasks nor stored; each round reads the source's
key and value columns again.

    pos = (n - 1) * q,  result = x[floor(pos)] + (pos - floor(pos)) * (x[ceil(pos)] - x[floor(pos)])

(0-based order statistics, NULL and NaN ignored) -- pandas' and SQL's linear
interpolation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorkit.session import checkpoint_dir

CAP = 1 << 15       # values of a group that one task sorts
BUCKETS = 1024      # buckets of a bracket and round
LARGEST = 1.7976931348623157e308


def _q_name(q: float) -> str:
    return ("%g" % q).replace(".", "_")


def keyed_quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str],
                    qs: Mapping[str, float]) -> DataFrame:
    """Per key: one output column ``{value}_{qname}`` for every value column and level.

    ``values`` maps an output prefix to a column; ``qs`` maps a level name
    (e.g. ``"median"``) to the level.  Keys without any non-null value get NULL
    (callers left-join onto their key spine).
    """
    items = [F.struct(F.lit(p).alias("_v"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("x"))
             for p, c in values.items()]
    long = (df.select(*keys, F.explode(F.array(*items)).alias("_it"))
              .select(*keys, "_it._v", "_it.x")
              .where(F.col("x").isNotNull() & ~F.isnan("x")))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= CAP:
        per = _sorted_groups(long, keys, qs)
    else:
        checkpoint_dir(df.sparkSession)
        big = sizes.where(F.col("_rows") > CAP).select(*[F.col(k).alias(f"_big_{k}") for k in keys]).checkpoint(eager=True)
        same = _same(keys, "_big_")
        per = (_sorted_groups(long.join(big, same, "left_anti"), keys, qs)
               .unionByName(_bracketed(long.join(big, same, "left_semi"), keys, qs)))
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_v") == p, F.col(f"_q_{qn}"))).alias(f"{p}_{qn}")
                                    for p in values for qn in qs])


def _same(keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _interpolated(group: DataFrame, keys: Sequence[str], qs: Mapping[str, float], n: str) -> DataFrame:
    """``keys, _v, _q_{level}`` from rows ``keys, _v, x, _k, _c``: value ``x`` at the 0-based places ``_k`` to ``_k + _c - 1`` of ``n``."""
    aggs = []
    for qn, q in qs.items():
        pos = (F.col(n) - 1) * F.lit(float(q))

        def at(place):
            return F.max(F.when((F.col("_k") <= place) & (place < F.col("_k") + F.col("_c")), F.col("x")))

        low, high = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append((low + F.first(pos - F.floor(pos)) * (high - low)).alias(f"_q_{qn}"))
    return group.groupBy(*keys, "_v").agg(*aggs)


def _sorted_groups(long: DataFrame, keys: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """Groups of at most ``CAP`` values: gathered and sorted, each group as one array."""
    group = long.groupBy(*keys, "_v").agg(F.sort_array(F.collect_list("x")).alias("_x"))
    out = {}
    for qn, q in qs.items():
        pos = (F.size("_x") - 1) * F.lit(float(q))
        low, high = (F.get("_x", f(pos).cast("int")) for f in (F.floor, F.ceil))
        out[f"_q_{qn}"] = low + (pos - F.floor(pos)) * (high - low)
    return group.withColumns(out).drop("_x")


def _bracketed(long: DataFrame, keys: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """Groups of any size.  A bracket ``(keys, _v, _r)`` is the range ``[_lo, _hi]`` that holds the order statistic ``_r``,
    with ``_below`` values below it and ``_c`` in it; rounds narrow it until ``CAP`` values or one distinct value are left.

    Buckets are of equal width on a linear and on a logarithmic scale in turns, so values that differ by
    magnitudes fall apart as well.
    """
    ids = [*keys, "_v"]
    total = long.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    places = F.array_distinct(F.array(*[f((F.col("_n") - 1) * F.lit(float(q))).cast("long") for q in qs.values() for f in (F.floor, F.ceil)]))
    brackets = (total.withColumn("_r", F.explode(places)).withColumns({"_below": F.lit(0).cast("long"), "_c": F.col("_n")})
                .select(*ids, "_n", "_r", "_lo", "_hi", "_below", "_c").checkpoint(eager=True))
    open_ = (F.col("_c") > CAP) & (F.col("_lo") < F.col("_hi"))

    def inside(b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_b_{c}") for c in ids], "_n", "_r", "_lo", "_hi", "_below")
        return long.join(b, _same(ids, "_b_") & F.col("x").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_b_{c}" for c in ids])

    turn = 0
    while not brackets.where(open_).isEmpty():
        scale = (lambda c: c) if turn % 2 == 0 else (lambda c: F.signum(c) * F.log1p(F.abs(c)))
        # half of each end, so that the width of the widest range is finite; ends that the scale cannot tell apart: the top alone
        lo, hi, x = (scale(F.least(F.greatest(F.col(c), F.lit(-LARGEST)), F.lit(LARGEST))) / 2 for c in ("_lo", "_hi", "x"))
        share = F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.when(F.col("x") >= F.col("_hi"), 1.0).otherwise(0.0))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        hist = (inside(brackets.where(open_)).groupBy(*ids, "_n", "_r", "_below", bucket.alias("_bucket"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("x").alias("_lo"), F.max("x").alias("_hi")))
        run = Window.partitionBy(*ids, "_r").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(run), F.lit(0).cast("long")))
        found = hist.where((F.col("_below") <= F.col("_r")) & (F.col("_r") < F.col("_below") + F.col("_c"))).select(*brackets.columns)
        brackets = brackets.where(~open_).unionByName(found).checkpoint(eager=True)
        turn += 1
    few = inside(brackets.where(F.col("_lo") < F.col("_hi"))).groupBy(*ids, "_n", "_r", "_below", "x").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*ids, "_r").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_k", F.col("_below") + F.coalesce(F.sum("_c").over(run), F.lit(0).cast("long")))
    few = few.where((F.col("_k") <= F.col("_r")) & (F.col("_r") < F.col("_k") + F.col("_c")))
    one = brackets.where(F.col("_lo") == F.col("_hi")).withColumn("x", F.col("_lo"))
    picked = [df.select(*ids, "_n", "x", F.col("_r").alias("_k"), F.lit(1).cast("long").alias("_c")) for df in (few, one)]
    return _interpolated(picked[0].unionByName(picked[1]), keys, qs, "_n")


def column_quantiles_long(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """A19 long form ``(column, q, value)`` over whole columns (no key)."""
    names = {f"q{_q_name(q)}": q for q in qs}
    wide = keyed_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], {c: c for c in cols}, names)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(q)).alias("q"), F.col(f"{c}_{qn}").alias("value"))
        for c in cols for qn, q in names.items()])).alias("s"))
    return stacked.select("s.column", "s.q", "s.value").where(F.col("value").isNotNull())
