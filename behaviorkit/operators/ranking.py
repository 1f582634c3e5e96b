"""Distributed exact row numbering (global or per group) without a one-task window.

``row_number() over (order by ...)`` without ``partition by`` runs in a single
task, and ``partition by label`` puts a whole class -- possibly half of all rows
-- in one task.  ``ordered_index`` gives the same numbers with balanced tasks:

1. range-partition by (groups, order) and sort inside each partition;
2. tag each row with ``monotonically_increasing_id`` (partition id in the upper
   bits, position inside the partition in the lower 33 bits) and checkpoint to
   the shared checkpoint folder, which pins the assignment: a recomputation
   after an executor loss cannot re-sample different range bounds;
3. per (partition, group) block: row count and first id -- a table of at most
   #partitions + #groups rows;
4. a running sum of block sizes in partition order gives each block's offset;
   rank = offset + position inside the block.

The order must be total (add a unique tie-breaker) for a deterministic result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorkit.session import checkpoint_dir

_LOW = (1 << 33) - 1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered_index(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (),
                  name: str = "rn", partitions: int | None = None, size: str | None = None,
                  weight: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number within each ``by`` group in ``order``;
    with ``size`` also the group's row count (from the block table, no second pass).

    With ``weight`` a row stands for that many equal rows: ``name`` is the number of the
    first of them and ``size`` adds up the weights.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    by_cols = [F.col(b) for b in by]
    order_cols = [_c(o) for o in order]
    # the range bounds are sampled in a first pass over the input: keep the input
    # for the second pass instead of recomputing its lineage
    own = not df.is_cached
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if own else df
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = src.repartitionByRange(n, *by_cols, *order_cols)
    ranged = (parted
                 .sortWithinPartitions(*by_cols, *order_cols)
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True)
                 .withColumn("_pid", F.shiftright("_mid", 33)))
    if own:
        src.unpersist()
    each = F.count(F.lit(1)) if weight is None else F.sum(weight)
    blocks = ranged.groupBy("_pid", *by).agg(each.alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*by_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")))
    extra = []
    if size:
        blocks = blocks.withColumn(size, F.sum("_n").over(Window.partitionBy(*by_cols)))
        extra = [size]
    b = blocks.select(F.col("_pid").alias("_bpid"), *[F.col(x).alias(f"_b_{x}") for x in by], "_m0", "_before",
                      *extra)
    cond = F.col("_pid") == F.col("_bpid")
    for x in by:
        cond = cond & F.col(x).eqNullSafe(F.col(f"_b_{x}"))
    out = ranged.join(b, cond)
    if weight is None:
        inside = F.col("_mid") - F.col("_m0")
    else:   # a block is one task's share of a group, so its running sum never holds a whole hot group
        run = Window.partitionBy("_pid", *by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(run), F.lit(0).cast("long"))
    rn = inside + F.col("_before") + 1
    return out.withColumn(name, rn).drop("_mid", "_pid", "_bpid", "_m0", "_before", *[f"_b_{x}" for x in by])


def ntile_from_rank(rn: Column, n: Column, k: int) -> Column:
    """SQL ``ntile(k)`` (1-based) of a row with 1-based rank ``rn`` among ``n`` rows."""
    q = F.floor(n / k).cast("long")
    rem = (n % k).cast("long")
    big = rem * (q + 1)
    return (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
             .otherwise(rem + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1)).cast("int")

