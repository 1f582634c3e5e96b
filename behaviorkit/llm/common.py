"""Shared pieces: cut lineage, connected components, distributed running sums."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorkit.session import checkpoint_dir, scratch_path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: later stages reread files that every
    executor sees, so a lost executor costs a reread and not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back (column pruning works on
    the reread, unlike on a checkpoint)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_place() -> Column:
    """Place of a row of a table of :func:`written` in the order of its partitions when it was written; ascending, not dense."""
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; component = smallest node.

    Alternating large-star / small-star rewriting: every round points the neighbours of a node at
    the smallest node it knows, and stops when the edges are stars.  Both steps are a map-side
    combined minimum and a join on the node, so a hub with many neighbours is never gathered in one
    task as a list; the number of rounds is logarithmic in the longest path.  The edges of a round
    are checkpointed.  Self-loops are kept as single nodes; null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    e = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        # large star: neighbours above u point at the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(e.where("u = v")).distinct())
        # small star: u and its neighbours below point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e2 = large.join(low, "u")
        e = cut(e2.select("u", F.col("m").alias("v"))
                .unionByName(e2.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    return (e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
                                       F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("r"))
            .select("r.*").groupBy("node").agg(F.min("component").alias("component")))


def running_total(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
                  total: str = "before", number: str | None = None) -> DataFrame:
    """Add ``total`` = sum of ``value`` over the rows before this one, inside its ``by`` group in ``order``,
    and, with ``number``, the 0-based row number there.  Pass narrow rows only.

    Rows are range-partitioned by (by, order): a group that holds most rows is spread over many
    tasks.  Each task adds up its sorted rows batch by batch; the sums of a (task, group) block, a
    table as long as tasks plus groups, give every block its start.  The numbered rows are
    checkpointed between both steps, so a repeated task cannot see other range bounds.
    Null keys form a group of their own; a null ``value`` counts as 0.
    """
    by = list(by)
    schema = T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType()),
                                              T.StructField("_num", T.LongType())])
    names = df.columns

    def add_up(batches):
        keys, s, n = None, 0, 0     # the group that is still open at the end of the batch before
        for b in batches:
            v = b[value].fillna(0).astype("int64")
            k = pd.Series(list(zip(*[b[c].where(b[c].notna(), None) for c in by]))) if by else pd.Series([()] * len(b))
            k.index = b.index
            block = (k != k.shift()).cumsum() if len(b) else k
            sums, nums = v.groupby(block).cumsum() - v, v.groupby(block).cumcount()
            if len(b) and k.iloc[0] == keys:
                first = block == block.iloc[0]
                sums, nums = sums + first * s, nums + first * n
            if len(b):
                keys, s, n = k.iloc[-1], int(sums.iloc[-1] + v.iloc[-1]), int(nums.iloc[-1]) + 1
            b["_sum"], b["_num"] = sums.astype("int64"), nums.astype("int64")
            yield b[names + ["_part", "_sum", "_num"]]

    keys = [F.col(c) for c in [*by, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                 .withColumn("_part", F.spark_partition_id()).mapInPandas(add_up, schema))
    blocks = ranged.groupBy("_part", *by).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("_s"),
                                              F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by],
                           F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"),
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = ranged.join(starts, on).withColumn(total, F.col("_sum") + F.col("_s0"))
    if number:
        out = out.withColumn(number, F.col("_num") + F.col("_n0"))
    return out.select(*names, total, *([number] if number else []))


def slices(texts, characters: int):
    """Lists of whole texts of about ``characters`` characters together (a longer text is alone)."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > characters:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def give_back() -> None:
    """Return this worker's free memory to the system.

    Python workers outlive their task, and what Arrow and the C library keep of its last batch counts
    against the executor while other stages run.
    """
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass
