"""Shuffled order of every training epoch by arithmetic (O3, B1).

Shuffling by a random key sorts all rows again for every epoch.  Here rows are numbered once, and an epoch's
order is a keyed permutation of these numbers, so a row finds its place, and its batch, by itself: no
shuffle, no state, the same after a lost executor.

The permutation of 0..n-1 is a Feistel network over pairs (l, r) with l < a and r < b, a * b >= n as small as
possible: rounds add to one half, modulo its size, a keyed mix of the other, and can be undone one by one.  A number
that lands at n or above is sent through again (cycle walking) until it is below n; less than a + b numbers of the
domain are that large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.operators.ranking import ordered_index

ROUNDS = 6
WALK = 64                       # passes after which a number must be below n (the chance that it is not is nil from n = 100 on)
PRIME, FACTOR = 2147483647, 48271


def round_keys(seed: int, epoch: int) -> list[int]:
    """The keys of an epoch's rounds."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{j}".encode()).hexdigest()[:7], 16) for j in range(ROUNDS)]


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mix(v: Column, key: Column) -> Column:
    t = ((v + key) * FACTOR) % PRIME
    return (t * t) % PRIME


def permuted(number: Column, n: int, keys: Column) -> Column:
    """Place of the 0-based ``number`` among ``n`` in the order of the array of round ``keys``."""
    a, b = (F.lit(x).cast("long") for x in domain(n))
    rounds = F.transform(keys, lambda k, j: F.struct(k.cast("long").alias("key"), (j % 2).alias("odd")))

    def turn(halves: Column, r: Column) -> Column:
        left, right = halves["l"], halves["r"]
        return F.struct(F.when(r["odd"] == 0, (left + _mix(right, r["key"])) % a).otherwise(left).alias("l"),
                        F.when(r["odd"] == 1, (right + _mix(left, r["key"])) % b).otherwise(right).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(rounds, start, turn, lambda h: h["r"] * a + h["l"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number.cast("long")), lambda x, _: F.when(x >= n, once(x)).otherwise(x))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def epoch_batches(df: DataFrame, order: Sequence[Column | str], epochs: Sequence[int], size: int = 4, seed: int = 0) -> DataFrame:
    """``df`` once per epoch with ``epoch``, ``place`` (0-based, a permutation of the rows in every epoch) and ``batch``
    (``size`` rows each; the last may be partial).  ``order`` must be total; an empty table gives an empty one."""
    ranked = ordered_index(df, order, name="_rn")
    n = df.count()
    each = F.array(*[F.struct(F.lit(int(e)).alias("epoch"), F.array(*[F.lit(k).cast("long") for k in round_keys(seed, e)]).alias("keys")) for e in epochs])
    rows = ranked.withColumn("_e", F.explode(each)).withColumns({"epoch": F.col("_e.epoch"), "place": permuted(F.col("_rn") - 1, n, F.col("_e.keys"))})
    return rows.withColumn("batch", F.floor(F.col("place") / size).cast("long")).drop("_rn", "_e")
