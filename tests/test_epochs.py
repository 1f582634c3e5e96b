"""Epoch orders: a permutation for every n, another one every epoch; slices of an order read their blocks only."""

import pytest
from pyspark.sql import functions as F

from behaviorkit.operators import epochs, slices
from behaviorkit.session import scratch_path


def _plain(x, n, keys):
    a, b = epochs.domain(n)
    assert a * b >= n and a * b - n < a + b
    while True:
        left, right = x % a, x // a
        for j, k in enumerate(keys):
            mix = lambda v: (((v + k) * epochs.FACTOR % epochs.PRIME) ** 2) % epochs.PRIME
            if j % 2 == 0:
                left = (left + mix(right)) % a
            else:
                right = (right + mix(left)) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 16, 17, 101, 1000])
def test_permutation_for_every_n(spark, n):
    keys = epochs.round_keys(7, n)
    place = epochs.permuted(F.col("id"), n, F.array(*[F.lit(k).cast("long") for k in keys]))
    got = [r["p"] for r in spark.range(n).select("id", place.alias("p")).orderBy("id").collect()]
    assert got == [_plain(i, n, keys) for i in range(n)] and sorted(got) == list(range(n))


def test_epochs_differ_and_batches_follow(spark):
    df = spark.range(203).select((F.col("id") * 3).alias("k"))
    rows = epochs.epoch_batches(df, ["k"], [0, 1, 5], size=4, seed=1).collect()
    by = {e: sorted((r["place"], r["k"], r["batch"]) for r in rows if r["epoch"] == e) for e in (0, 1, 5)}
    for order in by.values():
        assert [p for p, _, _ in order] == list(range(203)) and all(b == p // 4 for p, _, b in order)
        moved = [k for _, k, _ in order]
        assert moved != sorted(moved) and sum(abs(x - y) < 30 for x, y in zip(moved, moved[1:])) < 60
    assert by[0] != by[1] != by[5]
    assert epochs.epoch_batches(df.limit(0), ["k"], [0]).count() == 0


def test_slices_read_their_blocks(spark):
    path = scratch_path(spark, "slices")
    slices.write_ordered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(4), ["k"], path, block=100)

    def got(df):
        return sorted(r["k"] for r in df.collect())

    assert got(slices.head(spark, path, 150, 100)) == list(range(150)) and got(slices.tail(spark, path, 30, 1000, 100)) == list(range(970, 1000))
    assert got(slices.read_slice(spark, path, 199, 301, 100)) == list(range(199, 301))
    assert got(slices.head(spark, path, 0, 100)) == got(slices.tail(spark, path, 0, 1000, 100)) == got(slices.read_slice(spark, path, 5, 3, 100)) == []
    df = slices.head(spark, path, 150, 100)
    assert "PartitionFilters: [" in df._jdf.queryExecution().executedPlan().toString()
    assert len({r["f"] for r in df.select(F.input_file_name().alias("f")).collect()}) <= 4 and all("block=0" in r["f"] or "block=1/" in r["f"]
                                                                                                for r in df.select(F.input_file_name().alias("f")).distinct().collect())
