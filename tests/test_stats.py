"""Hand-made edge table (FIXTURES.md section 3): pandas-compatible statistics."""

import math

import pytest
from pyspark.sql import functions as F

from behaviorkit.functions.stats import stats
from behaviorkit.operators import features as feat
from behaviorkit.operators.features import value_profile

ROWS = [("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", 1.0), ("c", 2.0), ("c", 9.0), ("d", 5.0), ("d", 5.0), ("d", 5.0),
        ("e", None), ("f", 1.0), ("f", None), ("f", 7.0), ("f", 2.0), ("f", 2.0), (None, 4.0)]
NAMES = ("count", "nunique", "sum", "mean", "median", "min", "max", "var", "std", "skew", "sem", "quantile")
N = None
EXPECTED = {  # from pandas groupby("k")["v"]
    "a": (1, 1, 1, 1, 1, 1, 1, N, N, N, N, 1),
    "b": (2, 2, 4, 2, 2, 1, 3, 2, 1.41421, N, 1, 2),
    "c": (3, 3, 12, 4, 2, 1, 9, 19, 4.3589, 1.63006, 2.51661, 2),
    "d": (3, 1, 15, 5, 5, 5, 5, 0, 0, 0, 0, 5),
    "e": (0, 0, 0, N, N, N, N, N, N, N, N, N),
    "f": (4, 3, 12, 3, 2, 1, 7, 7.33333, 2.70801, 1.8128, 1.35401, 2),
}


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame(ROWS, "k string, v double")
    out = df.where(F.col("k").isNotNull()).groupBy("k").agg(*stats("v", "v", NAMES))
    return {r["k"]: r for r in out.collect()}


def test_null_key_forms_no_group(result):
    assert set(result) == set(EXPECTED)


@pytest.mark.parametrize("k", sorted(EXPECTED))
def test_nine_statistics(result, k):
    for name, want in zip(NAMES, EXPECTED[k]):
        got = result[k][f"v_{name}"]
        if want is None:
            assert got is None or (isinstance(got, float) and math.isnan(got)), (k, name, got)
        else:
            assert got == pytest.approx(want, rel=1e-4, abs=1e-5), (k, name, got)


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("x", v) for v in (3, 1, 3, 1, 2)] + [("y", 7)], "k string, h int")
    r = {row["k"]: row for row in value_profile(df, "k", {"h": "h"}).collect()}
    assert (r["x"]["h_mode"], r["x"]["h_mode_count"], r["x"]["h_nunique"]) == (1, 2, 3)
    assert (r["y"]["h_mode"], r["y"]["h_mode_count"], r["y"]["h_nunique"]) == (7, 1, 1)
    neg = spark.createDataFrame([("z", v) for v in (-5, 3, -5, 3, -7)], "k string, h int")
    z = value_profile(neg, "k", {"h": "h"}).first()
    assert (z["h_mode"], z["h_mode_count"], z["h_nunique"]) == (-5, 2, 3)


@pytest.mark.parametrize("mode", ["exact", "ranked"])
def test_quantile_strategies_agree(spark, mode):
    from behaviorkit.operators.features import usage_features
    rows = [(k, f"b{i % 3}", float(v), "202001") for k, vs in (("a", [1, 3]), ("c", [1, 2, 9]), ("f", [1, 7, 2, 2]))
            for i, v in enumerate(vs)]
    app = spark.createDataFrame(rows, "phone_no_m string, busi_name string, flow double, month_id string")
    r = {x["phone_no_m"]: x for x in usage_features(app, q=0.25, quantiles=mode).collect()}
    assert (r["a"]["flow_median"], r["c"]["flow_median"], r["f"]["flow_median"]) == (2.0, 2.0, 2.0)
    assert (r["a"]["flow_quantile"], r["c"]["flow_quantile"], r["f"]["flow_quantile"]) == (1.5, 1.5, 1.75)


def test_column_quantiles_hot_key(spark):
    from behaviorkit.operators.quantiles import keyed_quantiles
    # one key holds most rows; results must equal the exact percentile
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("k"),
                                     ((F.col("id") * 7919) % 1013).cast("double").alias("x"))
    got = {r["k"]: r["x_p"] for r in keyed_quantiles(df, ["k"], {"x": "x"}, {"p": 0.39}).collect()}
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("x", 0.39).alias("p")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_approx_distinct_close_to_exact(spark):
    from behaviorkit.operators.features import voice_features
    rows = [(k, o, 1 + (o % 2), float(o), "2024-01-01 10:00:00", o % 3, o % 5, o % 7)
            for k in range(3) for o in range(40 * (k + 1))]
    voc = spark.createDataFrame(rows, "phone_no_m long, opposite_no_m int, calltype_id int, call_dur double, "
                                      "start_datetime string, imei_m int, city_name int, county_name int")
    ex = {r["phone_no_m"]: r for r in voice_features(voc).collect()}
    ap = {r["phone_no_m"]: r for r in voice_features(voc, distinct="approx").collect()}
    for k in ex:
        for c in ("city_name_nunique", "county_name_nunique", "calltype_id_unique", "imeis"):
            assert abs(ap[k][c] - ex[k][c]) <= max(1, 0.05 * ex[k][c])


def test_brackets_find_the_order_statistics(spark, monkeypatch):
    import numpy as np
    from behaviorkit.operators import quantiles
    monkeypatch.setattr(quantiles, "CAP", 40)
    monkeypatch.setattr(quantiles, "BUCKETS", 64)
    rng = np.random.default_rng(3)
    cases = {"uniform": rng.uniform(-5, 5, 900), "powers": 2.0 ** rng.integers(-40, 40, 300), "ties": rng.integers(0, 3, 800) * 1.5,
             "one": np.full(400, 7.25), "few": rng.normal(size=9), "wide": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=300)]),
             "ends": np.concatenate([[-np.inf] * 30, [np.inf] * 30, rng.normal(size=100)]), "single": np.array([3.0])}
    rows = [(k, float(x), float(-x)) for k, v in cases.items() for x in v] + [("few", None, float("nan")), ("none", None, None), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    levels = {"a": 0.1, "med": 0.5, "hi": 1.0}
    got = {r["k"]: r for r in quantiles.keyed_quantiles(df, ["k"], {"x": "x", "y": "y"}, levels).collect()}
    assert set(got) == {*cases, None}
    for k, v in cases.items():
        s = np.sort(v)
        for sign, name in ((1, "x"), (-1, "y")):
            t = s if sign == 1 else -s[::-1]
            for level, q in levels.items():
                pos = (len(t) - 1) * q
                low, high = float(t[int(np.floor(pos))]), float(t[int(np.ceil(pos))])
                want = low + (pos - np.floor(pos)) * (high - low)
                assert got[k][f"{name}_{level}"] == want or math.isnan(want), (k, name, level)


def test_quantiles_without_a_range_exchange(spark):
    import __spark_entry__ as E
    for name in ("usage_features", "voice_features", "column_quantiles"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan, name


def test_usage_distinct_counts_do_not_expand_rows(spark):
    rows = [(1, 1, 2.0, "a"), (1, 1, 3.0, "b"), (1, None, None, "b"), (1, 2, -0.0, None), (2, None, 1.0, None), (None, 5, 1.0, "a")]
    df = spark.createDataFrame(rows, "phone_no_m long, busi_name int, flow double, month_id string")
    got = feat.usage_features(df)
    assert sorted((r["phone_no_m"], r["busi_count"], r["month_ids"], r["flow_median"], r["flow_sum"]) for r in got.collect()) == [(1, 2, 2, 2.0, 5.0), (2, 0, 0, 1.0, 1.0)]
    plan = got._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Window" not in plan     # one row a record, whatever the number of counts; groups are sorted as arrays
