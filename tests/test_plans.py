"""Physical-plan checks: pruning and pushdown reach the scan, no Python in the feature path,
keep-last without a window."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_usage_features_prunes_columns(spark):
    plan = _plan(spark, "usage_features")
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan parquet" in line]
    assert schemas
    for line in schemas:
        assert "l_orderkey" not in line and "l_comment" not in line and "l_quantity" not in line


def test_voice_features_pushdown_and_no_python(spark):
    plan = _plan(spark, "voice_features")
    assert "PushedFilters: [" in plan and "In(event_type" in plan
    assert "EvalPython" not in plan and "ArrowEvalPython" not in plan


def test_keep_last_is_an_aggregate_not_a_window(spark):
    plan = _plan(spark, "last_event_per_user")
    assert "Window" not in plan and "Aggregate" in plan


def test_tokeniser_runs_without_python(spark):
    plan = _plan(spark, "char_tokens")
    assert "Python" not in plan and "Pandas" not in plan
