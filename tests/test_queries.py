"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from behaviorkit.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# The boosted fits take minutes each; their operators have tests of their own (test_models.py).
SLOW = [n for n in E.queries() if n.startswith("gbt_")]
# Scores of learners have no SQL; test_boosting.py and test_text_model.py hold them against plain versions.
SCORES = {"boosted_cv", "boosted_scores", "text_scores", "stacked_gain"}
ALL = sorted(n for n in E.queries() if n in E.oracle_sql() and n not in SLOW and not n.startswith("op"))


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return None if v is None else repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_base_query_has_an_oracle():
    own = {n for n in E.queries() if not (n.startswith("op") or n == "pipeline")}
    assert own - SCORES <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, rows) == _canon(dcols, cur.fetchall())


def test_entry_has_every_user(spark, con):
    rows = E.entry(spark).select("phone_no_m", "split").collect()
    want = con.execute("select c_custkey from customer").fetchall()
    assert {r["phone_no_m"] for r in rows} == {w[0] for w in want}
    assert {r["split"] for r in rows} == {"train", "april", "final"}
