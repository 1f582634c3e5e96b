"""Ranked lexical search against scores of every pair."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from behaviorkit.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(docs, items, k=20):
    counted = [(key, Counter(_terms(t))) for key, t in docs]
    counted = [(key, c) for key, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in _terms(text) if t in c)
            if s > 0:
                scores.append((-s, key is not None, key))
        scores.sort()
        out += [(item, r, key, -s) for r, (s, _, key) in enumerate(scores[:k], 1)]
    return Counter(out)


def test_terms():
    for t in ("", None, "Don't STOP-it 3.5 ÀÉß ΑΣ İ x_y\0z\x7f日本語、テ 😀a퟿", " \t\n"):
        assert [w.decode() for part in lexical.terms(t) for w in part] == _terms(t)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 7)
    for t in ("abc defghi jklmnopqrstuv wx  yz", "nospaceatallinthistext", "a b c d e f g h i", "x " * 40 + "abcdefghijklmnop"):
        assert [w.decode() for part in lexical.terms(t) for w in part] == _terms(t)


def test_query_against_every_pair(spark, documents):
    got = Counter(map(tuple, queries.op11(spark, "/root/testdata/sf0.001").collect()))
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    want = _plain([(r["doc_id"], r["text"]) for r in documents.collect()], items)
    assert got == want and len(got) > 100
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    assert Counter(con.execute(queries.ORACLE["op11_lexical_search"]).fetchall()) == want


@pytest.mark.parametrize("seed,sample,groups", [(1, 20, 10**6), (2, 4096, 60), (3, 50, 100)])
def test_ties_copies_and_groups_of_items(spark, seed, sample, groups):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    copy = text(9)
    docs = [(i, text(rng.randint(0, 12))) for i in range(300)] + [(1000 - i, copy) for i in range(150)] + [(None, copy), (None, None), (7, copy), (7, copy)]
    rng.shuffle(docs)
    items = [(i % 9, text(rng.randint(0, 8))) for i in range(12)] + [(None, copy), (3, None), (4, "unseen")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = Counter(map(tuple, lexical.rank(d, i, k=20, sample=sample, group_chars=groups).collect()))
    assert got == _plain(docs, items)


def test_odd_rows(spark, odd, no_rows):
    items = spark.createDataFrame([(1, "quick fox"), (2, "word kleiner"), (3, "日本語のテキスト"), (4, None), (5, "")], "item_id long, text string")
    got = Counter(map(tuple, lexical.rank(odd, items, k=3).collect()))
    assert got == _plain([(r["doc_id"], r["text"]) for r in odd.collect()], items.collect(), 3)
    assert lexical.rank(no_rows, items).count() == 0 and lexical.rank(odd, items.limit(0)).count() == 0
    named = odd.selectExpr("cast(doc_id as string) name", "text body")
    rows = lexical.rank(named, items, key="name", text="body").collect()
    assert {r["name"] for r in rows if r["item_id"] == 3} == {"7"}


def test_bounds_leave_out_batches_and_no_result():
    rng = np.random.default_rng(5)
    size, n, items = 200, 1500, 40
    # four groups of terms, like languages, from which an item or a document draws
    weights = rng.integers(1, 9000, size)
    draw = lambda n: np.sort(1 + rng.integers(0, 4) * 45 + rng.choice(45, n, False))
    vectors = [{int(t): int(weights[t]) for t in draw(6)} for _ in range(items)]
    for exact in (np.float64, np.int64):
        tree = lexical.Items(vectors, size)
        tree.exact = exact
        sizes = rng.integers(1, 9, n)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        which = np.concatenate([draw(s) for s in sizes])
        impact = rng.integers(1, 10**6, len(which))
        search = lexical.Search(tree, [0] * items, 5)
        search.add(list(range(n)), ends, which, impact, weights.astype(np.float64))
        dense = np.zeros((n, size), np.int64)
        dense[np.repeat(np.arange(n), sizes), which] = impact
        flat = np.zeros((items, size), np.int64)
        for i, v in enumerate(vectors):
            flat[i, list(v)] = list(v.values())
        scores = dense @ flat.T
        want = {(i, int(scores[d, i]), d) for i in range(items) for d in sorted(range(n), key=lambda d: (-scores[d, i], d))[:5] if scores[d, i] > 0}
        assert set(search.results()) == want
        assert search.scored < 0.6 * n * items, search.scored / n / items
