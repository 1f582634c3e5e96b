"""Periodic runs against a search over every period."""

import hashlib
import random
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from behaviorkit.llm import periodic, queries


def _plain_runs(words, least=12):
    """For each period the maximal stretches of equal words that far apart; a stretch counts under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= 2 * q and not any((start, length) == (s, m) for s, m in found):
                found[start, length] = q
            i = j
    return sorted(((s, m, q) for (s, m), q in found.items() if m >= least), key=lambda r: (r[0], r[2]))


def _plain_row(doc_id, text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _bytes(words):
    return [str(w).encode() for w in words]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([2, 5, 12]))
def test_small_alphabets(texts, least):
    assert periodic.runs([_bytes(t) for t in texts], least) == [_plain_runs(t, least) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_repeated_stretches(parts):
    words = [w for p, k in parts for w in p * k]
    assert periodic.runs([_bytes(words)]) == [_plain_runs(words)]


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_blocks_of_ordered_sets(monkeypatch, block):
    monkeypatch.setattr(periodic, "_BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        words = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))] * rng.randint(1, 6) + [rng.randint(0, 3) for _ in range(20)]
        assert periodic.runs([_bytes(words)], 4) == [_plain_runs(words, 4)]
    held = periodic.Positions(list(range(0, 50, 5)))
    for x in (1, 49, 51, 77, 2, 3):
        held.add(x)
    assert list(held) == sorted({*range(0, 50, 5), 1, 49, 51, 77, 2, 3}) and held.around(4) == (3, 5) and held.around(90)[1] == -1


def test_copies_of_a_document_do_not_meet():
    words = _bytes(range(40))
    assert periodic.runs([words, words, words[:20] + words[:20]]) == [[], [], [(0, 40, 20)]]


def test_query_against_every_period(spark, documents):
    got = sorted(map(tuple, queries.op13(spark, "/root/testdata/sf0.001").collect()))
    want = sorted(_plain_row(r["doc_id"], r["text"]) for r in documents.where("length(text) < 30000").collect())
    ids = {w[0] for w in want}
    assert [g for g in got if g[0] in ids] == want and len(got) == documents.count()
    assert sum(g[1] for g in got) > 10


def test_odd_rows(spark, odd, no_rows):
    got = Counter(tuple(r) for r in periodic.summary(periodic.find_runs(odd)).collect())
    flat = [r["text"] for r in odd.collect()]
    rows = {"word " * 20_000: [(0, 20_000, 1)]}
    want = Counter()
    for r in odd.collect():
        found = rows.get(r["text"])
        if found is None:
            row = _plain_row(None, r["text"])
        else:
            row = (None, 1, 0, 20_000, 1, 20_000_000, hashlib.sha256(b"0,20000,1\n").hexdigest(), hashlib.sha256(b"word").hexdigest())
        want[(r["doc_id"], *row[1:])] += 1
    assert got == want and len(flat) == sum(got.values())
    assert periodic.find_runs(no_rows).count() == 0


def test_very_long_texts_take_time_in_proportion():
    took = []
    for n in (50_000, 200_000):
        began = time.time()
        assert periodic.runs([[b"a"] * n, [b"%d" % (i % 7) for i in range(n)]]) == [[(0, n, 1)], [(0, n, 7)]]
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1
