"""Quality, language and mixing: held-out accuracy, brute force and edge cases."""

import math
from fractions import Fraction
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorkit.llm import langid, mixing, quality, queries


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = np.zeros(len(good), np.int64)
    right = np.linspace(0.75, 0.97, len(quality.LABELLERS))
    for k, p in enumerate(right):
        v = np.where(rng.random(len(good)) < p, good, ~good)
        vote = np.where(rng.random(len(good)) < 0.1, quality.NONE, np.where(v, quality.GOOD, quality.BAD))
        votes += vote * 3 ** k
    codes, at, counts = np.unique(votes, return_inverse=True, return_counts=True)
    post, share, table = quality.estimate(codes, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    assert ((post[at] > 0.5) == good).mean() > 0.98
    assert np.abs(table[0, :, quality.GOOD] - right).max() < 0.03


def test_quality_against_labels(spark):
    """The labels are not read by the operator, so all of them are held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.classify(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(x["quality"], x["keep"]): x["count"] for x in r}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_quality_edges(odd, no_rows):
    rows = quality.classify(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["quality_score"] == 0 and not by[i]["keep"] for i in (2, 3, 4))
    assert all(0 <= r["quality_score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert quality.accepted(odd).columns == odd.columns
    assert quality.classify(no_rows).count() == quality.accepted(no_rows).count() == 0


def _plain_profile(texts, top):
    import collections
    import unicodedata
    count = collections.Counter()
    for t in texts:
        marked = [c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()]
        for word in "".join(marked).split():
            s = f"_{word}_"
            count.update(word)
            count.update(s[i:i + 2] for i in range(len(s) - 1))
            count.update(s[i:i + 3] for i in range(len(s) - 2))
    return count


def test_gram_counts_are_the_plain_ones():
    table = langid.letter_table()
    text = "Ab ab, ÉÉ-a 1 日本"
    codes, counts = langid.gram_counts(langid.letters(text, table))
    want = _plain_profile([text], 99)

    def name(code):
        c = [(code >> s) & 0x1FFFFF for s in (42, 21, 0)]
        two = code < 0
        c = [x & 0x1FFFFF for x in ((code >> 21) & 0x1FFFFF, code & 0x1FFFFF)] if two else (c if code >> 42 or code >> 21 else c[2:])
        return "".join(chr(x) if x else "_" for x in c)

    got = {name(int(c)): int(n) for c, n in zip(codes, counts)}
    assert sum(got.values()) == sum(want.values())
    assert sorted(got.values()) == sorted(want.values())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.learn(docs.where(~held))).where(held)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_language_edges(odd, no_rows):
    profiles = langid.learn(odd)
    rows = langid.identify(odd, profiles).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4))
    assert langid.accepted(odd).columns == odd.columns
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(no_rows)).collect()} == {"und"}
    assert langid.accepted(no_rows).count() == 0


def test_quotas_fill_the_period_without_lifting_small_weights():
    rng = Random(4)
    for _ in range(50):
        weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randint(1, 30))}
        period = mixing.period_of(weights, 30)
        parts, total = mixing.quotas(weights, period), sum(weights.values())
        assert sum(parts.values()) == period and all(abs(parts[s] - weights[s] / total * period) < 1 for s in weights)
    parts = mixing.quotas({"a": 1.0, "b": 1e-12, "c": 1e-12}, mixing.MAX_PERIOD)
    assert parts == {"a": mixing.MAX_PERIOD - 2, "b": 1, "c": 1} and mixing.quotas({}, 5) == {}


def _plain_schedule(blocks, weights, period):
    """(source, block) of every slot: earliest deadline first with exact fractions, anew when a source ends; and the phases' weights."""
    left, number, out, shares = dict(blocks), dict.fromkeys(blocks, 0), [], []
    while left:
        goal = {s: weights[s] for s in left}
        n = mixing.period_of(goal, period)
        w = {s: Fraction(k, n) for s, k in mixing.quotas(goal, n).items()}
        done, slot = dict.fromkeys(left, 0), 0
        shares.append((len(out), w))
        while True:
            ready = [(math.ceil((done[s] + 1) / w[s]), s is None, s or "") for s in left if math.floor(done[s] / w[s]) <= slot]
            deadline, _, s = min(ready)
            s = None if min(ready)[1] else s
            assert deadline > slot
            out.append((s, number[s]))
            done[s] += 1
            number[s] += 1
            slot += 1
            if done[s] == left[s]:
                break
        left = {x: r - done[x] for x, r in left.items() if r > done[x]}
    return out, shares


def _deviation(turns, shares):
    """Largest distance of any source from its share after any slot of a phase, while it has blocks."""
    worst = 0.0
    for (start, w), (end, _) in zip(shares, shares[1:] + [(len(turns), None)]):
        done = dict.fromkeys(w, 0)
        for slot in range(start, end):
            done[turns[slot]] += 1
            worst = max(worst, max(abs(done[s] - float(w[s]) * (slot + 1 - start)) for s in w))
    return worst


@pytest.mark.parametrize("n", [1, 3, 20, 100])
def test_phases_are_the_plain_schedule(n):
    rng = Random(n)
    for alpha in (0.0, 0.7, 1.0):
        blocks = {(f"s{i}" if i else None): rng.randint(1, 400 if n < 50 else 40) for i in range(n)}
        weights = {s: b ** alpha * rng.uniform(0.5, 2) for s, b in blocks.items()}
        want, shares = _plain_schedule(blocks, weights, 37)
        got = {}
        for phase in mixing.phases(blocks, weights, 37):
            for s, at in phase["at"].items():
                for j in range(blocks[s] - phase["first"][s]):
                    turn, k = divmod(j, phase["parts"][s])
                    slot = turn * phase["period"] + (at[k] if k < len(at) else phase["length"])
                    if slot < phase["length"]:
                        got[phase["start"] + slot] = (s, phase["first"][s] + j)
        assert [got[i] for i in range(len(got))] == want and len(want) == sum(blocks.values())
        assert _deviation([s for s, _ in want], shares) < 1


def _plain_order(rows, block, weights=None):
    """(key, source, size, block) of every row and the plain schedule."""
    sizes, placed = {}, []
    for key, s, n in sorted(rows, key=lambda r: (r[1] or "", r[0] is not None, r[0] or 0, r[2])):
        at = sizes.get(s, 0)
        placed.append((key, s, n, (at - (n == 0 and at > 0)) // block))
        sizes[s] = at + n
    weights = weights or mixing.tempered(sizes)
    schedule, shares = _plain_schedule({s: max(-(-n // block), 1) for s, n in sizes.items()}, weights, 1000)
    return placed, {turn: slot for slot, turn in enumerate(schedule)}, schedule, shares


def test_order_against_plain_schedule(spark, documents, odd, no_rows):
    for docs, block in ((documents, 3000), (odd, 3000), (documents, 20_000)):
        rows = [tuple(r) for r in docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long")).collect()]
        placed, slot, _, _ = _plain_order(rows, block)
        got = sorted((tuple(r) for r in mixing.order(docs, block=block).collect()), key=repr)
        assert got == sorted([(k, s, n, b, slot[s, b], True) for k, s, n, b in placed], key=repr)
    named = mixing.order(documents, {"src0": 3.0, "src1": 1.0, "absent": 5.0}).collect()
    assert all((r["slot"] is None) == (r["source"] not in ("src0", "src1")) for r in named)
    assert mixing.order(no_rows).count() == mixing.mixture(no_rows).count() == 0 and mixing.mixture(odd).columns == odd.columns


def test_query_deviates_by_less_than_a_block(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in queries.op3(spark, "/root/testdata/sf0.01").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long")).collect()]
    placed, slot, schedule, shares = _plain_order(rows, 20_000)
    assert sorted(got) == sorted((k, s, n, b, slot[s, b], True) for k, s, n, b in placed)
    assert _deviation([s for s, _ in schedule], shares) < 1


def test_mixture_keeps_every_row_in_weighted_order(spark, odd):
    rows = [(i, "big", "x" * 50) for i in range(600)] + [(1000 + i, "mid", "x" * 50) for i in range(100)] + [(2000, "tiny", "x"), (2001, "tiny", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"big": 0.75, "mid": 0.2499, "tiny": 0.0001}
    got = mixing.order(docs, weights, block=100).collect()
    assert len(got) == len(rows) and all(r["in_mix"] for r in got)
    turns = [s for _, s in sorted({(r["slot"], r["source"]) for r in got})]
    assert len(turns) == 351
    mixed = mixing.mixture(docs, weights, block=100)
    slot = {r["doc_id"]: r["slot"] for r in got}
    order = [slot[r["doc_id"]] for r in mixed.collect()]
    assert len(order) == len(rows) and order == sorted(order)
    assert mixing.mixture(odd, block=3000).count() == odd.count()
    assert mixing.mixture(docs, {"mid": 1.0}).count() == 100


def test_many_sources(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.lit("text").alias("text"))
    rows = mixing.order(docs, period=10, block=4).collect()
    assert sorted(r["slot"] for r in rows) == list(range(600))


def test_close_languages_do_not_hide_a_wrong_one(spark):
    es = "el perro corre por la calle y la casa es muy grande porque el tiempo es bueno para todos los amigos de la ciudad "
    de = "der hund läuft durch die straße und das haus ist sehr groß weil das wetter gut ist für alle freunde in der stadt "
    rows = [(i, es, "es" if i % 2 else "es-MX") for i in range(40)] + [(100 + i, de, "de") for i in range(20)]
    wrong = [(1000, es, "de"), (1001, de, "es"), (1002, es, "de")]
    kept = [(2000, es, None), (2001, es, "es")]
    none = [(3000, "12 34", "es"), (3001, None, None)]
    docs = spark.createDataFrame(rows + wrong + kept + none, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert got == {r[0] for r in rows + kept}
    profiles = langid.learn(docs.where("doc_id < 1000")).collect()
    known, table = langid.Profiles(langid.profile_table(profiles, 400), 400), langid.letter_table()
    assert known.predict(es, table)[2] < 0.15 <= known.lead(es, "de", table)
    assert known.lead(es, "xx", table) == known.predict(es, table)[2] and known.lead("12", "es", table) is None


def test_quality_draw_at_any_size(spark, monkeypatch):
    assert quality.last_hash(4000, 10) == quality.last_hash(10, 10) == 2**63 - 1
    for rows in (10**6, 4 * 10**10, 10**15):
        assert abs((quality.last_hash(4000, rows) + 2**63 + 1) / 2**64 * rows / 4000 - 1) < 1e-3
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counted = quality.label_counts
    monkeypatch.setattr(quality, "label_counts", lambda *a: counted(*a).withColumn("count", F.col("count") * 10**9))
    model = quality.fit(docs, train_rows=100)                # as of 2e11 rows: the draw itself takes none of these
    assert np.abs(model.weights).max() > 0
    blank = docs.select("doc_id", F.lit(" ").alias("text"))
    assert np.abs(quality.fit(blank, train_rows=100).weights).max() == 0


def test_mixture_of_rows_that_share_a_key(spark):
    rows = [(1, "a", "x" * n) for n in (10, 20, 500)] + [(2, "a", "y" * 10), (2, "b", "z" * 10), (None, "b", "z"), (None, "b", "zz"), (1, "a", "x" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(map(repr, map(tuple, mixing.mixture(docs, block=30).collect()))) == sorted(map(repr, rows))
