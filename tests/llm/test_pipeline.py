"""The pipeline against a plain run of its stages on a small table, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from behaviorkit.llm import langid, quality, simhash
from behaviorkit.llm.common import written, written_place
from test_selection import _plain_order


def _plain_stages(docs):
    """Keys that the first four stages keep, in the order of the mixture, by the documented rules: trained models, plain decisions."""
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    model, table, fold = quality.fit(docs.select("doc_id", "text")), quality._class_table(), quality._fold()

    def good(t):
        x = quality.features(t, table, fold)
        return x is not None and 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1]))) >= 0.5

    rows = [r for r in rows if good(r["text"])]
    learned = langid.learn(docs.sparkSession.createDataFrame(rows).where(~langid.held_out(F.col("doc_id")))).collect()
    known = langid.Profiles(langid.profile_table(learned, 400), 400)
    letters = langid.letter_table()

    def spoken(r):
        scores = known.scores(r["text"], letters)
        if scores is None:
            return False
        best = dict(zip(known.langs, scores))
        other = sorted(scores)[-2] if len(scores) > 1 else 0.0
        return r["lang"] is None or max(scores) - best.get(r["lang"], other) < 0.15

    rows = sorted((r for r in rows if spoken(r)), key=lambda r: r["doc_id"])
    prints = [simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    keep = [r for i, r in enumerate(rows) if up[i] == i]
    placed, slot, _, _ = _plain_order([(r["doc_id"], r["source"], len(r["text"])) for r in keep], 20_000)
    return [k for _, k in sorted((slot[s, b], k) for k, s, _, b in placed)]


def test_pipeline_against_plain_stages(spark, documents):
    want = _plain_stages(documents)
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        in_order = [r["doc_id"] for r in docs.collect()]
        docs = written(docs, name)
    assert in_order == want
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in out} == set(want)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 1024


@pytest.mark.parametrize("rows", ["odd", "no_rows"])
def test_stages_on_odd_rows(spark, rows, request):
    docs = request.getfixturevalue(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert (out.count() > 0) == (rows == "odd")


def test_sequences_follow_the_mixture(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name)

    def packed(rows):
        out = {}
        for r in corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001").collect():
            out.setdefault(r["sequence_id"], []).append(r["doc_id"])
        return out

    place = {r["doc_id"]: i for i, r in enumerate(docs.select("doc_id").orderBy(written_place()).collect())}
    mixed = packed(docs)
    first = [min(place[k] for k in mixed[i]) for i in range(len(mixed))]
    assert first == sorted(first)
    backwards = written(docs.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "backwards")
    other = packed(backwards)
    assert len(other) == len(mixed) and max(map(max, other.values())) in other[0] and other[0] != mixed[0]
