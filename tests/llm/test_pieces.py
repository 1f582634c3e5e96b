"""SentencePiece encoding and decoding against the library on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from behaviorkit.llm import pieces, queries
from behaviorkit.llm.tokens import vocabulary_path

MODEL = vocabulary_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "▁", "a▁b ▁ c", "\n", "a\n\n b\tc", "a\0b \0", "日本語 テキスト　全角", "é́ é ﬁ Å", "<s> </s> <unk> a<s>b",
         "<0x0A> x", "😀😀 🏳️‍🌈", "don't  STOP!!", "x" * 5000, "word " * 5000, " " * 500 + "x" + " " * 37, "١٢٣ नमस्ते ไทย"]


def _plain(text):
    ids = LIBRARY.encode(text or "")
    return ids, LIBRARY.decode(ids)


def _digests(text):
    ids, back = _plain(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("entries", [1, 300_000])
def test_ids_are_the_librarys(documents, odd, entries):
    p = pieces.Pieces(MODEL, entries=entries)
    assert p.separable
    texts = TEXTS + [r["text"] for r in documents.collect()] + [r["text"] for r in odd.collect()]
    for part in (texts[:30], texts[30:], texts[:5], [None, "x"], []):
        for t, raw in zip(part, p.encode_all(part)):
            ids, back = _plain(t)
            assert np.frombuffer(raw, "<u4").tolist() == ids and p.decode(raw) == back and p.written(raw) == ",".join(map(str, ids))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ▁ab\nthe.,éß日😀\0\t-") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    p = test_any_text.p
    assert np.frombuffer(p.encode_all([text])[0], "<u4").tolist() == LIBRARY.encode(text)


test_any_text.p = pieces.Pieces(MODEL, entries=500)


def test_whole_texts_where_words_depend_on_each_other():
    p = pieces.Pieces(MODEL)
    p.separable = False
    assert [np.frombuffer(b, "<u4").tolist() for b in p.encode_all(TEXTS)] == [LIBRARY.encode(t) for t in TEXTS]


def test_query_against_the_library(spark, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: _digests(r["text"]) for r in documents.collect()}


def test_odd_rows(odd, no_rows):
    got = Counter(tuple(r) for r in pieces.round_trip_digests(odd, MODEL).collect())
    assert got == Counter((r["doc_id"], *_digests(r["text"])) for r in odd.collect())
    back = pieces.decode(pieces.encode(odd, MODEL, name="coded"), MODEL, ids="coded", name="back")
    assert back.columns == [*odd.columns, "coded", "back"]
    assert all(r["back"] == (r["text"] or "") for r in back.collect())
    assert pieces.round_trip_digests(no_rows, MODEL).count() == 0


def test_very_long_texts(spark):
    texts = ["".join(chr(97 + i * i % 23) for i in range(300_000)), "two words " * 300_000, "\n" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.round_trip_digests(df, MODEL).collect()}
    assert got == {i: _digests(t) for i, t in enumerate(texts)}
