"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

1. Nine overlapping labellers vote good, bad or nothing on every text.  The votes of a text are one
   code, and the corpus is reduced to a count per code (at most 3^9 rows), over all texts.
2. Expectation-maximisation on those counts estimates the share of good texts and, per labeller, how
   it votes on good and on bad texts; the result is a posterior per code.
3. A bounded, documented sample (``train_rows``) with its posteriors trains a logistic scorer on
   hashed features: n-grams of character classes and repeated words.  No label table is read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import give_back

LABELLERS = ("upper_case", "symbols", "bare_symbols", "echoed_words", "variety", "punctuation", "repeated_lines", "capitals",
             "doubled_marks")
GOOD, BAD, NONE = 0, 1, 2
DIMS = 1024                      # hashed features
_CLASSES = 16


def _class_table() -> np.ndarray:
    """Character class of each byte: a few marks of their own, then kinds; bytes of other scripts are letters."""
    t = np.full(256, 1, np.uint8)                                   # other marks
    t[[9, 10, 11, 12, 13]] = 2
    t[32] = 3
    t[ord("a"):ord("z") + 1] = 4
    t[ord("A"):ord("Z") + 1] = 5
    t[ord("0"):ord("9") + 1] = 6
    t[128:] = 4
    for k, marks in enumerate((".", ",", ";:?", "!", "|", "*#", "$%&", "'\"()-", "<>[]{}=/\\"), 7):
        t[[ord(c) for c in marks]] = k
    t[:9], t[14:32], t[127] = 0, 0, 0                               # control characters
    return t


def _fold() -> np.ndarray:
    """Hash of each class trigram into the feature slots, two slots left for word repetition."""
    x = np.arange(_CLASSES ** 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % (DIMS - 2)


def _words(text: str) -> tuple[np.ndarray, list[bytes], bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8), raw.split(), raw


def _grade(x: float, bad: float, good: float) -> int:
    """Vote by a share: at least ``bad`` is bad, at most ``good`` is good (either order)."""
    if bad > good:
        return BAD if x >= bad else GOOD if x <= good else NONE
    return BAD if x <= bad else GOOD if x >= good else NONE


def votes(text: str | None, table: np.ndarray) -> int:
    """Code of the labellers' votes, base 3; a text without a word gets no vote at all."""
    data, words, raw = _words(text or "")
    if not words:
        return sum(NONE * 3 ** k for k in range(len(LABELLERS)))
    c = table[data]
    kind = np.bincount(c, minlength=_CLASSES)
    n, letters = len(words), max(int(kind[4] + kind[5]), 1)
    marks = int(kind[10] + kind[11] + kind[12] + kind[13] + kind[15])
    doubled = int(((c[1:] == c[:-1]) & (c[1:] >= 7)).sum())
    lower = raw.lower().split()
    echoes = sum(a == b for a, b in zip(lower, lower[1:]))
    bare = sum(not w.strip(b"|!*#$%&<>[]{}=/\\+~^_@-") for w in words)
    ended = sum(w[-1] in b".,;:?" for w in words)
    capital = sum(65 <= w[0] <= 90 for w in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(map(len, lines)) - sum(map(len, set(lines)))
    v = (
        _grade(kind[5] / letters, 0.25, 0.08) if letters >= 20 else NONE,
        _grade(marks / n, 0.15, 0.01),
        _grade(bare / n, 0.10, 0.005),
        _grade(echoes / n, 0.15, 0.02) if n >= 5 else NONE,
        _grade(len(set(lower)) / (2 * n) ** 0.5, 1.0, 2.5) if n >= 20 else NONE,
        _grade(ended / n, 0.01, 0.04) if n >= 20 else NONE,
        _grade(again / max(sum(map(len, lines)), 1), 0.5, 0.05) if len(lines) >= 4 else NONE,
        _grade(capital / n, 0.5, 0.3) if n >= 5 else NONE,
        _grade(doubled / n, 0.10, 0.01),
    )
    return sum(x * 3 ** k for k, x in enumerate(v))


def features(text: str | None, table: np.ndarray, fold: np.ndarray) -> np.ndarray | None:
    """Hashed features, square roots of shares (unit length); None for a text without a word."""
    data, words, raw = _words(text or "")
    if not words:
        return None
    c = table[np.concatenate(([10], data, [10, 10]))].astype(np.int32)
    grams = np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES ** 3)
    out = np.bincount(fold, weights=grams, minlength=DIMS) / len(data)
    lower = raw.lower().split()
    out[DIMS - 2] = sum(a == b for a, b in zip(lower, lower[1:])) / len(words)
    out[DIMS - 1] = 1 - len(set(lower)) / len(words)
    return np.sqrt(out / out.sum()).astype(np.float32)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM: (posterior of good per code, share of good, table[class, labeller, vote]) from code counts.

    ``table`` is the distribution of a labeller's votes on good (0) and bad (1) texts where it votes;
    no vote says nothing.  The start takes any bad vote for a bad text; a mild prior says that
    labellers are right on good texts.
    """
    v = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    one_hot = np.eye(3)[v][:, :, :2]                                # code, labeller, vote
    post = np.where((v == BAD).any(axis=1), 0.05, 0.95)
    prior = np.array([[[20.0, 0.2]], [[1.0, 1.0]]])
    share, table = 0.5, np.full((2, len(LABELLERS), 2), 0.5)
    for _ in range(rounds):
        weight = np.stack((post, 1 - post)) * counts
        share = float((weight[0].sum() + 1) / (counts.sum() + 2))
        table = np.einsum("kc,clv->klv", weight, one_hot) + prior
        table /= table.sum(axis=2, keepdims=True)
        score = np.einsum("clv,klv->kc", one_hot, np.log(table)) + np.log([[share], [1 - share]])
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, share, table


def train(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, rounds: int = 400) -> np.ndarray:
    """Weights (last: constant) of a logistic scorer for soft labels, by accelerated gradient steps.

    Feature rows have unit length, so with the constant a step of 2 is below the curvature bound.
    """
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -80, 80)))
        new = v - np.float32(2) * (x.T @ (p - y).astype(np.float32) / max(len(x), 1) + np.float32(l2) * v)
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w.astype(np.float64)


def label_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(votes, count)`` over all texts."""
    return docs.select(_votes()(F.col(text)).alias("votes")).groupBy("votes").count()


def _votes():
    @F.pandas_udf("int")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _class_table()
        for texts in batches:
            yield pd.Series([votes(t, table) for t in texts], dtype="int32")
            del texts
        give_back()

    return vote


class Model:
    """Posterior per vote code and the trained weights; what ``score`` needs."""

    def __init__(self, codes: list[int], posterior: list[float], weights: np.ndarray, share: float, accuracy: dict):
        self.codes, self.posterior, self.weights, self.share, self.accuracy = codes, posterior, weights, share, accuracy


def last_hash(wanted: int, rows: int) -> int:
    """Largest 64-bit hash of a draw of about ``wanted`` out of ``rows`` rows."""
    return min((1 << 64) * wanted // max(rows, 1), (1 << 64)) - (1 << 63) - 1


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = 4000) -> Model:
    """Accuracies from all texts, weights from about ``train_rows`` rows drawn by the hash of key and text length.

    The sample bounds what reaches the driver (4 KB a row, at most twice ``train_rows`` rows).  Where that
    draws no text with a word, the ``train_rows`` texts with a word of smallest hash are taken.
    """
    seen = sorted((r["votes"], r["count"]) for r in label_counts(docs, text).collect())     # at most 3^9 rows
    codes, counts = np.array([s[0] for s in seen], np.int64), np.array([s[1] for s in seen], np.float64)
    post, share, table = estimate(codes, counts)
    accuracy = {name: (float(table[0, k, GOOD]), float(table[1, k, BAD])) for k, name in enumerate(LABELLERS)}
    of = dict(zip(codes.tolist(), post.tolist()))
    @F.pandas_udf("struct<votes int, x binary>")
    def example(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table_, fold = _class_table(), _fold()
        for texts in batches:
            rows = [(votes(t, table_), features(t, table_, fold)) for t in texts]
            yield pd.DataFrame([(v, None if x is None else x.tobytes()) for v, x in rows], columns=["votes", "x"])
            del texts, rows
        give_back()

    draw = F.xxhash64(F.col(key), F.length(text))

    def examples(drawn: DataFrame) -> list:
        return drawn.select(example(F.col(text)).alias("e")).select("e.*").where("x is not null").limit(2 * train_rows).collect()

    rows = examples(docs.where(draw <= F.lit(last_hash(train_rows, int(counts.sum())))))
    if not rows:
        least = docs.where(F.col(text).rlike(r"[^ \t\n\r\x0B\f]")).select(draw.alias("h")).orderBy("h").limit(train_rows)
        most = least.agg(F.max("h")).first()[0]
        rows = [] if most is None else examples(docs.where(draw <= F.lit(most)))
        if most is not None and not rows:
            raise ValueError("no training text was drawn, though there are texts with words")
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, DIMS)
    weights = train(x, np.array([of[r["votes"]] for r in rows]))
    return Model(codes.tolist(), post.tolist(), weights, share, accuracy)


def scorer(model: Model):
    """Column function: text -> struct(posterior, quality_score); a text without a word has score 0."""
    weights, post, share = model.weights, dict(zip(model.codes, model.posterior)), model.share

    @F.pandas_udf("struct<posterior double, quality_score double>")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, fold = _class_table(), _fold()
        for texts in batches:
            out = []
            for t in texts:
                x = features(t, table, fold)
                s = 0.0 if x is None else float(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500))))
                out.append((post.get(votes(t, table), share), s))
            yield pd.DataFrame(out, columns=["posterior", "quality_score"])
            del texts
        give_back()

    return grade


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``posterior``, ``quality_score`` (0 to 1) and ``keep`` of every whole text.

    A null, empty or blank text has score 0 and is not kept.  Row by row, no shuffle.
    """
    q = scorer(model)(F.col(text))
    return docs.withColumns({"posterior": q["posterior"], "quality_score": q["quality_score"], "keep": q["quality_score"] >= threshold})


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5, train_rows: int = 4000) -> DataFrame:
    """Fit on ``docs`` and score every row: key, posterior, quality_score, keep.

    Null keys and repeated rows are scored like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    src = docs.select(F.col(key), F.col(text))
    return score(src, fit(src, text, key, train_rows), text, threshold).select(key, "posterior", "quality_score", "keep")


def accepted(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5, train_rows: int = 4000) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = fit(docs.select(key, text), text, key, train_rows)
    return docs.where(scorer(model)(F.col(text))["quality_score"] >= threshold)
