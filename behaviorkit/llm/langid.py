"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is the list of the ``top`` most frequent 1- to 3-grams over letters, most frequent first
(ties: smaller code).  Texts are lower-cased; every run of other characters is one boundary mark.
The distance of a document's profile to a language's is the sum, over the document's n-grams, of
how far each is out of place, or ``top`` where the language lacks it.

Learning counts the n-grams of all training texts: each task adds up slices of a few
million characters per language, Spark adds up (language, n-gram) counts, and only ``top`` n-grams per language are
gathered.  Prediction is row by row and needs no shuffle.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorkit.llm.common import cut, give_back, slices

#: Languages that the broadcast profiles may hold (``top`` numbers each); more is refused.
MAX_LANGUAGES = 2000


def letter_table() -> np.ndarray:
    """For each code point: itself where it is a letter, else 0 (the boundary mark)."""
    import sys
    import unicodedata

    return np.fromiter((c if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(sys.maxunicode + 1)),
                       np.int64, sys.maxunicode + 1)


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others one 0, with a 0 at both ends."""
    cp = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    cp = np.concatenate((np.zeros(1, np.int64), cp, np.zeros(1, np.int64)))
    return cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]


def gram_counts(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams; a code holds up to three code points of 21 bits.

    Code points are renumbered within the text first, so that counting is an array look-up; the
    boundary alone is no n-gram, and none has it in the middle.
    """
    used = np.flatnonzero(np.bincount(cp)) if len(cp) < 1 << 22 or cp.max() < 1 << 16 else np.unique(cp)
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(len(used))
    c, a = number[cp], len(used)
    codes, counts = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        x = c[:len(c) - n + 1].copy()
        for j in range(1, n):
            x = x * a + c[j:len(c) - n + 1 + j]
        if n == 3:
            x = x[c[1:-1] > 0]                       # number 0 is the boundary
        if a ** n <= max(1 << 16, 8 * len(x)):
            count = np.bincount(x, minlength=1)
            at = np.flatnonzero(count)
            count = count[at]
        else:
            at, count = np.unique(x, return_counts=True)
        parts = [used[(at // a ** (n - 1 - j)) % a] for j in range(n)]
        real = parts[0] > 0 if n == 1 else (sum(p > 0 for p in parts) > 0)
        code = np.zeros(len(at), np.int64)
        for p in parts:
            code = (code << 21) | p
        # shorter n-grams are told from longer ones that start with a boundary by their length
        code = code | (np.int64(0) if n == 3 else np.int64(-(1 << 63) if n == 2 else 0))
        codes.append(code[real])
        counts.append(count[real])
    return np.concatenate(codes), np.concatenate(counts)


def top_grams(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """Codes of the most frequent n-grams, most frequent first; ties go to the smaller code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 400) -> DataFrame:
    """``(lang, gram, rank)``: profiles of all languages of ``docs`` (rows without text or lang are skipped)."""

    def count(batches):
        table = letter_table()
        for b in batches:
            for name, texts in b.groupby("_lang")["_text"]:
                for some in slices(texts, 1 << 20):
                    cp = letters("\n".join(some), table)
                    if len(cp) > 2:
                        codes, counts = gram_counts(cp)
                        yield pd.DataFrame({"lang": name, "gram": codes, "n": counts.astype("int64")})
            b = texts = some = cp = None
        give_back()

    src = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).dropna()
    grams = src.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each slice first, so that no task holds all n-grams of a language
    order = [F.desc("n"), F.asc("gram")]
    some = (grams.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)))
            .where(F.col("r") <= top).drop("r"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
            .where(F.col("rank") < top).select("lang", "gram", "rank"))


def profile_table(rows, top: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-grams in order, rank of each n-gram in each language or -1; last row: unknown n-gram)."""
    langs = sorted({r["lang"] for r in rows})
    wanted = np.array([r["gram"] for r in rows], np.int64)
    grams = np.unique(wanted)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    column = {x: i for i, x in enumerate(langs)}
    ranks[np.searchsorted(grams, wanted), np.array([column[r["lang"]] for r in rows], np.int64)] = [r["rank"] for r in rows]
    return langs, grams, ranks


class Profiles:
    """Predicts with the profiles of all languages."""

    def __init__(self, parts: tuple[list[str], np.ndarray, np.ndarray], top: int):
        self.langs, self.grams, self.ranks = parts
        self.column = {x: i for i, x in enumerate(self.langs)}
        self.top = top

    def scores(self, text: str | None, table: np.ndarray) -> np.ndarray | None:
        """1 - distance / largest distance to each language; None without a letter or a language."""
        cp = letters(text, table) if text else np.zeros(0, np.int64)
        if len(cp) <= 2 or not self.langs:
            return None
        mine = top_grams(*gram_counts(cp), self.top)
        at = np.searchsorted(self.grams, mine)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == mine), at, len(self.grams))
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(mine))[:, None])).sum(axis=0)
        return 1 - out / (self.top * len(mine))

    def predict(self, text: str | None, table: np.ndarray) -> tuple[str, float, float]:
        """(language, score, margin): the best score, and its margin to the runner-up's score."""
        scores = self.scores(text, table)
        if scores is None:
            return "und", 0.0, 0.0
        best = int(scores.argmax())
        second = float(np.delete(scores, best).max()) if len(scores) > 1 else 0.0
        return self.langs[best], float(scores[best]), float(scores[best]) - second

    def lead(self, text: str | None, stated: str | None, table: np.ndarray) -> float | None:
        """Lead of the best score over the stated language's, or over the runner-up's if that has no profile.

        0 where nothing is stated; None without a letter or a language.
        """
        scores = self.scores(text, table)
        if scores is None:
            return None
        if stated is None:
            return 0.0
        if stated in self.column:
            return float(scores.max() - scores[self.column[stated]])
        return float(scores.max()) - (float(np.sort(scores)[-2]) if len(scores) > 1 else 0.0)


def known_profiles(spark: SparkSession, profiles: DataFrame, top: int = 400):
    """Broadcast of the ``profile_table``."""
    rows = profiles.limit(MAX_LANGUAGES * top + 1).collect()     # top rows per language
    if len(rows) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return spark.sparkContext.broadcast(profile_table(rows, top))


def predictor(spark: SparkSession, profiles: DataFrame, top: int = 400):
    """Column function: text -> struct(lang_pred, score, margin), with the profiles broadcast."""
    known = known_profiles(spark, profiles, top)

    @F.pandas_udf("struct<lang_pred string, score double, margin double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, model = letter_table(), Profiles(known.value, top)
        for texts in batches:
            yield pd.DataFrame([model.predict(t, table) for t in texts], columns=["lang_pred", "score", "margin"])
            del texts
        give_back()

    return predict


def leads(spark: SparkSession, profiles: DataFrame, top: int = 400):
    """Column function: (text, stated language) -> ``Profiles.lead``, with the profiles broadcast."""
    known = known_profiles(spark, profiles, top)

    @F.pandas_udf("double")
    def lead(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table, model = letter_table(), Profiles(known.value, top)
        for texts, stated in batches:
            yield pd.Series([model.lead(t, s, table) for t, s in zip(texts, stated)], dtype="float64")
            del texts, stated
        give_back()

    return lead


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", top: int = 400) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``margin`` of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
    Equal distances go to the language first in order.  Only the text is an input.  Null keys and
    repeated rows are rows like any other; an empty table gives an empty result.
    """
    found = predictor(docs.sparkSession, profiles, top)(F.col(text))
    return docs.withColumns({c: found[c] for c in ("lang_pred", "score", "margin")})


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 3, is 1: not used for learning (a null key is not held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = 400,
             margin: float = 0.15) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language and not plainly in another than stated.

    Profiles are learned from the rows that are not held out.  Rejected: texts without a letter, and
    texts whose best score leads the stated language's by ``margin`` or more, however close the best
    ones are to each other.  A stated language without a profile has no score; then the lead is the one
    over the runner-up.  A null ``lang`` states nothing.  Where nothing can be learned, as no row
    states a language, all rows stay.
    """
    profiles = cut(learn(docs.where(~held_out(F.col(key))), text, lang, top))
    if profiles.isEmpty():
        return docs
    lead = leads(docs.sparkSession, profiles, top)(F.col(text), F.col(lang))
    return docs.where(lead < margin)
