"""Corpus pipeline over ``documents``: five stages, each calling one operator of ``behaviorkit.llm``.

quality classifier -> language ID -> SimHash near-dedup -> mixing to target weights -> packing.
A stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; ``run`` writes
each stage's rows as Parquet in the shared folder and rereads them.  Null or empty texts end at the
first stage (no word to grade); null keys, ties, repeated rows, empty tables and further columns are
handled by the operators as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from behaviorkit.llm import langid, mixing, packing, quality, simhash
from behaviorkit.llm.common import written, written_place
from behaviorkit.llm.tokens import vocabulary_path
from behaviorkit.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality scorer accepts (score 0.5 or more)."""
    return quality.accepted(docs, threshold=0.5, train_rows=4000)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language, and not plainly in another than they state."""
    return langid.accepted(docs, margin=0.15)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (3-word shingles, at most 3 differing bits)."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture at tempered source weights."""
    return mixing.mixture(docs, block=20_000, period=1000, alpha=0.7)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence of at most 1024 tokens; sequences follow the order of the mixture."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=2, place=written_place())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned stages, SimHash's hash or the tokenizer; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
