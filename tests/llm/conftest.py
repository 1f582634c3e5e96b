import pytest
from pyspark.sql import functions as F

#: Rows every operator on documents must survive: nulls in any column, empty, blank, repeated and very long texts.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog. " * 3, "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4), (None, "the quick brown fox jumps over the lazy dog. " * 3, "en", "b", 7),
    (5, "ein kleiner Hund läuft über die Straße. " * 4, "de", None, 1), (5, "ein kleiner Hund läuft über die Straße. " * 4, "de", None, 1),
    (6, "word " * 20_000, "en", "a", 2), (7, "日本語のテキスト", "ja", "c", 8), (8, "x", "en", "c", 1),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("_key", "_text", "key", "fp", "keep", "score", "margin", "lang_pred", "posterior", "length", "piece", "of", "k", "s",
             "hash", "n", "id", "row", "block", "slot", "component_id", "sketch", "size")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)
