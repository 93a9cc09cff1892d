import pytest
from pyspark.sql import Row

LONG = "word " * 30_000
#: Nulls, empty and very long texts, ties, repeated rows, and an extra column whose name clashes with working names.
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the  quick brown fox\njumps over the lazy dog near the river bank today", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, LONG, "en", "a"),
    (6, "   \n\t ", "fr", "c"),
    (7, "le chat noir dort sur la table", "fr", None),
    (8, "one\ntwo\nthree", "de", "c"),
    (8, "one\ntwo\nthree", "de", "c"),
    (None, "no id here at all", None, "a"),
    (10, " İstanbul <|endoftext|> it's 1234! \U0001f600", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([Row(*r, len(r[1] or ""), 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
