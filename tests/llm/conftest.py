import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1), (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1), (3, None, None, "b", None), (4, "", "en", None, 0), (5, "   \n\t ", "en", "b", 6),
    (6, "über größe straße 日本語 👩‍👩‍👧 é̀ ½ ²   x", "de", "b", 9), (7, "word " * 30_000, "en", "c", 150_000), (8, "x" * 60_000, "en", "c", 60_000), (9, "a  b   c \n\n  d <|endoftext|> e ", "en", "c", 30), (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (None, "no id here", "en", "c", 9), (10, "12345 67890", None, "c", 11), (11, "un deux trois quatre cinq six sept", "fr", "c", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like those that operators make."""
    from pyspark.sql import functions as F

    extra = ["shard", "slot", "bands", "sid", "ids", "sequence_id", "part", "pii_count", "class_id", "__salt", "spans", "fingerprint"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in extra])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
