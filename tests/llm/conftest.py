import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and
    extra columns named like the operators' own."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "plain words here", "de", None, 5),
            (4, LONG, "en", "b", len(LONG)), (5, "one", None, "b", 3), (6, "same text twice " * 30, "en", "c", 1),
            (6, "same text twice " * 30, "en", "c", 1), (7, "same text twice " * 30, "en", "c", 1), (8, "été ñandú 漢字   x", "fr", "d", 9)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "n_words", "fp", "key", "k1", "score", "anchor", "_text", "_id", "taken", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
