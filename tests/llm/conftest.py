from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 60_000

#: null, empty, blank, very long, repeated and equal rows; a null id; words of several scripts
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "web"), (2, None, "en", "web"), (3, "", None, None), (4, " \t\n", "en", "books"), (5, LONG, "la", "web"), (6, "The quick brown fox jumps over the lazy dog", "en", None),
    (7, "naïve café — ünïcode 😀 тест 漢字", None, "code"), (8, "12345 !!! ???", "en", "code"), (8, "12345 !!! ???", "en", "code"), (None, "an orphan row of words", "en", "web"), (9, "The quick brown fox jumps over the lazy dog", "en", "web"), (10, "x", "en", "wiki"),
]
#: names that the operators use themselves
CLASH = ["size", "score", "fp", "component_id", "key", "group", "shard", "tag", "host", "position", "taken", "target", "spans", "template", "h", "rank"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("theirs") for c in CLASH})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
