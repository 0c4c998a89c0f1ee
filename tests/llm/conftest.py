from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture
def make(spark):
    def build(texts, start=0, partitions=3):
        return spark.createDataFrame(rows(texts, start), SCHEMA).repartition(partitions)

    return build


@pytest.fixture
def odd(spark):
    """Null ids, texts and names, empty and very long texts, repeated rows, and clashing extra columns."""
    long = "The the of and " * 20_000
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Hello there, you.", "en", None, 3), (3, long, "en", "a", len(long)), (4, "Hello there, you.", None, "a", 1), (4, "Hello there, you.", None, "a", 1), (5, "!!! ???", "fr", "b", 7), (6, "\U0001f600 12", "fr", "b", 4)]
    df = spark.createDataFrame(data, SCHEMA)
    from pyspark.sql import functions as F

    for c in ("score", "key", "shard", "unit", "label", "_tokens", "cell", "rep"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
