"""Helpers for the tests of this subpackage."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def awkward(spark):
    """Null and blank texts, null ids, repeated rows, a very long text, and columns that clash with inner names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e\nf g h i j\na b c d e\nf g h i j", "en", "s"), (1, "a b c d e\nf g h i j\na b c d e\nf g h i j", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, " \t\n\x0b\x0c\r ", "en", "s"), (None, "no id here", "en", "s"), (None, None, None, None), (5, long, "en", "t"), (6, "naïve café 😀 text", "fr", "t")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
    from pyspark.sql import functions as F

    clash = ["h", "fp", "st", "n", "chunk", "removed_lines", "kept", "shard", "ids", "root", "a", "b", "key", "v", "pos", "start", "end"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (1, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
