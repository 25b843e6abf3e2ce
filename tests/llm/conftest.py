import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, _row string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that clash with the operators' own."""
    long = " ".join(f"w{i % 4999}x" for i in range(60_000))
    plain = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
    rows = [
        (1, None, None, None),
        (2, "", "en", "s0"),
        (3, " \n\t ", "en", "s0"),
        (4, long, "en", "s1"),
        (5, plain, "en", "s1"),
        (5, plain, "en", "s1"),
        (6, plain + " ", "de", None),
        (7, plain.replace(" ", "\n"), None, "s1"),
        (None, plain, "en", "s2"),
        (None, "only here", "en", "s2"),
        (8, "same line\nsame line\n\nsame line\nother", "en", "s2"),
        (9, "x", "en", "é"),
        (10, "  two words ", "en", "Z"),
        (11, " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(1, 61)), "en", "s1"),
    ]
    return [(d, t, g, s, len(t or ""), "no", "big", "r") for d, t, g, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
