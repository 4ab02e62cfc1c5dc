import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like inner ones."""
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "1 2 3 --- !!", None, "a"), (5, long, "en", None),
        (6, "same words in a row here", "en", "b"), (6, "same words in a row here", "en", "b"), (7, "Same WORDS in a row here", "fr", "b"),
        (None, "a row without an id", "en", "b"), (8, "one", "en", "c"), (9, "zwei\u00a0w\u00f6rter\n\nzwei", "de", "c"),
    ]
    full = [(*r, len(r[1] or ""), 0, "x", 1.5, 7) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _r int, score string, size double, key int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
