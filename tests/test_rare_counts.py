"""Counts of words that mostly come once, against a plain counter."""

from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from modaweave.operators import tokens
from modaweave.plans import CATALOG


@pytest.mark.parametrize("slots", [1, 7, 1 << 15])
def test_counts_equal_a_counter(spark, monkeypatch, slots):
    monkeypatch.setattr(tokens, "planned_bytes", lambda df: slots << 20)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.zipf(1.2, 4000) % 100000] + ["", "é\n_1", "\t"] * 3 + ["hot"] * 3000
    df = spark.createDataFrame([(w,) for w in words], "context string").repartition(5)
    got = tokens.count_rare(df, "context", chunk_rows=300)
    assert got.dtypes == [("context", "string"), ("n", "bigint")]
    rows = got.collect()
    assert len(rows) == len({r["context"] for r in rows}) and {r["context"]: r["n"] for r in rows} == Counter(words)


def test_no_rows(spark):
    assert tokens.count_rare(spark.createDataFrame([], "w string"), "w").count() == 0


@pytest.mark.parametrize("bad", ["a b", None])
def test_words_it_cannot_send_are_refused(spark, bad):
    df = spark.createDataFrame([("a",), (bad,)], "w string")
    with pytest.raises(PythonException, match="null or hold a space"):
        tokens.count_rare(df, "w").collect()


def test_contexts_are_counted_without_a_table_of_all_keys(spark, tmp_path):
    """A hash table of nearly distinct contexts, on both sides of the shuffle, is what was spilled."""
    texts = ["a b a b c", "a a a", None, "", "x  y", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = CATALOG["context_tokens"].run(spark, str(tmp_path))
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = tokens.context_tokens(docs.select(F.col("doc_id").alias("id"), tokens.words("text").alias("tokens")), "tokens").groupBy("context").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
