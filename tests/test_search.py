"""Packed-bit search and neighbour descent against the exact search."""

import numpy as np
import pytest

from modaweave.operators import bitsearch, descent
from modaweave.operators.neighbours import knn
from pyspark.sql import functions as F


def as_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, bits array<int>")


def by_rank(df):
    return {(r.query, r["rank"]): (r.neighbour, round(r.distance, 9)) for r in df.collect()}


def test_packing_bits(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((40, 130)) < 0.4).astype(int)
    got = as_table(spark, x).select("id", bitsearch.packed("bits", 130).alias("w")).withColumn("n", bitsearch.set_bits("w")).collect()
    for r in got:
        bits = [(w >> j) & 1 for w in r.w for j in range(64)]
        assert len(r.w) == 3 and bits[:130] == x[r.id].tolist() and not any(bits[130:]) and r.n == x[r.id].sum()


@pytest.mark.parametrize(("width", "share", "block", "k"), [(64, 0.5, 256, 3), (200, 0.1, 16, 5), (70, 0.02, 8, 2)])
def test_packed_search_is_exact(spark, width, share, block, k):
    rng = np.random.default_rng(width)
    x = (rng.random((260, width)) < share).astype(int)
    x[5] = x[6]
    x[20:60] = x[20]  # more copies than neighbours asked for
    x[100:104] = 0
    df = as_table(spark, x)
    assert by_rank(bitsearch.tanimoto_knn(df, k, block=block)) == by_rank(knn(df, k, vec="bits", metric="tanimoto"))


def test_packed_pairs_stay_in_the_task(spark, monkeypatch):
    """Pairs that cannot count never become rows of a join, and small chunks and tiles change nothing."""
    monkeypatch.setattr(bitsearch, "TILE_COLUMNS", 16)
    x = (np.random.default_rng(3).random((300, 130)) < 0.3).astype(int)
    x[40:80] = x[40]
    df = as_table(spark, x)
    rows, second = [], bitsearch._second_pass

    def counted(*args):
        out = second(*args).cache()
        rows.append(out.count())
        return out

    monkeypatch.setattr(bitsearch, "_second_pass", counted)
    assert by_rank(bitsearch.tanimoto_knn(df, 2, block=8, chunk=20)) == by_rank(knn(df, 2, vec="bits", metric="tanimoto"))
    assert rows[0] < 261 * 261 / 4


def test_packed_search_of_few_rows(spark):
    df = as_table(spark, np.eye(3, dtype=int))
    assert bitsearch.tanimoto_knn(df.limit(0), 2).count() == 0
    assert bitsearch.tanimoto_knn(df.filter("id = 1"), 2).count() == 0
    assert bitsearch.tanimoto_knn(df, 5).count() == 6


def test_descent_finds_nearly_all(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 700)] + 0.4 * rng.normal(size=(700, 16))
    x[:60] = x[0]  # a popular row's copies are in many lists
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    found = descent.descent_knn(df, 8, metric="euclidean").cache()
    row = descent.recall(found, knn(df, 8, metric="euclidean"), 1e-7).first()
    assert row.recall >= 0.95 and row.entries == 700 * 8
    vectors = {i: v for i, v in enumerate(x)}
    for r in found.sample(0.05, seed=1).collect():
        assert r.query != r.neighbour and abs(np.linalg.norm(vectors[r.query] - vectors[r.neighbour]) - r.distance) < 1e-6
    assert found.groupBy("query").agg(F.count("*").alias("n"), F.countDistinct("neighbour").alias("d")).filter("n <> 8 or d <> 8").count() == 0


def test_descent_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, features array<double>")
    assert descent.descent_knn(df.limit(1), 3).count() == 0
    assert by_rank(descent.descent_knn(df, 9, metric="euclidean")) == by_rank(knn(df, 9, metric="euclidean"))
