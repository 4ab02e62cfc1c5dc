"""Neighbour descent cut into parts: what a part's gatherings send back, many parts, repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modaweave.operators import descent
from modaweave.operators.neighbours import knn

RNG = np.random.default_rng(4)


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids if ids is not None else range(len(x)), np.asarray(x, dtype=float), strict=True)], "id bigint, features array<double>")


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_only_pairs_below_the_kth_are_sent(held, monkeypatch):
    monkeypatch.setattr(descent, "HELD", held)
    x = RNG.normal(size=(60, 8))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    hub = np.repeat([0, 1, 2], [20, 25, 30])
    at = np.concatenate([np.sort(RNG.choice(60, size=m, replace=False)) for m in (20, 25, 30)])
    fresh = RNG.integers(0, 2, size=75).astype("i1")
    kth = np.where(np.arange(60) % 3 == 0, np.inf, np.quantile(d, 0.3, axis=1))
    q, o, got = descent._met(hub, at, fresh, x, kth, 4, "euclidean")
    want = {}
    for h in range(3):
        own, new = at[hub == h], fresh[hub == h]
        for a, f in zip(own, new, strict=True):
            for b, g in zip(own, new, strict=True):
                if a != b and (f or g) and d[a, b] <= kth[a]:
                    want.setdefault(int(a), {})[int(b)] = d[a, b]
    best = [(a, b, w) for a, near in want.items() for b, w in sorted(near.items(), key=lambda e: (e[1], e[0]))[:4]]
    assert sorted((int(a), int(b)) for a, b in zip(q, o, strict=True)) == sorted((a, b) for a, b, _ in best)
    assert np.allclose(np.sort(got), np.sort([w for *_, w in best]), atol=1e-8)


def test_many_parts_find_as_much(spark):
    x = RNG.normal(size=(600, 12)) + 4 * RNG.normal(size=(20, 12))[RNG.integers(0, 20, 600)]
    df = table(spark, x, RNG.permutation(10_000)[:600] - 5000)
    found = descent.descent_knn(df, 6, metric="euclidean", part_bytes=1 << 21).cache()  # 15 parts of 40 rows
    row = descent.recall(found, knn(df, 6, metric="euclidean"), 1e-7).first()
    assert row.recall >= 0.97 and row.entries == 600 * 6
    ranks = found.groupBy("query").agg(F.sort_array(F.collect_list("rank")).alias("r")).select("r").distinct().collect()
    assert [r["r"] for r in ranks] == [[1, 2, 3, 4, 5, 6]]


def test_rows_that_come_twice_are_not_their_own_neighbours(spark):
    x = RNG.normal(size=(50, 6))
    df = table(spark, np.r_[x, x, x[:5] + 0.5], [*range(50), *range(50), *range(5)])
    found = descent.descent_knn(df, 4, metric="euclidean").collect()
    assert all(r["query"] != r["neighbour"] for r in found)
    assert len({(r["query"], r["neighbour"]) for r in found}) == len(found) == 200
