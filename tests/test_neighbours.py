import numpy as np
import pytest
from pyspark.sql import functions as F

from modaweave.operators import density, neighbours
from modaweave.operators.neighbours import pairwise

RNG = np.random.default_rng(0)


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id bigint, features array<double>")


def brute(x, ids, k, metric, p=2.0):
    m = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    d = 1 - m @ m.T if metric == "cosine" else pairwise(m, m, metric, p)
    out = {}
    for i, q in enumerate(ids):
        order = [j for j in np.lexsort((ids, np.round(d[i], 12))) if j != i][:k]
        out[q] = [int(ids[j]) for j in order]
    return out


def as_lists(df):
    got = {}
    for r in df.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    return got


@pytest.mark.parametrize("budget", [neighbours.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("metric,p", [("cosine", 2.0), ("euclidean", 2.0), ("minkowski", 3.0)])
def test_exact_both_ways(spark, monkeypatch, budget, metric, p):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    x = np.vstack([RNG.normal(c, 0.3, size=(40, 5)) for c in (0.5, 2.0, -1.5)])
    ids = RNG.permutation(len(x))
    got = as_lists(neighbours.knn(table(spark, x, ids), 4, metric=metric, p=p, broadcast_bytes=budget))
    assert got == brute(x, ids, 4, metric, p)


@pytest.mark.parametrize("budget", [neighbours.BROADCAST_BYTES, 0])
def test_group_of_copies_and_ties(spark, monkeypatch, budget):
    """A third of the rows are one vector, and bit vectors tie everywhere."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    bits = RNG.integers(0, 2, size=(60, 8)).astype(float)
    bits[:, 0] = 1
    x = np.vstack([bits, np.repeat(bits[:1], 30, axis=0)])
    ids = RNG.permutation(len(x))
    got = as_lists(neighbours.knn(table(spark, x, ids), 5, metric="tanimoto", broadcast_bytes=budget))
    assert got == brute(x, ids, 5, "tanimoto")


def test_separate_queries_keep_equal_ids(spark):
    x = RNG.normal(size=(20, 3))
    df = table(spark, x)
    got = neighbours.knn(df, 1, metric="euclidean", queries=df).collect()
    assert all(r["query"] == r["neighbour"] and r["distance"] < 1e-6 for r in got)


def test_fewer_rows_than_k(spark):
    got = as_lists(neighbours.knn(table(spark, RNG.normal(size=(3, 2))), 10))
    assert {k: len(v) for k, v in got.items()} == {0: 2, 1: 2, 2: 2}
    rep = neighbours.report(neighbours.with_labels(neighbours.knn(table(spark, RNG.normal(size=(3, 2))), 10), spark.range(3).withColumn("label", F.lit(1))), 4).collect()
    assert all(r["key_3"] is None and r["key_2"] is not None for r in rep)


def bit_table(spark, x):
    return spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id bigint, bits array<tinyint>")


def test_maxmin_pool_equals_plain_greedy(spark):
    x = RNG.integers(0, 2, size=(70, 12))
    df = bit_table(spark, x)
    ref = None
    for pool in (3, 7, 4096):
        rows = density.maxmin(df, 25, pool=pool).orderBy("pick").collect()
        picks = [r["id"] for r in rows]
        assert [r["pick"] for r in rows] == list(range(1, 26))
        ref = ref or density._maxmin_local(np.arange(70), x.astype(float), picks[0], 25)
        assert picks == ref


def test_maxmin_large_groups_use_the_distributed_form(spark):
    x = RNG.integers(0, 2, size=(40, 10))
    df = bit_table(spark, x).withColumn("cluster", F.col("id") % 2).withColumn("quota", F.lit(6))
    a = density.maxmin_per_group(df, limit=100)
    b = density.maxmin_per_group(df, limit=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_components(spark):
    n, parent = 200, list(range(200))
    pairs = [(int(a), int(b)) for a, b in RNG.integers(0, n, size=(130, 2)) if a != b]
    pairs += [(150, i) for i in range(151, 190)]  # one node with a large share of the edges

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = density.connected_components(spark.range(n), spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in range(n)}


def test_dense_groups_closer_than_eps_are_one(spark):
    """Groups too small to reach each other through their nearest neighbours alone."""
    x = np.array([[0.5 * g, 0.001 * k] for g in range(40) for k in range(4)])
    rows = density.dense_regions(table(spark, x), min_cluster=2, min_samples=3, eps=1.0).collect()
    assert {r["cluster"] for r in rows} == {0}


def test_range_links_join_what_steps_join(spark):
    x = RNG.uniform(0, 10, size=(400, 2))
    for size in (1 << 10, 16 << 20):  # many small blocks, and one
        got = density.connected_components(table(spark, x).select("id"), density.range_links(table(spark, x), 0.45, block_bytes=size))
        up = list(range(len(x)))
        near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.45**2
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up] if a != b else up
        assert {r["id"]: r["component"] for r in got.collect()} == dict(enumerate(up))


def test_dense_regions_find_blobs(spark):
    x = np.vstack([RNG.normal(c, 0.05, size=(60, 2)) for c in (0, 5)] + [RNG.uniform(20, 90, size=(10, 2))])
    rows = density.dense_regions(table(spark, x), min_cluster=20, min_samples=5, eps=0.5).collect()
    label = {r["id"]: r["cluster"] for r in rows}
    assert len({label[i] for i in range(60)}) == 1 and len({label[i] for i in range(60, 120)}) == 1
    assert label[0] != label[60] and all(label[i] == -1 for i in range(120, 130))
    assert all(0 <= r["probability"] <= 1 for r in rows)


@pytest.mark.parametrize("limit", [10_000, 2])
def test_density_sample_is_exact(spark, limit):
    n = 300
    x = RNG.integers(0, 2, size=(n, 16))
    fp = bit_table(spark, x)
    lab = fp.select("id", F.when(F.col("id") < 60, -1).otherwise((F.col("id") % 4).cast("int")).alias("cluster"), (F.col("id") / n).alias("probability"))
    got = [r["id"] for r in density.density_sample(lab, fp, 60, maxmin_limit=limit).collect()]
    assert len(got) == len(set(got)) == 60
    assert 1 <= sum(i < 60 for i in got) <= 60


@pytest.mark.parametrize("p", [1.0, 1.5, 3.0, 2.5])
def test_minkowski_forms_few_distances(p, monkeypatch):
    """The k nearest by the plain formula, with most distances ruled out by a product."""
    rng = np.random.default_rng(5)
    b = rng.normal(size=(6000, 16))
    b[40:60] = b[40]
    a = np.r_[rng.normal(size=(50, 16)), b[38:44]]
    formed, pairs = [], neighbours._minkowski_pairs

    def counted(x, i, *rest):
        formed.append(len(i))
        return pairs(x, i, *rest)

    monkeypatch.setattr(neighbours, "_minkowski_pairs", counted)
    cols, vals = neighbours.nearest_columns(a, b, 5, "minkowski", p)
    want = np.round(np.stack([(np.abs(b - row) ** p).sum(1) ** (1 / p) for row in a]), 12)
    order = np.argsort(want, axis=1, kind="stable")[:, :5]
    assert (cols == order).all() and np.allclose(vals, np.take_along_axis(want, order, 1), atol=1e-11)
    assert sum(formed) < len(a) * len(b) * 3 / 4 and (formed or p < 1.5)
