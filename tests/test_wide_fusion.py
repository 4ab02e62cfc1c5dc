"""Fusions of wide vectors against the dense ones, and at a width no dense one could take."""

import numpy as np
import pytest

from modaweave.operators import fuse, linalg


def _frame(spark, x, y=None, split=None):
    rows = [(i, v[: split or len(v)].tolist(), v[split or len(v) :].tolist(), float(0 if y is None else y[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, other array<double>, label double").repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * np.linspace(4, 1, 12) @ rng.normal(size=(12, 60)) + 0.3 * rng.normal(size=(300, 60)) + 50
    return x, x[:, 0] - x[:, 5] + rng.normal(size=300)


def aligned(a, b):
    return np.abs(np.abs((a / np.linalg.norm(a, axis=0) * b / np.linalg.norm(b, axis=0)).sum(0)) - 1).max()


def test_leading_components(spark, data):
    x, _ = data
    df = _frame(spark, x)
    exact, lead = fuse.pca(df, 6), linalg.leading_components(df, 6)
    assert lead.residual <= 1e-9 and lead.passes <= 20
    assert np.allclose(lead.values, exact.explained, rtol=1e-9) and np.abs(lead.vectors - exact.weights).max() < 1e-6
    # A block as wide as the vectors, fewer rows than features, and constant columns.
    few = _frame(spark, np.column_stack([x[:7, :20], np.ones((7, 3))]))
    got = linalg.leading_components(few, 9)
    want = np.linalg.eigvalsh(np.cov(np.column_stack([x[:7, :20], np.ones((7, 3))]).T))[::-1][:9]
    assert np.allclose(got.values, np.maximum(want, 0), atol=1e-9 * want[0])


def test_pls_and_cca_beyond_the_dense_width(spark, data):
    x, y = data
    df = _frame(spark, x, y)
    a, b = fuse.pls(df, "label", 5), fuse.pls(df, "label", 5, dense=8)
    assert np.abs(a.weights - b.weights).max() < 1e-8
    two = _frame(spark, x, split=35)
    a, b = fuse.cca(two, "features", "other", 3, pre=10), fuse.cca(two, "features", "other", 3, pre=10, dense=8)
    assert np.allclose(a.correlations, b.correlations, atol=1e-7) and aligned(a.left.weights, b.left.weights) < 1e-6


def test_select_k_best(spark, data):
    x, y = data
    got = {r.pos: r.f_score for r in fuse.select_k_best(_frame(spark, x, y), "label", 10).collect()}
    r = np.array([np.corrcoef(x[:, j], y)[0, 1] for j in range(60)])
    f = r**2 / (1 - r**2) * 298
    assert set(got) == set(np.argsort(-f)[:10].tolist()) and all(np.isclose(got[j], f[j]) for j in got)


def test_twenty_thousand_features(spark):
    rng = np.random.default_rng(1)
    low, up = rng.normal(size=(64, 3)) * [9, 5, 3], rng.normal(size=(3, 20_000))
    x = low @ up + 0.01 * rng.normal(size=(64, 20_000))
    df = _frame(spark, x, low[:, 0])
    model = fuse.pca(df, 3)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.explained, s[:3] ** 2 / 63, rtol=1e-8) and aligned(model.weights, vt[:3].T) < 1e-6
    fused = np.array([r.features for r in model.transform(df).orderBy("id").select("features").collect()])
    assert np.allclose(np.abs(fused), np.abs(centred @ vt[:3].T), atol=1e-5 * np.abs(fused).max())
    scores = fuse.pls(df, "label", 2)
    assert scores.weights.shape == (20_000, 2)
    t = centred @ scores.weights[:, :1]
    assert abs(np.corrcoef(t[:, 0], low[:, 0])[0, 1]) > 0.8
