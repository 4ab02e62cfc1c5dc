import numpy as np
import pytest
from pyspark.sql import functions as F

from modaweave.operators import fuse, linalg
from modaweave.operators.linalg import Moments

RNG = np.random.default_rng(1)


def table(spark, x, y=None):
    rows = [(i, [float(v) for v in r], float(0 if y is None else y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label double")


def matrix(df, col="features"):
    return np.array([r[col] for r in df.orderBy("id").select(col).collect()])


def test_moments_match_numpy_and_merge(spark):
    x = RNG.normal(100, 1, size=(83, 5))
    m = linalg.moments(table(spark, x))
    assert m.n == 83 and np.allclose(m.total, x.sum(0)) and np.allclose(m.outer, x.T @ x)
    a, b = linalg.moments(table(spark, x[:30])), linalg.moments(table(spark, x[30:]))
    assert np.allclose((a + b).outer, m.outer) and isinstance(a + b, Moments)
    c = linalg.centred_moments(table(spark, x))
    assert np.allclose(c.outer / 82, np.cov(x.T)) and np.allclose(c.mean, x.mean(0))


def test_pca_is_orthonormal_and_explains_variance(spark):
    x = RNG.normal(size=(120, 6)) @ RNG.normal(size=(6, 6))
    model = fuse.pca(table(spark, x), 3)
    assert np.allclose(model.weights.T @ model.weights, np.eye(3))
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3]
    assert np.allclose(model.explained, want)
    z = matrix(model.transform(table(spark, x)))
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(np.cov(z.T), np.diag(want), atol=1e-8)
    parts = [table(spark, x[:50]), table(spark, x[50:])]
    assert np.allclose(fuse.incremental_pca(parts, 3).weights, model.weights, atol=1e-6)


def test_incremental_pca_far_from_zero(spark):
    x = RNG.normal(size=(400, 2)) * [1.0, 0.1] + 1e8
    got = fuse.incremental_pca([table(spark, x[k : k + 100]) for k in range(0, 400, 100)], 2)
    want = np.sort(np.linalg.eigvalsh(np.cov((x - x.mean(0)).T)))[::-1]
    assert np.allclose(got.explained, want, rtol=1e-4)


def test_tensor_fusion_needs_one_width(spark):
    x = RNG.normal(size=(40, 9))
    df = spark.createDataFrame([(i, r[:4].tolist(), r[4:].tolist(), float(r[1] - 2 * r[6])) for i, r in enumerate(x)], "id bigint, a array<double>, b array<double>, y double")
    with pytest.raises(ValueError):
        fuse.tensor_fusion(df, ["a", "b"], 2)
    best = fuse.top_features(df, ["a", "b"], "y", 1).orderBy("id").collect()
    assert all(np.allclose(r["a"], x[i, 1]) and np.allclose(r["b"], x[i, 6]) for i, r in enumerate(best))
    assert fuse.fuse(df, ["a", "b"], "tensordecompose", 1, "y", most=2)[1].count() == 40


def test_ica_recovers_sources(spark):
    s = np.column_stack([np.sign(np.sin(np.arange(600) / 7.0)), RNG.uniform(-1, 1, 600)])
    z = matrix(fuse.ica(table(spark, s @ np.array([[1.0, 0.4], [0.3, 1.0]])), 2).transform(table(spark, s @ np.array([[1.0, 0.4], [0.3, 1.0]]))))
    c = np.abs(np.corrcoef(z.T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.95


def test_cca_correlations(spark):
    base = RNG.normal(size=(300, 2))
    a = np.column_stack([base, RNG.normal(size=(300, 2))])
    b = np.column_stack([base[:, :1] * 2 + 0.1 * RNG.normal(size=(300, 1)), RNG.normal(size=(300, 2))])
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>")
    model = fuse.cca(df, "a", "b", 3)
    z = matrix(model.transform(df, "a", "b"))
    got = [np.corrcoef(z[:, i], z[:, 3 + i])[0, 1] for i in range(3)]
    assert np.allclose(got, model.correlations, atol=1e-6) and got[0] > 0.95
    assert np.allclose(np.var(z[:, :3], axis=0, ddof=1), 1.0)


def test_pls_matches_nipals(spark):
    x = RNG.normal(size=(90, 5)) @ RNG.normal(size=(5, 5)) + 3
    y = x[:, 0] - 2 * x[:, 3] + RNG.normal(size=90)
    z = matrix(fuse.pls(table(spark, x, y), "label", 2).transform(table(spark, x, y)))
    xs, ys = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    want = []
    for _ in range(2):
        w = xs.T @ ys
        w /= np.linalg.norm(w)
        t = xs @ w
        p = xs.T @ t / (t @ t)
        xs, ys = xs - np.outer(t, p), ys - t * (ys @ t) / (t @ t)
        want.append(t)
    assert np.allclose(z, np.array(want).T, atol=1e-8)


def test_random_features_approximate_the_kernel(spark):
    x = RNG.normal(size=(20, 3)) * 0.5
    z = matrix(fuse.random_features(3, 4000).transform(table(spark, x)))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d)).max() < 0.1


def test_tensor_fusion_reconstructs_low_rank(spark):
    a, b, c = RNG.normal(size=(3, 2)), RNG.normal(size=(80, 2)), RNG.normal(size=(6, 2))
    t = np.einsum("mr,sr,fr->smf", a, b, c)
    df = spark.createDataFrame([(i, *[t[i, m].tolist() for m in range(3)]) for i in range(80)], "id bigint, m0 array<double>, m1 array<double>, m2 array<double>")
    model = fuse.tensor_fusion(df, ["m0", "m1", "m2"], 2, rounds=500, tol=1e-14)
    s = matrix(model.transform(df, ["m0", "m1", "m2"]))
    back = np.einsum("mr,sr,fr->smf", model.modality, s, model.feature)
    assert np.abs(back - t).max() < 1e-2 * np.abs(t).max()


def test_select_k_best(spark):
    x = RNG.normal(size=(100, 4))
    y = x[:, 2] + 0.1 * RNG.normal(size=100)
    rows = fuse.select_k_best(table(spark, x, y), "label", 2).orderBy("rank").collect()
    r = np.corrcoef(x[:, 2], y)[0, 1]
    assert rows[0]["pos"] == 2 and rows[0]["f_score"] == pytest.approx(r * r / (1 - r * r) * 98)


def test_integration_is_ridge_then_pca(spark):
    x = RNG.normal(size=(100, 9)) @ RNG.normal(size=(9, 9))
    df = spark.createDataFrame([(i, r[:3].tolist(), r[3:6].tolist(), r[6:].tolist()) for i, r in enumerate(x)], "id bigint, a array<double>, b array<double>, c array<double>")
    model = fuse.integrate(df, ["a", "b", "c"], 2)
    enc = matrix(model.predict(df), "enc_a")
    xc = x - x.mean(0)
    w = np.linalg.solve(xc[:, 3:].T @ xc[:, 3:] + np.eye(6), xc[:, 3:].T @ xc[:, :3])
    assert np.allclose(enc, xc[:, 3:] @ w + x[:, :3].mean(0), atol=1e-7)
    z = matrix(model.transform(df))
    full = matrix(model.predict(df), "enc_all")
    assert np.allclose(np.sort(np.var(z, axis=0, ddof=1)), np.sort(np.linalg.eigvalsh(np.cov(full.T))[-2:]), rtol=1e-6)


def test_mapping_scores(spark):
    x = RNG.normal(size=(60, 3))
    df = spark.createDataFrame([(i, r.tolist(), (r @ np.ones((3, 2)) + 1).tolist()) for i, r in enumerate(x)], "id bigint, x array<double>, t array<double>")
    s = fuse.score_mapping(df, fuse.map_to_embedding(df, "x", "t", 1e-9), "x", "t").first()
    assert s["cosine"] > 0.999 and s["mse"] < 1e-9


def test_spectral_embedding_separates_two_parts(spark):
    links = [(a + o, b + o) for o in (0, 8) for a in range(8) for b in range(a + 1, 8)] + [(0, 8)]
    e = spark.createDataFrame(links, "src bigint, dst bigint")
    z = {r["id"]: r["features"][0] for r in fuse.spectral_embedding(e, 1, rounds=10).collect()}
    assert len({np.sign(z[i]) for i in range(8)}) == 1 and len({np.sign(z[i]) for i in range(8, 16)}) == 1
    assert np.sign(z[0]) != np.sign(z[8])


def test_dispatcher_rejects_unknown(spark):
    with pytest.raises(ValueError):
        fuse.fuse(table(spark, np.ones((3, 2))), ["features"], "tsne", 1)
    with pytest.raises(ValueError):
        fuse.fuse(table(spark, np.ones((3, 2))), ["features"], "plsda", 1)


def test_width_limit(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MAX_WIDTH", 3)
    with pytest.raises(ValueError):
        linalg.moments(table(spark, np.ones((2, 4))))


def test_reconstruction_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0], [1.0, 1.0], [2.0], [0.0], [1.0, 2.0], [1.0], [3.0])], "a array<double>, b array<double>, enc_a array<double>, enc_b array<double>, ra array<double>, rb array<double>, k array<double>, kk array<double>")
    r = fuse.reconstruction_losses(df, ["a", "b"], {"a": "ra", "b": "rb"}, ("k", "kk")).first()
    assert (r["encoding_loss_a"], r["encoding_loss_b"], r["reconstruction_loss_a"], r["reconstruction_loss_b"], r["reconstruction_loss_concat"]) == (0.5, 1.0, 9.0, 0.0, 4.0)
    assert r["total_loss"] == pytest.approx(0.33 * 1.5 / 2 + 0.33 * 9 / 2 + 0.33 * 4)
    assert df.select(F.size("a")).first()[0] == 2
