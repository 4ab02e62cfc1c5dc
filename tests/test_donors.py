"""Donors for missing values: classes of many blocks, searched within bounds."""

import numpy as np
import pytest

from modaweave.operators import neighbours

RNG = np.random.default_rng(5)


def wanted(x, g, ids, k, exclude):
    """Mean of the k nearest donors for every missing cell, by comparing all rows."""
    out = {}
    for i in np.flatnonzero(np.isnan(x).any(1)):
        shared = ~np.isnan(x) & ~np.isnan(x[i])
        n = shared.sum(1)
        dist = np.sqrt(x.shape[1] / np.maximum(n, 1) * np.where(shared, (x - x[i]) ** 2, 0.0).sum(1))
        dist[(n == 0) | (g != g[i])] = np.inf
        if exclude:
            dist[ids == ids[i]] = np.inf
        for pos in np.flatnonzero(np.isnan(x[i])):
            d = np.round(np.where(np.isnan(x[:, pos]), np.inf, dist), 12)
            best = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
            out[int(ids[i]), int(pos)] = np.mean(x[best, pos]) if best else None
    return out


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("by", [None, "g"])
def test_many_blocks_match_brute_force(spark, monkeypatch, by, exclude):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 24)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 12)
    x = np.round(RNG.normal(size=(220, 4)) * [10, 1, 3, 1], 1)
    x[RNG.random(x.shape) < 0.15] = np.nan
    x[:30] = x[0]  # copies, more than a block holds
    x[5] = np.nan
    g = np.where(np.arange(220) % 11 == 0, "small", "large") if by else np.full(220, "")
    ids = RNG.permutation(220)
    rows = [(int(i), str(c), [None if np.isnan(v) else float(v) for v in r]) for i, c, r in zip(ids, g, x, strict=True)]
    df = spark.createDataFrame(rows, "id bigint, g string, v array<double>")
    left, right = (df.withColumnRenamed("id", n).select(n, *([by] if by else []), "v") for n in ("qid", "did"))
    got = {r["qid"]: r["fill"] for r in neighbours.nearest_donors(left, right, 4, 3, by=by, exclude_self=exclude).collect()}
    for (qid, pos), v in wanted(x, g, ids, 3, exclude).items():
        assert v is None and (qid not in got or got[qid][pos] is None) or np.isclose(got[qid][pos], v), (qid, pos)


def test_bounds_leave_out_far_blocks(spark, monkeypatch):
    """A row meets the donors of a few blocks near it, not those of its whole class."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    x = RNG.uniform(size=(1024, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "did bigint, v array<double>").selectExpr("did", "'' AS g", "v")
    _, boxes = neighbours._donor_blocks(df, 3, 1024)
    box = boxes[""]
    assert box.rows.sum() == 1024 and box.rows.max() <= 48 and len(box.names) >= 32
    low = box.gaps(x[:50], np.arange(3), 3)
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    assert (low.min(1) == 0).all()
    assert (low <= np.sort(d, axis=1)[:, [5]]).mean() < 0.4


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "tanimoto", "minkowski"])
def test_tiles_match_whole_matrix(monkeypatch, metric):
    """Ties, copies and rows that are no numbers over many tiles."""
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE_COLUMNS", 8)
    x = RNG.normal(size=(150, 6))
    if metric == "tanimoto":
        x = (x > 0).astype(float)
    x[100:120] = x[:20]
    x = neighbours._prepare(x, metric)
    d = np.round(neighbours._reported(neighbours.pairwise(x, x, metric, 3.0), x, x, metric), 9)
    cols, vals = neighbours.nearest_columns(x, x, 7, metric, 3.0)
    assert np.allclose(np.sort(d, axis=1)[:, :7], vals, atol=1e-6)
    if metric != "euclidean":  # its product rounds copies apart
        assert (np.argsort(d, axis=1, kind="stable")[:, :7] == cols).all()
    y = x.copy()
    y[3] = np.nan
    cols, _ = neighbours.nearest_columns(y[:3], y, 7, metric, 3.0)
    assert 3 not in cols
    assert neighbours.nearest_columns(x[:5], x[:2], 7, metric)[0].shape == (5, 2)
