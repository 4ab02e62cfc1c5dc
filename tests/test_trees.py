"""Histogram trees against plain sums and plain rules."""

import numpy as np
import pytest

from modaweave.operators import learners, trees


def data(n=400, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)) > 0).astype(float)
    x[rng.random((n, d)) < 0.05] = np.nan
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = data()
    return x, y, spark.createDataFrame([(i, [None if np.isnan(a) else float(a) for a in v], float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label double")


def plain_level(x, g, h, cuts, rows, features, penalty, least):
    """(gain, feature, cut, missing left) by trying every cut of every feature."""
    best = (0.0, -1, 0, False)
    for f in features:
        for k, c in enumerate(cuts[f]):
            for left_missing in (True, False):
                left = rows & np.where(np.isnan(x[:, f]), left_missing, x[:, f] <= c)
                right = rows & ~left
                if min(h[left].sum(), h[right].sum()) < least or not left.any() or not right.any():
                    continue
                gain = round(0.5 * (g[left].sum() ** 2 / (h[left].sum() + penalty) + g[right].sum() ** 2 / (h[right].sum() + penalty) - g[rows].sum() ** 2 / (h[rows].sum() + penalty)), 9)
                if gain > best[0]:
                    best = (gain, f, k, left_missing)
    return best


def test_cuts_are_ranks(table):
    x, _, df = table
    cuts = trees.quantile_cuts(df, 8)
    for f, c in enumerate(cuts):
        v = np.sort(x[~np.isnan(x[:, f]), f])
        assert c.tolist() == sorted({v[int(np.ceil(k / 8 * len(v))) - 1] for k in range(1, 8)})


@pytest.mark.parametrize("weighted", [False, True])
def test_two_rounds_of_boosting(table, weighted):
    x, y, df = table
    w = np.where(np.arange(len(y)) % 3 == 0, 2.0, 1.0) if weighted else np.ones(len(y))
    if weighted:
        df = df.selectExpr("*", "CASE WHEN id % 3 = 0 THEN 2.0 ELSE 1.0 END AS weight")
    model = trees.SecondOrderBoosting(rounds=2, max_depth=2, bins=10, penalty=0.7).fit(df)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for t in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        at = {0: np.ones(len(y), dtype=bool)}
        for node in (0, 1, 2):
            if node not in at:
                continue
            gain, f, k, left_missing = plain_level(x, g, h, model.cuts, at[node], range(x.shape[1]), 0.7, 1.0)
            assert t.feature[node] == f
            if f >= 0:
                assert t.bin[node] == k
                left = np.where(np.isnan(x[:, f]), t.missing_left[node], x[:, f] <= model.cuts[f][k])
                at[2 * node + 1], at[2 * node + 2] = at[node] & left, at[node] & ~left
        for node, rows in at.items():
            assert np.isclose(t.value[node], -g[rows].sum() / (h[rows].sum() + 0.7))
            if t.feature[node] < 0:
                margin = np.where(rows, margin + 0.3 * t.value[node], margin)
    got = {r.id: r.p for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)))


def test_stored_margins_change_nothing(table):
    _, _, df = table
    a, b = (trees.SecondOrderBoosting(rounds=3, max_depth=2, bins=8, store=s, subsample=0.7, colsample=0.6).fit(df) for s in (1, 10))
    for s, t in zip(a.trees, b.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and np.allclose(s.value, t.value)
    # Sampling matters, and a narrow sum budget does not.
    whole = trees.SecondOrderBoosting(rounds=1, max_depth=2, bins=8).fit(df).trees[0]
    assert whole.value.tolist() != a.trees[0].value.tolist()


def test_several_passes_find_the_same(table, monkeypatch):
    _, _, df = table
    whole = trees.SecondOrderBoosting(rounds=1, max_depth=3, bins=8).fit(df).trees[0]
    monkeypatch.setattr(trees, "SUMS", 400)
    parts = trees.SecondOrderBoosting(rounds=1, max_depth=3, bins=8).fit(df).trees[0]
    assert whole.feature.tolist() == parts.feature.tolist() and whole.bin.tolist() == parts.bin.tolist()


def test_random_cuts(table):
    x, y, df = table
    forest = trees.RandomCutForest(trees=3, max_depth=1, bins=12)
    model = forest.fit(df)
    width = [len(c) for c in model.cuts]
    bins = trees.binned(x, model.cuts)
    for t, tree in enumerate(model.trees):
        best = (0.0, -1, 0)
        for f in forest.features(x.shape[1], t, 0):
            here = bins[:, f][bins[:, f] <= width[f]]
            lo, hi = here.min(), here.max() - 1
            c = model.cuts[f]
            k = next(j for j in range(lo, hi + 1) if c[j] >= c[lo] + trees.share_of(42, t, 0, f) * (c[hi] - c[lo]) or j == hi)
            for left_missing in (True, False):
                left = np.where(bins[:, f] > width[f], left_missing, bins[:, f] <= k)
                gain = round(0.5 * (y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)), 9)
                if gain > best[0]:
                    best = (gain, f, k)
        assert (tree.feature[0], tree.bin[0]) == best[1:]
        assert np.isclose(tree.value[0], y.mean())
    again = forest.fit(df)
    assert [t.feature.tolist() for t in again.trees] == [t.feature.tolist() for t in model.trees]
    other = trees.RandomCutForest(trees=3, max_depth=1, bins=12, seed=7).fit(df)
    assert [t.value.tolist() for t in other.trees] != [t.value.tolist() for t in model.trees]


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_learners_fit_better_than_a_constant(table, task):
    _, y, df = table
    dense = df.selectExpr("id", "transform(features, v -> coalesce(v, 0.0)) AS features", "label")
    for name in ("XGBoost", "LightGBM", "CatBoost", "Extra Trees"):
        out = learners.make(name, task, **({"trees": 6} if name == "Extra Trees" else {"rounds": 3, "eta": 0.6})).fit(dense).transform(dense).toPandas()
        err = ((out["p"] - out["label"]) ** 2).mean()
        assert err < 0.75 * y.var(), name
        if task == "classification":
            assert out["p"].between(0, 1).all()


def test_no_rows_and_one_value(spark, table):
    _, _, df = table
    with pytest.raises(ValueError, match="no rows"):
        trees.SecondOrderBoosting().fit(df.limit(0))
    with pytest.raises(ValueError, match="no rows"):
        trees.RandomCutForest().fit(df.limit(0))
    flat = spark.createDataFrame([([1.0, None], 1.0)] * 5 + [([1.0, None], 0.0)] * 5, "features array<double>, label double")
    assert [round(r.p, 9) for r in trees.SecondOrderBoosting(rounds=3).fit(flat).transform(flat).select("p").distinct().collect()] == [0.5]
    assert [r.p for r in trees.RandomCutForest(trees=2).fit(flat).transform(flat).select("p").distinct().collect()] == [0.5]
