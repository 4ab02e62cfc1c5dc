"""Models of all folds from one pass, against a fit on each training fold."""

import numpy as np
import pytest

from modaweave.operators import folds, fuse, learners, split


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(240) < 0.4).astype(float)
    x = rng.normal(size=(240, 6)) * [1, 2, 3, 1, 1, 5] + y[:, None] * [1, 0, -1, 0.5, 0, 2] + 1000
    df = spark.createDataFrame([(i, v.tolist(), float(t), float(1 + i % 2)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label double, w double")
    return split.kfold(df, 4).cache()


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize(("name", "task"), [("Naive Bayes", "classification"), ("QDA", "classification"), ("Linear Regression", "regression"), ("Ridge", "regression")])
def test_folds_equal_the_loop(table, name, task, weighted):
    if weighted and name != "Naive Bayes":
        pytest.skip("weights enter the other learners in their own ways")
    df = table.withColumnRenamed("w", "weight") if weighted else table.drop("w")
    if task == "regression":
        df = df.selectExpr("id", "features", "fold", "features[0] * 2 - features[3] + label AS label")
    got = {r.id: r.p for r in folds.out_of_fold(df, [name], task).collect()}
    assert len(got) == 240
    for f in range(2):
        model = learners.make(name, task).fit(df.filter(f"fold <> {f}"))
        want = {r.id: r.p for r in model.transform(df.filter(f"fold = {f}")).select("id", "p").collect()}
        # The library's least squares do not centre, which shows in the ninth digit here.
        assert max(abs(got[i] - want[i]) for i in want) < (1e-9 if task == "classification" else 1e-6)
        if task == "regression":
            rows = df.toPandas()
            x, y, out = np.stack(rows["features"]), rows["label"].to_numpy(), (rows["fold"] == f).to_numpy()
            m, alpha = x[~out].mean(0), 1.0 if name == "Ridge" else 0.0
            a = x[~out] - m
            w = np.linalg.solve(a.T @ a + alpha * np.eye(6), a.T @ (y[~out] - y[~out].mean()))
            exact = (x[out] - m) @ w + y[~out].mean()
            assert np.abs(exact - [got[i] for i in rows["id"][out]]).max() < 1e-9


def test_components_of_a_fold(table):
    sums = folds.fold_sums(table.drop("w"), classes=False)
    for f in (0, 3):
        a, b = folds.components(sums, f, 3), fuse.pca(table.filter(f"fold <> {f}"), 3)
        assert np.allclose(a.explained, b.explained, rtol=1e-9) and np.abs(a.weights - b.weights).max() < 1e-7


def test_one_scan_whatever_the_folds(spark, table, tmp_path):
    """The rows are read three times in all: for the centre, the sums and the scores."""
    path = f"{tmp_path}/rows"
    table.drop("w").write.parquet(path)
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            counter.add(len(b))
            yield b

    df = spark.read.parquet(path)
    seen = df.select("id", "features", "label", "fold").mapInPandas(counted, "id long, features array<double>, label double, fold int")
    folds.out_of_fold(seen, ["Naive Bayes", "QDA"]).write.format("noop").mode("overwrite").save()
    assert counter.value <= 4 * 240
