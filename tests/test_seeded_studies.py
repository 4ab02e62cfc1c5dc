"""Studies over seeds and folds: one ranking for all training sets, the scores of a loop over them."""

import numpy as np
import pytest

from modaweave.operators import learners, sample, split
from modaweave.plans import studies
from modaweave.session import cut_lineage

SEEDS, FOLDS, FRACTIONS = (42, 7), 2, (0.25, 0.5)


@pytest.fixture(scope="module")
def table(spark):
    """Ids that come twice, with rows of their own class each, and uneven classes."""
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(150), np.arange(30)])
    y = (np.arange(180) >= 130).astype(int)
    x = rng.normal(size=(180, 3)) + y[:, None] * 0.8
    rows = [(int(i), v.tolist(), int(t)) for i, v, t in zip(ids, x, y, strict=True)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").cache()


def _loop(df):
    """(seed, fold, held-out rows, training rows), set by set."""
    data = cut_lineage(split.stratified_kfold(df, FOLDS, "label", seeds=SEEDS))
    for s in SEEDS:
        for f in range(FOLDS):
            own = data.filter(f"seed = {s}")
            yield s, f, own.filter(f"fold = {f}").drop("seed", "fold"), own.filter(f"fold <> {f}").drop("seed", "fold")


def _close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in b.items()}


def test_low_data_curves_equal_the_loop(table):
    want = []
    for s, f, test, train in _loop(table):
        nested = cut_lineage(split.learning_fractions(train, "label", fractions=FRACTIONS, seed=s))
        for frac in FRACTIONS:
            rows = sample.undersample(nested.filter(f"fraction = {frac}").drop("fraction"), "label", seed=s)
            got = studies._scores(learners.make("Naive Bayes").fit(rows).transform(test), "classification")
            want.append({"model": "Naive Bayes", "seed": s, "fold": f + 1, "fraction": frac, "roc_auc": got["roc_auc"], "balanced_accuracy": got["balanced_accuracy"]})
    out = studies.low_data_curves(table, ["Naive Bayes"], SEEDS, FOLDS, FRACTIONS)
    assert out.columns[-1] == "seconds" and out.filter("seconds > 0").count() == len(want)
    _close([r.asDict() for r in out.drop("seconds").collect()], want)


def test_descriptor_benchmark_equals_the_loop(spark, table):
    want = []
    for s, f, test, train in _loop(table):
        train, test = studies.standardised(cut_lineage(sample.undersample(train, "label", seed=s)), test)
        got = studies._scores(learners.make("Naive Bayes").fit(train).transform(test), "classification")
        want.append({"descriptor": "d", "model": "Naive Bayes", "seed": s, "fold": f + 1, "train_size": train.count(), "test_size": test.count(), **got})
    done = spark.createDataFrame([("d", 42, 2)], "descriptor string, seed long, fold long")
    out = studies.descriptor_benchmark({"d": table}, ["Naive Bayes"], SEEDS, FOLDS, done)
    _close([r.asDict() for r in out.drop("seconds").collect()], [w for w in want if (w["seed"], w["fold"]) != (42, 2)])


def test_sets_are_ranked_together_and_without_vectors(table, monkeypatch):
    seen = []
    for module, name in ((split, "stratified_kfold"), (split, "learning_fractions"), (sample, "undersample")):

        def counted(df, *args, _run=getattr(module, name), _name=name, **kw):
            seen.append((_name, "features" in df.columns))
            return _run(df, *args, **kw)

        monkeypatch.setattr(module, name, counted)
    studies.low_data_curves(table, ["Naive Bayes"], SEEDS, FOLDS, FRACTIONS)
    assert seen == [("stratified_kfold", False), ("learning_fractions", False), ("undersample", False)]
