"""Learners behind one registry: ``make(name, task)`` gives an object with fit(df) -> model, and the
model's ``transform`` adds ``p`` (probability or prediction).

Training tables have ``features`` (array<double>), ``label`` and optionally ``weight``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .fuse import random_features
from .linalg import _rows, centred_moments, width_of
from .neighbours import knn
from .trees import RandomCutForest, SecondOrderBoosting


def _vec(df: DataFrame) -> DataFrame:
    return df.withColumn("_f", array_to_vector(F.col("features").cast("array<double>")))


class Model:
    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class SparkModel(Model):
    inner: Any
    kind: str  # probability | raw | prediction

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.transform(_vec(df))
        if self.kind == "probability":
            p = vector_to_array("probability")[1]
        elif self.kind == "raw":
            # A margin squashed to (0, 1): same order, and 0.5 is the decision border.
            p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
        else:
            p = F.col("prediction")
        extra = [c for c in ("_f", "rawPrediction", "probability", "prediction") if c in out.columns]
        return out.withColumn("p", p).drop(*extra)


@dataclass
class SparkLearner:
    build: Callable[[], Any]
    kind: str
    standardise: bool = False

    def fit(self, df: DataFrame) -> Model:
        est = self.build().setFeaturesCol("_f").setLabelCol("label")
        if "weight" in df.columns and est.hasParam("weightCol"):
            est = est.setWeightCol("weight")
        return SparkModel(est.fit(_vec(df)), self.kind)


@dataclass
class SummedLossLearner:
    """A linear classifier under the usual objective, C times the summed loss plus the penalty.

    Spark averages the loss, so its penalty is 1 / (C n), n the rows (or their weights).  Features are
    taken as they are.
    """

    build: Callable[[float], Any]
    kind: str
    C_: float = 1.0

    def fit(self, df: DataFrame) -> Model:
        n = df.agg(F.sum(F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)).alias("n")).first()["n"]
        if not n:
            raise ValueError("no rows to fit on")
        return SparkLearner(lambda: self.build(1.0 / (self.C_ * n)), self.kind).fit(df)


def _logistic(C_: float, penalty: str) -> SummedLossLearner:
    share = 1.0 if penalty == "l1" else 0.0
    return SummedLossLearner(lambda reg: C.LogisticRegression(regParam=reg, elasticNetParam=share, standardization=False, tol=1e-9, maxIter=500), "probability", C_)


def _margin(C_: float) -> SummedLossLearner:
    return SummedLossLearner(lambda reg: C.LinearSVC(regParam=reg, standardization=False), "raw", C_)


@dataclass
class NeighbourModel(Model):
    train: DataFrame
    k: int
    p: float
    weights: str

    def transform(self, df: DataFrame) -> DataFrame:
        # The training label rides in through a join on neighbour id.
        near = knn(self.train.select("id", "features"), self.k, metric="minkowski" if self.p != 2 else "euclidean", queries=df.select("id", "features"), p=self.p)
        lab = self.train.select(F.col("id").alias("neighbour"), F.col("label").cast("double").alias("_y"))
        w = F.lit(1.0) if self.weights == "uniform" else 1.0 / (F.col("distance") + 1e-8)
        scored = near.join(lab, "neighbour").groupBy(F.col("query").alias("id")).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("p"))
        return df.join(scored, "id")


@dataclass
class NeighbourLearner:
    k: int = 11
    p: float = 3.0
    weights: str = "distance"

    def fit(self, df: DataFrame) -> Model:
        return NeighbourModel(df, self.k, self.p, self.weights)


@dataclass
class QuadraticModel(Model):
    classes: list[float]
    means: list[np.ndarray]
    precisions: list[np.ndarray]
    constants: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.means, self.precisions, self.constants))

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            x = _rows(v)
            logs = []
            for m, prec, const in zip(*shared.value, strict=True):
                c = x - m
                logs.append(const - 0.5 * np.einsum("ij,jk,ik->i", c, prec, c))
            logs = np.stack(logs, 1)
            e = np.exp(logs - logs.max(1, keepdims=True))
            return pd.Series(e[:, -1] / e.sum(1))

        return df.withColumn("p", score(F.col("features").cast("array<double>")))


@dataclass
class QuadraticLearner:
    """Class means and covariances from one moment pass per class (two classes)."""

    reg: float = 1e-3

    def fit(self, df: DataFrame) -> Model:
        classes = [r["label"] for r in df.select("label").distinct().orderBy("label").limit(3).collect()]
        if len(classes) > 2:
            raise ValueError("p is the second class's share, so two classes at most")
        weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
        share = {r["label"]: r["w"] for r in df.groupBy("label").agg(F.sum(weight).alias("w")).collect()}
        total, parts = sum(share.values()), []
        for c in classes:
            m = centred_moments(df.filter(F.col("label") == c), "features")
            parts.append(m)
        means, precs, consts = [], [], []
        for c, m in zip(classes, parts, strict=True):
            cov = m.outer / max(m.n - 1, 1)
            cov = (1 - self.reg) * cov + self.reg * np.eye(len(cov))
            sign, logdet = np.linalg.slogdet(cov)
            means.append(m.mean)
            precs.append(np.linalg.inv(cov))
            consts.append(float(np.log(share[c] / total) - 0.5 * logdet))  # weights shift the prior
        return QuadraticModel(classes, means, precs, consts)


@dataclass
class BoostedModel(Model):
    stages: list[tuple[Any, float]]
    regression: bool

    def transform(self, df: DataFrame) -> DataFrame:
        out = _vec(df)
        for i, (m, _) in enumerate(self.stages):
            m = m.copy()
            m.setPredictionCol(f"_s{i}")
            if not self.regression:
                m.setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
            out = m.transform(out).drop(f"_r{i}", f"_q{i}")
        total = sum(a for _, a in self.stages) or 1.0
        if self.regression:
            # Weighted median of the stage predictions.
            pairs = F.array_sort(F.array(*[F.struct(F.col(f"_s{i}").alias("y"), F.lit(float(a)).alias("a")) for i, (_, a) in enumerate(self.stages)]))
            start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("y"))
            step = lambda s, x: F.struct(
                (s["run"] + x["a"]).alias("run"),
                F.coalesce(s["y"], F.when(s["run"] + x["a"] >= total / 2, x["y"])).alias("y"),
            )
            p = F.aggregate(pairs, start, step)["y"]
        else:
            p = sum((F.col(f"_s{i}") * float(a) for i, (_, a) in enumerate(self.stages)), F.lit(0.0)) / total
        return out.withColumn("p", p).drop("_f", *[f"_s{i}" for i in range(len(self.stages))])


@dataclass
class BoostLearner:
    """AdaBoost: SAMME over stumps, or R2 with linear loss over shallow trees."""

    rounds: int = 10
    regression: bool = False
    depth: int | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> Model:
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        base = _vec(df).select("_f", F.col("label").cast("double").alias("label"), weight.alias("_w"))
        whole = base.agg(F.sum("_w").alias("w")).first()["w"]
        cur = cut_lineage(base.withColumn("_w", F.col("_w") / F.lit(float(whole or 1.0))))
        stages = []
        for _ in range(self.rounds):
            if self.regression:
                est = R.DecisionTreeRegressor(featuresCol="_f", labelCol="label", weightCol="_w", maxDepth=self.depth or 3, seed=self.seed)
                model = est.fit(cur)
                scored = model.transform(cur).withColumn("_e", F.abs(F.col("label") - F.col("prediction")))
                top = scored.agg(F.max("_e").alias("m")).first()["m"]
                if not top:
                    stages.append((model, 1.0))
                    break
                loss = F.col("_e") / F.lit(float(top))
                err = scored.agg((F.sum(F.col("_w") * loss) / F.sum("_w")).alias("e")).first()["e"]
                if err >= 0.5:
                    if not stages:
                        stages.append((model, 1.0))
                    break
                beta = err / (1 - err)
                stages.append((model, float(np.log(1 / max(beta, 1e-300)))))
                weight = F.col("_w") * F.pow(F.lit(float(beta)), 1.0 - loss)
            else:
                est = C.DecisionTreeClassifier(featuresCol="_f", labelCol="label", weightCol="_w", maxDepth=self.depth or 1, seed=self.seed)
                model = est.fit(cur)
                scored = model.transform(cur)
                wrong = F.col("prediction") != F.col("label")
                err = scored.agg((F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("e")).first()["e"]
                if err <= 1e-12:
                    stages.append((model, 1.0))
                    break
                if err >= 0.5:
                    if not stages:
                        stages.append((model, 1.0))
                    break
                alpha = float(np.log((1 - err) / err))
                stages.append((model, alpha))
                weight = F.col("_w") * F.when(wrong, F.lit(float(np.exp(alpha)))).otherwise(1.0)
            moved = scored.withColumn("_w", weight).select("_f", "label", "_w")
            total = moved.agg(F.sum("_w").alias("t")).first()["t"]
            cur = cut_lineage(moved.withColumn("_w", F.col("_w") / F.lit(float(total))))
        return BoostedModel(stages, self.regression)


@dataclass
class MeanModel(Model):
    models: list[Model]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("p", f"_p{i}")
        names = [f"_p{i}" for i in range(len(self.models))]
        return out.withColumn("p", sum((F.col(c) for c in names), F.lit(0.0)) / len(names)).drop(*names)


@dataclass
class BalancedEnsemble:
    """Boosted learners on differently under-sampled copies, averaged."""

    size: int = 10
    rounds: int = 5

    def fit(self, df: DataFrame) -> Model:
        from .sample import undersample

        return MeanModel([BoostLearner(self.rounds).fit(undersample(df, "label", "id", seed)) for seed in range(self.size)])


@dataclass
class MappedModel(Model):
    features: Any
    inner: Model

    def transform(self, df: DataFrame) -> DataFrame:
        done = self.inner.transform(self.features.transform(df.withColumn("_keep", F.col("features"))))
        return done.withColumn("features", F.col("_keep")).drop("_keep")


@dataclass
class KernelLearner:
    """Random kernel features in front of a linear learner."""

    inner: Any
    width: int = 64
    gamma: float = 1.0

    def fit(self, df: DataFrame) -> Model:
        d = width_of(df, "features")
        fmap = random_features(d, self.width, self.gamma / d)
        return MappedModel(fmap, self.inner.fit(fmap.transform(df)))


def _repeated(df: DataFrame) -> DataFrame:
    """Rows as often as their weight says, for a learner without weights; a fraction of a copy is
    settled by a hash of the row."""
    if "weight" not in df.columns:
        return df
    w = F.col("weight").cast("double")
    part = F.pmod(F.xxhash64("features", "label"), F.lit(1_000_000)) / F.lit(1e6) < w - F.floor(w)
    copies = (F.floor(w) + F.when(part, 1).otherwise(0)).cast("int")
    return df.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).drop("_copy", "weight")


@dataclass
class NetLearner:
    hidden: Sequence[int] = (16,)
    rounds: int = 100

    def fit(self, df: DataFrame) -> Model:
        layers = [width_of(df, "features"), *self.hidden, 2]
        est = C.MultilayerPerceptronClassifier(featuresCol="_f", labelCol="label", layers=layers, maxIter=self.rounds, seed=42)
        return SparkModel(est.fit(_vec(_repeated(df))), "probability")


@dataclass
class PenalisedLearner:
    """Least squares with the usual penalties: alpha * (l1 |w| + (1 - l1)/2 |w|^2) per row, or, with
    ``per_table``, alpha |w|^2 on the summed error (ridge).

    Spark fits on a label divided by its deviation, which leaves an L1 penalty alone and divides an
    L2 penalty by that deviation, so the two parts are converted separately.
    """

    alpha: float = 1.0
    l1: float = 0.0
    per_table: bool = False

    def fit(self, df: DataFrame) -> Model:
        w = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        y = F.col("label").cast("double")
        mean = df.agg((F.sum(w * y) / F.sum(w)).alias("m")).first()["m"]
        row = df.agg(F.sum(w).alias("n"), F.sqrt(F.sum(w * (y - F.lit(mean)) * (y - F.lit(mean))) / F.sum(w)).alias("sd")).first()
        alpha = self.alpha / max(row["n"] or 0, 1) if self.per_table else self.alpha
        one, two = alpha * self.l1, alpha * (1.0 - self.l1) * (row["sd"] or 1.0)
        total = one + two
        est = R.LinearRegression(
            featuresCol="_f", labelCol="label", regParam=total, elasticNetParam=one / total if total else 0.0, standardization=False
        )
        est = est.setWeightCol("weight") if "weight" in df.columns else est
        return SparkModel(est.fit(_vec(df)), "prediction")


CLASSIFIERS: dict[str, Callable[..., Any]] = {
    "Logistic Regression": lambda C_=1.0, penalty="l2": _logistic(C_, penalty),
    "Decision Tree": lambda max_depth=5, min_rows=1: SparkLearner(lambda: C.DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_rows, seed=42), "probability"),
    "Random Forest": lambda trees=20, max_depth=5: SparkLearner(lambda: C.RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=42), "probability"),
    "Support Vector Machine": lambda C_=1.0, kernel="linear": _margin(C_) if kernel == "linear" else KernelLearner(_margin(C_)),
    "Naive Bayes": lambda: SparkLearner(lambda: C.NaiveBayes(modelType="gaussian"), "probability"),
    "KNN": lambda k=11, p=3.0, weights="distance": NeighbourLearner(k, p, weights),
    "MLP": lambda hidden=(16,), rounds=100: NetLearner(hidden, rounds),
    "QDA": lambda reg=1e-3: QuadraticLearner(reg),
    "AdaBoost": lambda rounds=10: BoostLearner(rounds),
    "Extra Trees": lambda trees=20, max_depth=5, min_rows=1, max_features="sqrt": RandomCutForest(trees, max_depth, min_rows, max_features),
    "XGBoost": lambda rounds=20, max_depth=3, eta=0.3, subsample=1.0, colsample=1.0: SecondOrderBoosting(rounds, max_depth, eta, subsample=subsample, colsample=colsample),
    "LightGBM": lambda rounds=20, max_depth=4, eta=0.1: SecondOrderBoosting(rounds, max_depth, eta, penalty=0.0, least=1e-3, bins=255),
    "CatBoost": lambda rounds=20, max_depth=4, eta=0.1: SecondOrderBoosting(rounds, max_depth, eta, penalty=3.0, bins=128),
    "Gradient Boosting": lambda rounds=20, max_depth=3: SparkLearner(lambda: C.GBTClassifier(maxIter=rounds, maxDepth=max_depth, seed=42), "probability"),
    "Balanced Ensemble": lambda size=10, rounds=5: BalancedEnsemble(size, rounds),
}

REGRESSORS: dict[str, Callable[..., Any]] = {
    "Linear Regression": lambda: SparkLearner(lambda: R.LinearRegression(standardization=False), "prediction"),
    "Ridge": lambda alpha=1.0: PenalisedLearner(alpha, per_table=True),
    "Lasso": lambda alpha=1.0: PenalisedLearner(alpha, 1.0),
    "ElasticNet": lambda alpha=1.0, l1=0.5: PenalisedLearner(alpha, l1),
    "Decision Tree": lambda max_depth=5, min_rows=1: SparkLearner(lambda: R.DecisionTreeRegressor(maxDepth=max_depth, minInstancesPerNode=min_rows, seed=42), "prediction"),
    "Random Forest": lambda trees=20, max_depth=5: SparkLearner(lambda: R.RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=42), "prediction"),
    "Gradient Boosting": lambda rounds=20, max_depth=3: SparkLearner(lambda: R.GBTRegressor(maxIter=rounds, maxDepth=max_depth, seed=42), "prediction"),
    "AdaBoost": lambda rounds=10: BoostLearner(rounds, regression=True),
    "Extra Trees": lambda trees=20, max_depth=5, min_rows=1, max_features=None: RandomCutForest(trees, max_depth, min_rows, max_features, regression=True),
    "XGBoost": lambda rounds=20, max_depth=3, eta=0.3, subsample=1.0, colsample=1.0: SecondOrderBoosting(rounds, max_depth, eta, subsample=subsample, colsample=colsample, regression=True),
    "LightGBM": lambda rounds=20, max_depth=4, eta=0.1: SecondOrderBoosting(rounds, max_depth, eta, penalty=0.0, least=1.0, bins=255, regression=True),
    "CatBoost": lambda rounds=20, max_depth=4, eta=0.1: SecondOrderBoosting(rounds, max_depth, eta, penalty=3.0, bins=128, regression=True),
    "K Neighbors": lambda k=5, p=2.0, weights="uniform": NeighbourLearner(k, p, weights),
    "Support Vector Machine": lambda: KernelLearner(SparkLearner(lambda: R.LinearRegression(loss="huber", regParam=0.01), "prediction")),
    "Kernel Ridge": lambda alpha=1.0: KernelLearner(PenalisedLearner(alpha, per_table=True)),
}

GRIDS: dict[str, dict[str, list]] = {
    "Logistic Regression": {"C_": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"]},
    "Decision Tree": {"max_depth": [3, 5, 10], "min_rows": [1, 5]},
    "Random Forest": {"trees": [20, 50], "max_depth": [5, 10]},
    "KNN": {"k": [3, 7, 11], "weights": ["uniform", "distance"]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.01, 0.1, 1.0]},
    "Gradient Boosting": {"rounds": [20, 50], "max_depth": [3, 5]},
    "Support Vector Machine": {"C_": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"]},
    "MLP": {"hidden": [(10,), (20,), (50,)]},
    "QDA": {"reg": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]},
    "AdaBoost": {"rounds": [10, 50]},
    "Extra Trees": {"trees": [20, 50], "max_depth": [5, 10], "max_features": ["sqrt", "log2", None]},
    "ElasticNet": {"alpha": [0.1, 1.0, 10.0], "l1": [0.1, 0.5, 0.9]},
    "Kernel Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "K Neighbors": {"k": [3, 5, 10], "weights": ["uniform", "distance"]},
    "XGBoost": {"rounds": [20, 50], "max_depth": [3, 5], "eta": [0.1, 0.3], "subsample": [0.7, 1.0], "colsample": [0.7, 1.0]},
}


def names(task: str) -> list[str]:
    return list(_registry(task))


def _registry(task: str) -> dict[str, Callable[..., Any]]:
    if task == "classification":
        return CLASSIFIERS
    if task == "regression":
        return REGRESSORS
    raise ValueError("task must be 'classification' or 'regression'")


def for_route(route: str) -> list[str]:
    """Learners that a balancing route asks for in place of the usual ones."""
    return ["Balanced Ensemble"] if route == "balanced ensemble" else []


def make(name: str, task: str = "classification", **params):
    reg = _registry(task)
    if name not in reg:
        raise ValueError(f"no {task} learner {name!r}; known: {sorted(reg)}")
    return reg[name](**params)
