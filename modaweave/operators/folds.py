"""All folds of a cross-validation from one pass.

Count, sum and products of the features are additive: one pass gives them for every (fold, class), and a
training set's are the total minus its own fold's.  Additive models (Gaussian Bayes, quadratic
discriminant, least squares, ridge, principal components) so need no scan per fold, and one more pass
scores every row with the model that has not seen its fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fuse import LinearFusion, pca_from
from .linalg import Moments, _rows, vector_mean, width_of


@dataclass
class FoldSums:
    """``parts``: (fold, class) to (weight, sum, products) of the features followed by the label, about
    the common centre ``shift``."""

    shift: np.ndarray
    parts: dict[tuple[int, float], tuple[float, np.ndarray, np.ndarray]]

    @property
    def folds(self) -> list[int]:
        return sorted({f for f, _ in self.parts})

    @property
    def classes(self) -> list[float]:
        return sorted({c for _, c in self.parts})

    def train(self, fold: int, cls: float | None = None) -> Moments:
        """Centred moments of the rows outside ``fold``, of one class or of all."""
        own = [p for (f, c), p in self.parts.items() if f != fold and cls in (None, c)]
        n = sum(p[0] for p in own)
        total = sum((p[1] for p in own), np.zeros(len(self.shift)))
        outer = sum((p[2] for p in own), np.zeros((len(self.shift), len(self.shift))))
        outer = outer - np.outer(total, total) / max(n, 1e-300)
        return Moments(n, total + n * self.shift, outer, True)


def fold_sums(df: DataFrame, vec: str = "features", label: str = "label", fold: str = "fold", classes: bool = True) -> FoldSums:
    """One pass; a task keeps a (width + 1) squared array for each fold and class and emits it by rows."""
    d = width_of(df, vec) + 1
    joint = F.concat(F.col(vec).cast("array<double>"), F.array(F.col(label).cast("double")))
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    kind = F.col(label).cast("double") if classes else F.lit(0.0)
    rows = df.select(F.col(fold).cast("int").alias("fold"), kind.alias("cls"), joint.alias("v"), weight.alias("w"))
    shift = vector_mean(rows, "v")
    shared = df.sparkSession.sparkContext.broadcast(shift)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, float], np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(["fold", "cls"], sort=False):
                w = g["w"].to_numpy()
                x = np.column_stack([np.ones(len(g)), _rows(g["v"]) - shared.value])
                held.setdefault(key, np.zeros((d + 1, d + 1)))
                held[key] += (x * w[:, None]).T @ x
        for (f, c), s in held.items():
            yield pd.DataFrame({"fold": f, "cls": c, "i": np.arange(d + 1), "s": list(s)})

    sums = rows.mapInPandas(partial, "fold int, cls double, i int, s array<double>").groupBy("fold", "cls", "i").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    full: dict[tuple[int, float], np.ndarray] = {}
    for r in sums.select("fold", "cls", "i", vector_to_array("s").alias("s")).collect():
        full.setdefault((r["fold"], r["cls"]), np.zeros((d + 1, d + 1)))[r["i"]] = r["s"]
    return FoldSums(shift, {k: (float(s[0, 0]), s[0, 1:].copy(), s[1:, 1:].copy()) for k, s in full.items()})


# -- models from moments -----------------------------------------------------------------------------
Scorer = Callable[[np.ndarray], np.ndarray]


def _posterior(parts: Sequence[tuple[np.ndarray, np.ndarray, float]]) -> Scorer:
    """Share of the last class among Gaussians (mean, precision, constant)."""

    def score(x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, precision, constant in parts:
            c = x - mean
            logs.append(constant - 0.5 * ((c * c) @ precision if precision.ndim == 1 else np.einsum("ij,jk,ik->i", c, precision, c)))
        logs = np.stack(logs, 1)
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e[:, -1] / e.sum(1)

    return score


def gaussian_bayes(sums: FoldSums, fold: int) -> Scorer:
    """Diagonal Gaussians; variances are raised by 1e-9 of the largest one of all rows."""
    whole = sums.train(fold)
    raised = 1e-9 * (np.diag(whole.outer)[:-1] / max(whole.n, 1)).max()
    parts = []
    for c in sums.classes:
        m = sums.train(fold, c)
        var = np.diag(m.outer)[:-1] / m.n + raised
        parts.append((m.mean[:-1], 1.0 / var, float(np.log(m.n / whole.n) - 0.5 * np.log(var).sum())))
    return _posterior(parts)


def quadratic(sums: FoldSums, fold: int, reg: float = 1e-3) -> Scorer:
    whole, parts = sums.train(fold), []
    for c in sums.classes:
        m = sums.train(fold, c)
        cov = (1 - reg) * m.outer[:-1, :-1] / max(m.n - 1, 1)
        cov = cov + reg * np.eye(len(cov))
        parts.append((m.mean[:-1], np.linalg.inv(cov), float(np.log(m.n / whole.n) - 0.5 * np.linalg.slogdet(cov)[1])))
    return _posterior(parts)


def ridge(sums: FoldSums, fold: int, alpha: float = 0.0) -> Scorer:
    """Least squares with alpha |w|^2 on the summed error, the intercept free."""
    m = sums.train(fold)
    gram = m.outer[:-1, :-1] + alpha * np.eye(len(m.outer) - 1)
    w = np.linalg.lstsq(gram, m.outer[:-1, -1], rcond=None)[0]
    return lambda x: (x - m.mean[:-1]) @ w + m.mean[-1]


def components(sums: FoldSums, fold: int, k: int) -> LinearFusion:
    """Principal components of the rows outside ``fold``."""
    m = sums.train(fold)
    return pca_from(Moments(m.n, m.total[:-1], m.outer[:-1, :-1], True), k)


FITS: dict[str, Callable[..., Scorer]] = {"Naive Bayes": gaussian_bayes, "QDA": quadratic, "Linear Regression": ridge, "Ridge": lambda s, f, alpha=1.0: ridge(s, f, alpha)}


def out_of_fold(df: DataFrame, models: Sequence[str], task: str = "classification", vec: str = "features", id_col: str = "id") -> DataFrame:
    """(id, fold, label, model, p): every row scored by each model fitted on the other folds.

    ``df`` has a column ``fold``.  Two passes over the table, however many folds and models.
    """
    sums = fold_sums(df, vec, classes=task == "classification")
    names = list(models)
    # The sums travel, and a worker makes the models from them: small arrays, no pass.
    shared = df.sparkSession.sparkContext.broadcast(sums)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[tuple[int, str], Scorer] = {}
        for v, fold in batches:
            out = np.zeros((len(v), len(names)))
            x = _rows(v) if len(v) else np.zeros((0, 0))
            at = fold.to_numpy()
            for f in np.unique(at):
                rows = at == f
                for k, m in enumerate(names):
                    if (f, m) not in held:
                        held[f, m] = FITS[m](shared.value, int(f))
                    out[rows, k] = held[f, m](x[rows])
            yield pd.Series(list(out))

    scored = df.select(F.col(id_col).alias("id"), F.col("fold").cast("int").alias("fold"), F.col("label").cast("double").alias("label"), score(F.col(vec).cast("array<double>"), F.col("fold").cast("int")).alias("_p"))
    named = F.array(*[F.struct(F.lit(m).alias("model"), F.col("_p")[k].alias("p")) for k, m in enumerate(names)])
    return scored.select("id", "fold", "label", F.explode(named).alias("_m")).select("id", "fold", "label", "_m.model", "_m.p")
