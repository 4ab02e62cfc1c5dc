"""Quality by Bradley-Terry pairwise ranking.

Preference pairs (a good document, a bad one) are drawn from a bounded labelled sample.  Logistic
loss on the difference of their features gives weights w; a document's strength is w.x.  The accept
threshold is a quantile of the strengths of all labelled documents outside the held-out fold: the
share of bad ones among them.  The score maps strength to (0, 1) so that the threshold lies at 0.7.

Texts are read whole.  Null and empty texts have all-zero features and get the score these have.
Where only one class is labelled there is nothing to rank and every score is the share of good
labels, or 1 without any label.  Ties get equal scores; repeated rows are scored one by one; empty
tables give empty results; all columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles_long
from .common import held_out, stored
from .textstats import RATIOS, known_labels, labelled_stats, stat, stats_column

ACCEPT = 0.7


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(offset + slope.x) over RATIOS."""

    slope: tuple[float, ...]
    offset: float


def bradley_terry(diff: np.ndarray, penalty: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.d)) + penalty/2 |w|^2 over pair differences d."""
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -50, 50)))
        gradient = penalty * w - diff.T @ p / len(diff)
        hessian = penalty * np.eye(len(w)) + (diff * (p * (1 - p))[:, None]).T @ diff / len(diff)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, pairs: int = 40_000, seed: int = 5) -> Ranking:
    """Weights from about ``most`` labelled documents of each class and ``pairs`` preference pairs,
    threshold and spread of the scores from all labelled documents outside the held-out fold."""
    sample = labelled_stats(docs, labels, label, most, seed)
    x, y = sample[list(RATIOS)].to_numpy(), sample["y"].to_numpy()
    bad, good = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    if not len(bad) or not len(good):
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Ranking((0.0,) * len(RATIOS), float(np.log(share / (1 - share))))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(seed)
    w = bradley_terry(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)])
    w = w / np.where(spread > 1e-9, spread, 1.0)
    strength, n_bad, n = labelled_strengths(docs, labels, label, w)
    # The quantile at the share of bad labels, half way between its two neighbours.
    cut = quantile(strength, F.col("strength"), (n_bad - 0.5) / (n - 1))
    steep = 3.0 / max(quantile(strength, F.abs(F.col("strength") - F.lit(cut)), 0.5), 1e-9)
    return Ranking(tuple(steep * w), float(np.log(ACCEPT / (1 - ACCEPT)) - steep * cut))


def linear(weights: Sequence[float], offset: float, stats: str) -> Column:
    return reduce(lambda a, b: a + b, [stat(name, stats) * F.lit(float(w)) for name, w in zip(RATIOS, weights, strict=True)], F.lit(offset))


def labelled_strengths(docs: DataFrame, labels: DataFrame, label: str, weights: Sequence[float]) -> tuple[DataFrame, int, int]:
    """Strengths of all labelled documents outside the held-out fold (stored), how many of them are
    bad, and how many there are.  Only numbers are shuffled: texts become strengths before the join."""
    own = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", stats_column(F.col("text")).alias("_s"))
    own = own.select("doc_id", linear(weights, 0.0, "_s").alias("strength"))
    rows = stored(own.join(known_labels(labels, label).distinct(), "doc_id").select("_y", "strength"), "quality-strengths")
    bad, n = rows.agg(F.count(F.when(F.col("_y") == 0, 1)), F.count("*")).first()
    return rows, bad, n


def quantile(rows: DataFrame, value: Column, share: float) -> float:
    return float(exact_quantiles_long(rows.select(F.lit("strength").alias("feature"), value.alias("value")), [share]).first()["q"])


def score_column(model: Ranking, stats: str = "_stats") -> Column:
    z = linear(model.slope, model.offset, stats)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scored(docs: DataFrame, model: Ranking, name: str = "score") -> DataFrame:
    """All documents with their score; the linear part stays in the plan as column arithmetic."""
    return docs.withColumn("_bt_stats", stats_column(F.col("text"))).withColumn(name, score_column(model, "_bt_stats")).drop("_bt_stats")


def op5(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    model = fit(docs, labels, **settings)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    model = fit(docs, labels, **settings)
    return scored(docs, model, "_bt_score").filter(F.col("_bt_score") >= ACCEPT).select(*docs.columns)
