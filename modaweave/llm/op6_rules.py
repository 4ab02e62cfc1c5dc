"""Quality rules as learned decision lists.

Sequential covering on a bounded labelled sample: grow a conjunction of threshold tests on text
statistics that covers bad documents, prune it on rows it was not grown on, keep it if it is still
precise, take away what it covers and go on.  Where the sample holds a smaller share of one class
than of the other, its rows weigh as many labels as they stand for, so that gain and precision are
those of all labels.  The list becomes one ordered Spark conditional.

Null texts have no words; empty texts fail the base rule.  Without labels of both classes the list
is empty and keeps everything.  Repeated rows are judged one by one, ties in the search go to the
first statistic and the lower cut, empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import COUNTS, RATIOS, known_labels, labelled_stats, stat, stats_column


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    cut: float

    def column(self, stats: str) -> Column:
        return stat(self.name, stats) > F.lit(self.cut) if self.above else stat(self.name, stats) <= F.lit(self.cut)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for t in rule:
        hit &= t.holds(x)
    return hit


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between neighbouring distinct values, thinned to evenly spaced quantiles."""
    u = np.unique(values)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else mid[np.linspace(0, len(mid) - 1, most).astype(int)]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, longest: int) -> Rule:
    """Add the test with the greatest information gain until only bad rows are left."""
    live, rule = np.ones(len(bad), dtype=bool), ()
    while len(rule) < longest and (~bad[live]).any():
        p0, n0 = weight[live & bad].sum(), weight[live & ~bad].sum()
        best, gain = None, 1e-9
        for name, v in x.items():
            here = v[live]
            order = np.argsort(here, kind="stable")
            ranked = here[order]
            pos, neg = (np.concatenate([[0.0], np.cumsum((weight * side)[live][order])]) for side in (bad, ~bad))
            for cut in _cuts(here):
                k = int(np.searchsorted(ranked, cut, side="right"))
                for above, p, n in ((True, pos[-1] - pos[k], neg[-1] - neg[k]), (False, pos[k], neg[k])):
                    if p > 1e-9 and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Test(name, above, float(cut)), g
        if best is None:
            break
        rule += (best,)
        live &= best.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    hit = covers(rule, x, len(bad))
    p, n = float(weight[hit & bad].sum()), float(weight[hit & ~bad].sum())
    return (p - n) / (p + n) if p + n else -1.0, p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray | None = None, precision: float = 0.9, longest: int = 4, most: int = 16, tries: int = 6, seed: int = 6) -> list[Rule]:
    """Ordered rules for bad rows; ``precision`` is what a rule must reach on its pruning rows.
    ``weight`` is how many labels a row stands for, one if not given.

    A rule that fails is tried again on another split; ``tries`` failures in a row end the search.
    """
    rules: list[Rule] = []
    weight = np.ones(len(bad)) if weight is None else weight
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), dtype=bool)
    failed = 0
    while len(rules) < most and failed < tries and bad[left].sum() >= 5:
        index = np.flatnonzero(left)
        test = rng.random(len(index)) < 1 / 3
        grow, prune = ({k: v[index[m]] for k, v in x.items()} for m in (~test, test))
        rule = _grow(grow, bad[index[~test]], weight[index[~test]], longest)
        failed += 1
        if not rule:
            continue
        y, wy = bad[index[test]], weight[index[test]]
        while len(rule) > 1:  # drop the test whose loss helps or does not hurt
            options = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
            values = [_worth(o, prune, y, wy)[0] for o in options]
            if max(values) < _worth(rule, prune, y, wy)[0]:
                break
            rule = options[int(np.argmax(values))]
        value, found = _worth(rule, prune, y, wy)
        if not found or (value + 1) / 2 < precision:
            continue
        failed = 0
        rules.append(rule)
        left &= ~covers(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, seed: int = 6, **settings) -> list[Rule]:
    """Learn from about ``most`` labelled documents of each class, held-out fold excluded, weighted
    by the labels that each stands for."""
    sample = labelled_stats(docs, labels, label, most, seed)
    bad = sample["y"].to_numpy() == 0
    if bad.all() or not bad.any():
        return []
    counts = {r["_y"]: r["count"] for r in known_labels(labels, label).groupBy("_y").count().collect()}
    weight = sample["y"].map({y: max(1.0, n / most) for y, n in counts.items()}).to_numpy()  # the inverse of the sampling share
    return learn({n: sample[n].to_numpy() for n in RATIOS}, bad, weight, **settings)


def verdict(rules: list[Rule], stats: str = "_stats") -> Column:
    """Number of the first rule that holds, from 1 on; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(stats)
        for t in rule[1:]:
            test = test & t.column(stats)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (number of the rule that fired), kept."""
    out = docs.select("doc_id", stats_column(F.col("text")).alias("_stats"))
    out = out.select("doc_id", *[stat(n).cast("bigint").alias(n) for n in COUNTS], verdict(rules).alias("rule"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("rule") == 0))


def op6(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return judged(docs, fit(docs, labels, **settings)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
