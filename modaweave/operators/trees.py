"""Histogram trees: second-order boosting, and extremely randomised forests.

Features are cut once into bins at their quantiles.  A level of all trees being grown is one pass: each
task adds gradients and hessians into (tree, node, feature, bin) sums of its own, the sums meet by
(tree, node, feature), and each keeps its best cut; the driver sees one cut a node.

Nulls and NaN have a bin of their own and go to the side where they gain more.  Equal gains go to the
smaller feature, then the smaller bin.  Weights, where the table has them, multiply both sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of sums a task holds at a time; wider levels are summed in several passes.
SUMS = 128 << 20
#: Gains are compared to so many digits, so that the order of summation does not decide.
DIGITS = 9


def quantile_cuts(df: DataFrame, bins: int, vec: str = "features", accuracy: int = 100_000) -> list[np.ndarray]:
    """Cut points of each feature: its distinct values at ranks k / bins, from mergeable sketches.

    Exact up to ``accuracy`` rows; beyond, off by at most rows / accuracy ranks.
    """
    long = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("feature", "value"))
    shares = [k / bins for k in range(1, bins)]
    known = F.when(~F.isnan("value"), F.col("value"))
    rows = long.groupBy("feature").agg(F.percentile_approx(known, shares, accuracy).alias("cuts")).collect()  # one per feature
    cuts = [np.zeros(0)] * (1 + max((r["feature"] for r in rows), default=-1))
    for r in rows:
        cuts[r["feature"]] = np.unique(np.array(r["cuts"] or [], dtype=np.float64))
    return cuts


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: cuts below it; the missing have bin len(cuts) + 1."""
    out = np.empty(x.shape, dtype=np.int32)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), len(c) + 1, np.searchsorted(c, x[:, f], "left"))
    return out


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.array(x, dtype=np.float64) for x in v])


@dataclass
class Tree:
    """Nodes in heap order: the parts of node i are 2i + 1 and 2i + 2.  ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Node that each row has reached."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                return at
            r, a, f = rows[go], at[go], f[go]
            b = bins[r, f]
            left = np.where(b == width[f] + 1, self.missing_left[a], b <= self.bin[a])
            at[r] = 2 * a + np.where(left, 1, 2)


@dataclass
class Growth:
    """What a level needs: trees so far, open nodes of each, and the features each node may use."""

    trees: list[Tree]
    open: list[tuple[int, int]]  # (tree, node)
    features: dict[tuple[int, int], np.ndarray]


def best_cuts(g: np.ndarray, h: np.ndarray, penalty: float, gamma: float, least: float) -> np.ndarray:
    """Gain of each (cut, side of the missing): rows cut 0.., columns missing left, missing right.

    ``g`` and ``h`` are sums a bin, the missing last.
    """
    total_g, total_h = g.sum(), h.sum()
    gl, hl = np.cumsum(g[:-1])[:-1], np.cumsum(h[:-1])[:-1]
    out = np.full((len(gl), 2), -np.inf)
    for side, (extra_g, extra_h) in enumerate(((g[-1], h[-1]), (0.0, 0.0))):
        lg, lh = gl + extra_g, hl + extra_h
        rg, rh = total_g - lg, total_h - lh
        ok = (lh >= least) & (rh >= least) & (lh > 0) & (rh > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (lg**2 / (lh + penalty) + rg**2 / (rh + penalty) - total_g**2 / (total_h + penalty)) - gamma
        out[ok, side] = np.round(gain[ok], DIGITS)
    return out


def random_cut(g: np.ndarray, h: np.ndarray, cuts: np.ndarray, u: float, penalty: float, least: float) -> tuple[int, np.ndarray]:
    """(cut, its gains): the cut at share ``u`` between the outermost cuts that divide the node's rows."""
    held = np.flatnonzero(h[:-1] > 0)
    if len(held) < 2:
        return 0, np.full(2, -np.inf)
    lo, hi = held[0], held[-1] - 1
    at = lo + int(np.searchsorted(cuts[lo:hi], cuts[lo] + u * (cuts[hi] - cuts[lo]), "left")) if hi > lo else lo
    return int(at), best_cuts(g, h, penalty, 0.0, least)[at]


def share_of(*key: int) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return float(np.random.default_rng([abs(int(k)) for k in key]).random())


@dataclass
class Histograms:
    """Passes over a table of (bins, label, weight, margin, row) for the levels of trees."""

    cuts: list[np.ndarray]
    penalty: float = 1.0
    gamma: float = 0.0
    least: float = 1.0
    random: int | None = None  # seed of random cuts; None takes the best
    logistic: bool = False
    boosted: bool = True
    sample: float = 1.0
    seed: int = 42
    eta: float = 1.0
    width: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.width = np.array([len(c) for c in self.cuts], dtype=np.int64)

    def gradients(self, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.boosted:
            return -y * w, w
        if self.logistic:
            p = 1.0 / (1.0 + np.exp(-margin))
            return (p - y) * w, np.maximum(p * (1.0 - p), 1e-16) * w
        return (margin - y) * w, w

    def sums(self, rows: DataFrame, grown: Growth, earlier: list[Tree], of: list[tuple[int, int]], features: dict[tuple[int, int], np.ndarray]) -> DataFrame:
        """(tree, node, feature, s): sums of gradients, then of hessians, for each bin and the missing."""
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast((self, grown.trees, earlier, of, features))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            self, trees, earlier, of, features = shared.value
            held = {k: np.zeros((2, len(features[k]), int(self.width[features[k]].max(initial=0)) + 2)) for k in of}
            for pdf in batches:
                if not len(pdf):
                    continue
                bins, y, w = np.stack(pdf["bins"].to_list()), pdf["label"].to_numpy(), pdf["weight"].to_numpy()
                margin = pdf["margin"].to_numpy().copy()
                for t in earlier:
                    margin += self.eta * t.value[t.nodes(bins, self.width)]
                g, h = self.gradients(margin, y, w)
                for tree in sorted({t for t, _ in of}):
                    at = trees[tree].nodes(bins, self.width)
                    if self.sample < 1.0:
                        at = np.where(pdf[f"_u{tree}"].to_numpy() < self.sample, at, -1)
                    for key in (k for k in of if k[0] == tree):
                        r = np.flatnonzero(at == key[1])
                        if len(r):
                            f = features[key]
                            n = held[key].shape[2]
                            # The missing are last, whatever the number of cuts.
                            b = bins[np.ix_(r, f)]
                            b = np.where(b == self.width[f] + 1, n - 1, b) + np.arange(len(f)) * n
                            for k, v in enumerate((g, h)):
                                held[key][k] += np.bincount(b.ravel(), weights=np.repeat(v[r], len(f)), minlength=len(f) * n).reshape(len(f), n)
            for (tree, node), s in held.items():
                f = features[tree, node]
                yield pd.DataFrame({"tree": tree, "node": node, "feature": f, "s": list(np.concatenate([s[0], s[1]], axis=1))})

        sampled = rows
        if self.sample < 1.0:
            for tree in sorted({t for t, _ in of}):
                u = F.shiftrightunsigned(F.xxhash64("row", F.lit(self.seed), F.lit(tree)), 11) / F.lit(float(1 << 53))
                sampled = sampled.withColumn(f"_u{tree}", u)
        parts = sampled.mapInPandas(run, "tree int, node int, feature int, s array<double>")
        return parts.groupBy("tree", "node", "feature").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))

    def level(self, rows: DataFrame, grown: Growth, earlier: list[Tree]) -> list:
        """The best cut of each open node: tree, node, gain, feature, bin, missing_left, g, h and the left
        side's lg, lh."""
        shared = rows.sparkSession.sparkContext.broadcast((self.cuts, self.penalty, self.gamma, self.least, self.random))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cuts, penalty, gamma, least, random = shared.value
            for pdf in batches:
                out = []
                for tree, node, feature, s in zip(pdf["tree"], pdf["node"], pdf["feature"], pdf["s"], strict=True):
                    s = np.asarray(s).reshape(2, -1)
                    c = cuts[feature]
                    s = np.concatenate([s[:, : len(c) + 1], s[:, -1:]], axis=1)
                    g, h = s
                    if random is None:
                        gain = best_cuts(g, h, penalty, gamma, least)
                        k, side = divmod(int(gain.argmax()), 2) if gain.size else (0, 0)
                        best = gain[k, side] if gain.size else -np.inf
                    else:
                        k, two = random_cut(g, h, c, share_of(random, tree, node, feature), penalty, least)
                        side = int(two.argmax())
                        best = two[side]
                    lg, lh = (x[: k + 1].sum() + (x[-1] if side == 0 else 0.0) for x in (g, h))
                    out.append((tree, node, float(best), -int(feature), -k, side == 0, g.sum(), h.sum(), lg, lh))
                yield pd.DataFrame(out, columns=["tree", "node", "gain", "feature", "bin", "missing_left", "g", "h", "lg", "lh"])

        found = None
        for part in self._passes(grown):
            best = self.sums(rows, grown, earlier, list(part), part).mapInPandas(cut, "tree int, node int, gain double, feature int, bin int, missing_left boolean, g double, h double, lg double, lh double")
            found = best if found is None else found.unionByName(best)
        order = F.struct("gain", "feature", "bin", "missing_left", "g", "h", "lg", "lh")
        return found.groupBy("tree", "node").agg(F.max(order).alias("c")).select("tree", "node", "c.*").collect()  # one per open node

    def _passes(self, grown: Growth) -> list[dict[tuple[int, int], np.ndarray]]:
        """Open nodes and their features in shares whose sums fit ``SUMS``."""
        out, room = [{}], SUMS
        for key in grown.open:
            f = grown.features[key]
            size = 16 * (int(self.width.max(initial=0)) + 2)
            step = max(1, SUMS // size)
            for k in range(0, len(f), step):
                part = f[k : k + step]
                if len(part) * size > room or key in out[-1]:
                    out.append({})
                    room = SUMS
                out[-1][key] = part
                room -= len(part) * size
        return out

    def leaf(self, g: float, h: float) -> float:
        return -g / (h + self.penalty) if h + self.penalty > 0 else 0.0

    def grow(self, rows: DataFrame, trees: int, depth: int, choose, earlier: list[Tree]) -> list[Tree]:
        """Trees of at most ``depth`` levels; ``choose(tree, node)`` gives the features a node may use."""
        grown = Growth([Tree.empty(depth) for _ in range(trees)], [(t, 0) for t in range(trees)], {})
        for level in range(depth):
            grown.features = {k: choose(*k) for k in grown.open}
            after = []
            for r in self.level(rows, grown, earlier):
                t = grown.trees[r["tree"]]
                i = r["node"]
                t.value[i] = self.leaf(r["g"], r["h"])
                if r["gain"] > 0 and np.isfinite(r["gain"]):
                    t.feature[i], t.bin[i], t.missing_left[i] = -r["feature"], -r["bin"], r["missing_left"]
                    t.value[2 * i + 1] = self.leaf(r["lg"], r["lh"])
                    t.value[2 * i + 2] = self.leaf(r["g"] - r["lg"], r["h"] - r["lh"])
                    after += [(r["tree"], 2 * i + 1), (r["tree"], 2 * i + 2)]
            grown.open = sorted(after)
            if not grown.open or level + 1 == depth:
                break
        return grown.trees


def table_of_bins(df: DataFrame, cuts: list[np.ndarray], margin: float) -> DataFrame:
    """Stored (row, bins, label, weight, margin)."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("array<int>")
    def to_bins(v: pd.Series) -> pd.Series:
        return pd.Series(list(binned(_matrix(v), shared.value)) if len(v) else [], dtype=object)

    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    return cut_lineage(
        df.select(F.monotonically_increasing_id().alias("row"), to_bins(F.col("features").cast("array<double>")).alias("bins"), F.col("label").cast("double").alias("label"), weight.alias("weight"), F.lit(float(margin)).alias("margin"))
    )


@dataclass
class TreeModel:
    """``p``: base plus eta times the trees' sum (boosted; through the logistic curve for classes), or
    the trees' mean."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    base: float = 0.0
    eta: float = 1.0
    logistic: bool = False
    mean: bool = False

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, width = binned(x, self.cuts), np.array([len(c) for c in self.cuts], dtype=np.int64)
        out = np.full(len(x), self.base)
        scale = 1.0 / len(self.trees) if self.mean else self.eta
        for t in self.trees:
            out += scale * t.value[t.nodes(bins, width)]
        return 1.0 / (1.0 + np.exp(-out)) if self.logistic else out

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(shared.value.margins(_matrix(v)) if len(v) else [], dtype="float64")

        return df.withColumn("p", score(F.col("features").cast("array<double>")))


@dataclass
class SecondOrderBoosting:
    """Gradient boosting on gradients and hessians: gain with an L2 penalty on leaves and a least gain,
    rows and columns sampled for each tree.

    Margins are written every ``store`` trees, so that a pass evaluates few trees.
    """

    rounds: int = 20
    max_depth: int = 3
    eta: float = 0.3
    penalty: float = 1.0
    gamma: float = 0.0
    least: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    bins: int = 64
    regression: bool = False
    seed: int = 42
    store: int = 10

    def fit(self, df: DataFrame) -> TreeModel:
        cuts = quantile_cuts(df, self.bins)
        w = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        mean = df.agg((F.sum(w * F.col("label").cast("double")) / F.sum(w)).alias("m")).first()["m"]
        if mean is None:
            raise ValueError("no rows to fit on")
        share = min(max(mean, 1e-6), 1 - 1e-6)
        base = mean if self.regression else float(np.log(share / (1 - share)))
        h = Histograms(cuts, self.penalty, self.gamma, self.least, None, not self.regression, True, self.subsample, self.seed, self.eta)
        rows = table_of_bins(df, cuts, base)
        trees: list[Tree] = []
        fresh: list[Tree] = []
        for k in range(self.rounds):
            # A column stays with a chance of its own, and one at least does.
            u = np.random.default_rng([self.seed, k]).random(len(cuts))
            columns = np.flatnonzero(u < self.colsample) if (u < self.colsample).any() else np.array([u.argmin()])
            h.seed = self.seed + k
            (tree,) = h.grow(rows, 1, self.max_depth, lambda t, n: columns, fresh)  # noqa: B023
            trees.append(tree)
            fresh.append(tree)
            if tree.feature[0] < 0 and self.subsample >= 1.0 and self.colsample >= 1.0:
                break
            if len(fresh) >= self.store and k + 1 < self.rounds:
                rows = self._advanced(rows, h, fresh)
                fresh = []
        return TreeModel(cuts, trees, base, self.eta, not self.regression)

    def _advanced(self, rows: DataFrame, h: Histograms, fresh: list[Tree]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((h, list(fresh)))

        @F.pandas_udf("double")
        def moved(bins: pd.Series, margin: pd.Series) -> pd.Series:
            if not len(bins):
                return margin
            h, trees = shared.value
            b = np.stack(bins.to_list())
            return margin + sum(h.eta * t.value[t.nodes(b, h.width)] for t in trees)

        return cut_lineage(rows.withColumn("margin", moved("bins", "margin")))


@dataclass
class RandomCutForest:
    """Extremely randomised trees: every tree sees all rows; a node draws its features and, for each, one
    cut between the outermost that divide its rows, all from the seed, and takes the best of these."""

    trees: int = 20
    max_depth: int = 5
    min_rows: int = 1
    max_features: str | None = "sqrt"
    bins: int = 64
    regression: bool = False
    seed: int = 42

    def features(self, width: int, tree: int, node: int) -> np.ndarray:
        k = {"sqrt": int(np.sqrt(width)), "log2": int(np.log2(max(width, 2))), None: width}[self.max_features]
        return np.sort(np.random.default_rng([self.seed, tree, node]).choice(width, max(1, min(k, width)), replace=False))

    def fit(self, df: DataFrame) -> TreeModel:
        cuts = quantile_cuts(df, self.bins)
        if not cuts:
            raise ValueError("no rows to fit on")
        h = Histograms(cuts, 0.0, 0.0, float(self.min_rows), self.seed, False, False)
        rows = table_of_bins(df, cuts, 0.0)
        grown = h.grow(rows, self.trees, self.max_depth, lambda t, n: self.features(len(cuts), t, n), [])
        return TreeModel(cuts, grown, mean=True)
