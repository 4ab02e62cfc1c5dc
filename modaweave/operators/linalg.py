"""Moments and cross-products of vector columns, reduced on the cluster.

Every partition reduces its own rows to one set of moments, and Spark's vector sum adds them with
map-side combining.  Only width x width numbers reach the driver, checked against a limit.
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

MAX_WIDTH = 8192
#: Widest vectors whose whole covariance is formed; wider ones go through products with a few vectors.
DENSE_WIDTH = 2048
#: Features in a row of partial sums.
TILE = 4096


@dataclass
class Moments:
    """Row count, column sums and sum of outer products; addition merges two of them.

    ``centred`` products are about the mean, and merge with the pairwise update: nothing cancels
    when the data lie far from zero.
    """

    n: int
    total: np.ndarray
    outer: np.ndarray
    centred: bool = False

    def __add__(self, other: Moments) -> Moments:
        if self.centred != other.centred:
            raise ValueError("centred and raw products do not add up")
        n, outer = self.n + other.n, self.outer + other.outer
        if self.centred and self.n and other.n:
            d = other.mean - self.mean
            outer = outer + np.outer(d, d) * (self.n / n * other.n)
        return Moments(n, self.total + other.total, outer, self.centred)

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    @property
    def raw(self) -> np.ndarray:
        """Sum of outer products of the rows as they are."""
        return self.outer + self.n * np.outer(self.mean, self.mean) if self.centred else self.outer

    @property
    def covariance(self) -> np.ndarray:
        """Sample covariance."""
        if self.centred:
            return self.outer / max(self.n - 1, 1)
        m = self.mean
        return (self.outer - self.n * np.outer(m, m)) / max(self.n - 1, 1)


def _rows(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def width_of(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("d")).first()
    if row is None:
        raise ValueError("no rows to fit on")
    if row["d"] > MAX_WIDTH:
        raise ValueError(f"{row['d']} features exceed {MAX_WIDTH}; reduce each modality first")
    return row["d"]


def moments(df: DataFrame, vec: str = "features") -> Moments:
    d = width_of(df, vec)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((d + 1, d + 1))
        for pdf in batches:
            if len(pdf):
                # A leading 1 makes counts and sums part of the same product.
                x = np.column_stack([np.ones(len(pdf)), _rows(pdf["v"])])
                acc += x.T @ x
        yield pd.DataFrame({"i": np.arange(d + 1), "row": list(acc)})

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(partial, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
    full = np.zeros((d + 1, d + 1))
    for r in summed.select("i", vector_to_array("s").alias("s")).collect():
        full[r["i"]] = r["s"]
    return Moments(int(round(full[0, 0])), full[0, 1:].copy(), full[1:, 1:].copy())


def vector_mean(df: DataFrame, vec: str) -> np.ndarray:
    row = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).first()
    return row["m"].toArray()


def centred_moments(df: DataFrame, vec: str = "features") -> Moments:
    """Moments after subtracting the mean: the stable form for covariance work."""
    m = vector_mean(df, vec)
    shift = F.array(*[F.lit(float(x)) for x in m])
    moved = df.select(F.zip_with(F.col(vec).cast("array<double>"), shift, lambda x, c: x - c).alias(vec))
    out = moments(moved, vec)
    # Report sums of the original rows; the outer products stay centred.
    # What is left of the shifted mean is taken out once more.
    rest = out.total / max(out.n, 1)
    return Moments(out.n, out.total + out.n * m, out.outer - out.n * np.outer(rest, rest), True)


def project(df: DataFrame, weights: np.ndarray, center: np.ndarray | None = None, vec: str = "features", out: str = "features") -> DataFrame:
    """rows -> (x - center) @ weights, one matrix product per Arrow batch."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(weights), center))

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        w, c = shared.value
        x = _rows(v)
        return pd.Series(list((x if c is None else x - c) @ w))

    return df.withColumn(out, apply(F.col(vec).cast("array<double>")))


def fix_signs(weights: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude entry of each column positive."""
    pick = np.abs(weights).argmax(axis=0)
    sign = np.sign(weights[pick, np.arange(weights.shape[1])])
    return weights * np.where(sign == 0, 1.0, sign)


# -- wide vectors: products with a few vectors, never a width x width array ---------------------------
def plain_width(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("d")).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return row["d"]


def tiled_sum(df: DataFrame, columns: Sequence[str], part: Callable[[list[np.ndarray]], np.ndarray], width: int, k: int) -> np.ndarray:
    """Sum over all rows of ``part(batch)``, a (width, k) array.  A task adds up its own rows and emits
    the sum in tiles of features; tiles meet on the cluster, and width x k numbers reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((width, k))
        for pdf in batches:
            if len(pdf):
                acc += part([_rows(pdf[c]) for c in columns])
        for t, lo in enumerate(range(0, width, TILE)):
            yield pd.DataFrame({"tile": [t], "s": [acc[lo : lo + TILE].ravel()]})

    cast = df.select(*[F.col(c).cast("array<double>").alias(c) for c in columns])
    summed = cast.mapInPandas(run, "tile int, s array<double>").groupBy("tile").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    out = np.zeros((width, k))
    for r in summed.select("tile", vector_to_array("s").alias("s")).collect():
        lo = r["tile"] * TILE
        out[lo : lo + TILE] = np.array(r["s"]).reshape(-1, k)
    return out


def covariance_times(df: DataFrame, vec: str, mean: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """Sample covariance times the columns of ``v``, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast((mean, v))

    def part(cols: list[np.ndarray]) -> np.ndarray:
        m, v = shared.value
        x = cols[0] - m
        return x.T @ (x @ v)

    return tiled_sum(df, [vec], part, len(mean), v.shape[1]) / max(n - 1, 1)


@dataclass
class Leading:
    """The first components of a covariance; ``residual`` is their largest |C u - a u| as a share of the
    largest variance, after ``passes`` over the table."""

    n: int
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int


def leading_components(df: DataFrame, k: int, vec: str = "features", extra: int = 8, most: int = 30, tolerance: float = 1e-9, seed: int = 42) -> Leading:
    """Randomised range finder: a block of ``k + extra`` random vectors and its products with the
    covariance, orthonormal, until the first ``k`` Ritz vectors leave no residual.

    A pass over the table per block; the basis is at most width x (k + extra) x ``most`` numbers, and is
    cut back to the Ritz vectors beyond a fifth of that.
    """
    d = plain_width(df, vec)
    n = df.count()
    mean = vector_mean(df, vec)
    block = min(d, k + extra)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, block)))
    images = np.zeros((d, 0))
    fresh, passes = basis, 0
    while True:
        image = covariance_times(df, vec, mean, n, fresh)
        passes += 1
        images = np.column_stack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        lead = min(k, len(values))
        rest = images @ turn[:, :lead] - (basis @ turn[:, :lead]) * values[:lead]
        residual = float(np.linalg.norm(rest, axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or passes >= most or basis.shape[1] >= d:
            break
        if basis.shape[1] + block > max(6 * block, most * block // 5):
            keep = turn[:, : 2 * block]
            basis, images = basis @ keep, images @ keep
        fresh = image
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        fresh, size = np.linalg.qr(fresh)
        # Directions that the basis holds already are noise.
        held = np.abs(np.diag(size)) > 1e-12 * max(values[0], 1e-300)
        fresh = fresh[:, held][:, : d - basis.shape[1]]
        if not fresh.shape[1]:
            break
        fresh = fresh - basis @ (basis.T @ fresh)
        fresh, _ = np.linalg.qr(fresh)
        basis = np.column_stack([basis, fresh])
    return Leading(n, mean, fix_signs(basis @ turn[:, :lead]), np.maximum(values[:lead], 0.0), residual, passes)
