"""The modality pipeline on arrays: every table is (id, features ARRAY<DOUBLE>), names kept beside it.

A modality may have tens of thousands of features, so nothing here makes a column or an expression
per feature.  Statistics are numpy vectors, one partial result per core, merged with the pairwise
update; applying them is one vector operation per Arrow batch.  Null and NaN entries are missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, divide_unless_zero, let, norm1, norm2, norm_max
from ..session import cut_lineage
from .profile import sparse_cutoff

SCALINGS = ("standardize", "minmax", "pareto")
NORMS = {"L1": norm1, "L2": norm2, "max": norm_max}


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of a vector column; null entries become NaN."""
    return np.array([np.asarray(v, dtype=np.float64) for v in column]).reshape(len(column), -1)


@dataclass
class PositionStats:
    """Per position: values present, mean, centred squares, smallest, largest; and the row count."""

    rows: int
    present: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> PositionStats:
        seen = ~np.isnan(x)
        n = seen.sum(axis=0)
        mean = np.where(seen, x, 0.0).sum(axis=0) / np.maximum(n, 1)
        gap = np.where(seen, x - mean, 0.0)
        return cls(len(x), n, mean, (gap * gap).sum(axis=0), np.where(seen, x, np.inf).min(axis=0, initial=np.inf), np.where(seen, x, -np.inf).max(axis=0, initial=-np.inf))

    def __add__(self, other: PositionStats) -> PositionStats:
        n = self.present + other.present
        safe = np.maximum(n, 1)
        gap = other.mean - self.mean
        mean = self.mean + gap * other.present / safe
        squares = self.squares + other.squares + gap * gap * self.present * other.present / safe
        return PositionStats(self.rows + other.rows, n, mean, squares, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    @property
    def variance(self) -> np.ndarray:
        return self.squares / np.maximum(self.present, 1)


def position_stats(df: DataFrame, vec: str = "features") -> PositionStats:
    """One pass over the vectors; one partial result per core travels, width x 6 numbers each."""
    fields = ("present", "mean", "squares", "low", "high")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for pdf in batches:
            if len(pdf):
                part = PositionStats.of(_matrix(pdf["v"]))
                whole = part if whole is None else whole + part
        if whole is not None:
            yield pd.DataFrame({"rows": [whole.rows]} | {f: [np.asarray(getattr(whole, f), dtype=np.float64)] for f in fields})

    rows = df.select(as_doubles(vec).alias("v")).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInPandas(partial, "rows long, " + ", ".join(f"{f} array<double>" for f in fields)).collect()
    if not parts:
        raise ValueError("no rows to fit on")
    return reduce(lambda a, b: a + b, [PositionStats(p["rows"], *(np.array(p[f]) for f in fields)) for p in parts])


@dataclass
class PositionScaler:
    """x -> (x or fill - center) / divisor for the positions in ``keep``."""

    center: np.ndarray
    divisor: np.ndarray
    fill: np.ndarray | None = None
    keep: np.ndarray | None = None

    def transform(self, df: DataFrame, vec: str = "features", out: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.center, self.divisor, self.fill, self.keep))

        @F.pandas_udf("array<double>")
        def apply(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            center, divisor, fill, keep = shared.value
            x = _matrix(v)
            x = x if fill is None else np.where(np.isnan(x), fill, x)
            x = (x - center) / divisor
            return pd.Series(list(x if keep is None else x[:, keep]))

        return df.withColumn(out, apply(as_doubles(vec)))


def _divisor(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x) & (x != 0), x, 1.0)


def fit(stats: PositionStats, method: str) -> PositionScaler:
    """Missing values stay missing; a zero divisor becomes 1."""
    if method == "standardize":
        return PositionScaler(stats.mean, _divisor(np.sqrt(stats.variance)))
    if method == "minmax":
        low = np.where(np.isfinite(stats.low), stats.low, 0.0)
        return PositionScaler(low, _divisor(stats.high - low))
    if method == "pareto":
        return PositionScaler(np.zeros_like(stats.mean), _divisor((stats.squares / np.maximum(stats.present - 1, 1)) ** 0.25))
    raise ValueError(f"method must be one of {SCALINGS}, got {method!r}")


def mean_filler(stats: PositionStats) -> PositionScaler:
    return PositionScaler(np.zeros_like(stats.mean), np.ones_like(stats.mean), stats.mean)


def missing(vec: str | Column) -> Column:
    """Missing entries of a vector."""
    return F.size(F.filter(as_doubles(vec), lambda x: x.isNull() | F.isnan(x)))


def normalize_rows(df: DataFrame, method: str, vec: str = "features") -> DataFrame:
    """L1, L2 or largest entry to 1; a zero vector stays as it is."""
    if method not in NORMS:
        raise ValueError(f"method must be one of {sorted(NORMS)}, got {method!r}")
    return df.withColumn(vec, let(NORMS[method](vec), lambda norm: divide_unless_zero(vec, norm)))


@dataclass
class WideSet:
    """Named (id, features) tables; ``names`` holds feature names where they are known."""

    tables: Mapping[str, DataFrame]
    names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    id_col: str = "id"

    @classmethod
    def from_columns(cls, tables: Mapping[str, DataFrame], id_col: str = "id") -> WideSet:
        """From tables with a column per feature."""
        names = {n: [c for c in t.columns if c != id_col] for n, t in tables.items()}
        arrays = {n: t.select(id_col, F.array(*[F.col(f"`{c}`").cast("double") for c in names[n]]).alias("features")) for n, t in tables.items()}
        return cls(arrays, names, id_col)

    def missing_totals(self) -> DataFrame:
        parts = [t.agg(F.coalesce(F.sum(missing("features")), F.lit(0)).cast("bigint").alias("missing")).select(F.lit(n).alias("modality"), "missing") for n, t in self.tables.items()]
        return reduce(DataFrame.unionByName, parts)

    def joined(self) -> DataFrame:
        """(id, features): all modalities of the common ids, one inner join chain."""
        parts = [t.select(self.id_col, as_doubles("features").alias(f"_v{i}")) for i, t in enumerate(self.tables.values())]
        whole = reduce(lambda a, b: a.join(b, self.id_col), parts)
        return whole.select(self.id_col, F.concat(*[F.col(f"_v{i}") for i in range(len(parts))]).alias("features"))

    def feature_names(self) -> list[str]:
        return [c for n in self.tables for c in self.names.get(n, [])]

    def prepare(self, threshold: float = 100.0) -> tuple[DataFrame, list[str]]:
        """Common ids, sparse positions out, filled with the mean, standardised: (table, names kept).

        Each table is read once; the joined vectors are written once and summarised once.  Filling
        with the mean leaves the mean alone and shrinks the variance by the share of present values.
        """
        whole = cut_lineage(self.joined())
        if whole.isEmpty():
            return whole, self.feature_names()
        s = position_stats(whole)
        keep = np.flatnonzero(s.present >= sparse_cutoff(s.rows, threshold))
        model = PositionScaler(s.mean, _divisor(np.sqrt(s.squares / max(s.rows, 1))), s.mean, keep)
        names = self.feature_names()
        return model.transform(whole), [names[i] for i in keep] if names else []
