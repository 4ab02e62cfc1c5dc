"""The modality set: several feature tables keyed by one entity id, handled as a unit."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import impute as _impute
from . import profile as _profile
from . import scale as _scale


class ModalitySet:
    """Named feature tables sharing an id column, plus optional labels.  Methods
    return a new set; they run jobs only where a statistic or the common id set is needed."""

    def __init__(self, tables: Mapping[str, DataFrame], id_col: str = "id", labels: DataFrame | None = None):
        if not tables:
            raise ValueError("a modality set needs at least one table")
        for name, df in tables.items():
            if id_col not in df.columns:
                raise ValueError(f"modality {name!r} has no column {id_col!r}")
        self.tables = dict(tables)
        self.id_col = id_col
        self.labels = labels

    def features(self, name: str) -> list[str]:
        return [c for c in self.tables[name].columns if c != self.id_col]

    def map(self, fn: Callable[[str, DataFrame], DataFrame]) -> ModalitySet:
        return ModalitySet({n: fn(n, df) for n, df in self.tables.items()}, self.id_col, self.labels)

    # -- alignment -------------------------------------------------------------------------
    def common_ids(self) -> DataFrame:
        """Distinct ids present in every table (and in the labels, when given)."""
        members = list(self.tables.values()) + ([self.labels] if self.labels is not None else [])
        ids = [df.select(self.id_col) for df in members]
        return reduce(lambda a, b: a.join(b, self.id_col, "left_semi"), ids[1:], ids[0]).distinct()

    def keep_common(self) -> ModalitySet:
        """Keep only ids every table has; an empty intersection stays empty.

        The id set is written once, as every table is filtered by it.
        """
        ids = cut_lineage(self.common_ids())
        keep = lambda df: df.join(ids, self.id_col, "left_semi")
        return ModalitySet(
            {n: keep(df) for n, df in self.tables.items()},
            self.id_col,
            None if self.labels is None else keep(self.labels),
        )

    def assemble(self, out: str = "features") -> DataFrame:
        """One row per id holding all features as one array (inner join on id)."""
        return self._concat(list(self.tables), out)

    def leave_one_out(self, out: str = "rest") -> dict[str, DataFrame]:
        """For each modality, the concatenation of all the others."""
        return {n: self._concat([m for m in self.tables if m != n], out) for n in self.tables}

    def pairs(self) -> list[tuple[str, str]]:
        return list(combinations(self.tables, 2))

    def subsets_replacing(self, replacement: Mapping[str, DataFrame]) -> dict[str, ModalitySet]:
        """One set per modality, with that table swapped for its replacement."""
        return {
            n: ModalitySet({**self.tables, n: replacement[n]}, self.id_col, self.labels)
            for n in self.tables
            if n in replacement
        }

    def first(self, n: int) -> ModalitySet:
        """Ablation set made of the first ``n`` modalities."""
        return ModalitySet(dict(list(self.tables.items())[:n]), self.id_col, self.labels)

    def without(self, name: str) -> ModalitySet:
        return ModalitySet({n: df for n, df in self.tables.items() if n != name}, self.id_col, self.labels)

    def _concat(self, names: list[str], out: str) -> DataFrame:
        parts = []
        for i, name in enumerate(names):
            arr = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features(name)])
            parts.append(self.tables[name].select(self.id_col, arr.alias(f"_v{i}")))
        joined = reduce(lambda a, b: a.join(b, self.id_col), parts)
        return joined.select(self.id_col, F.concat(*[F.col(f"_v{i}") for i in range(len(parts))]).alias(out))

    # -- profiling -------------------------------------------------------------------------
    def missing_totals(self) -> DataFrame:
        parts = [
            _profile.missing_total(df, self.features(n)).select(F.lit(n).alias("modality"), "missing")
            for n, df in self.tables.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def missing_by_column(self) -> DataFrame:
        parts = [
            _profile.missing_by_column(df, self.features(n)).withColumn("modality", F.lit(n))
            for n, df in self.tables.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def info(self) -> DataFrame:
        """Samples, features and missing cells per modality, with the number of common ids."""
        parts = [
            _profile.missing_total(df, self.features(n)).select(
                F.lit(n).alias("modality"), "samples", F.lit(len(self.features(n))).cast("bigint").alias("features"), "missing"
            )
            for n, df in self.tables.items()
        ]
        common = self.common_ids().agg(F.count("*").alias("n"))
        return reduce(DataFrame.unionByName, parts).withColumn("common_samples", common.scalar())

    # -- cleaning --------------------------------------------------------------------------
    def drop_sparse_features(self, threshold: float = 100.0) -> ModalitySet:
        return self.map(lambda n, df: _profile.drop_sparse(df, self.features(n), threshold, keep=[self.id_col]))

    def impute(self, method: str = "mean", **kwargs) -> ModalitySet:
        return self.map(lambda n, df: _impute.impute(df, self.features(n), method, id_col=self.id_col, **kwargs))

    def scale(self, method: str = "standardize") -> ModalitySet:
        return self.map(lambda n, df: _scale.fit(df, self.features(n), method).transform(df))

    def normalize(self, method: str, **kwargs) -> ModalitySet:
        return self.map(lambda n, df: _scale.normalize_rows(df, self.features(n), method, **kwargs))

    def transform(self, method: str, **kwargs) -> ModalitySet:
        return self.map(lambda n, df: _scale.transform(df, self.features(n), method, **kwargs))
