"""Folds and hold-out splits by seeded hash rank; every split is a small (id, split) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key
from ..session import cut_lineage
from .ranking import hash_rank, ordered_rank


def fold_of(rank: Column, n: Column, k: int) -> Column:
    """0-based fold of a 1-based rank: the first n mod k folds are one row longer."""
    base, extra = F.floor(n / k), n % k
    cut = extra * (base + 1)
    return F.when(rank <= cut, F.floor((rank - 1) / (base + 1))).otherwise(
        extra + F.floor((rank - 1 - cut) / F.greatest(base, F.lit(1)))
    ).cast("int")


def kfold(df: DataFrame, k: int, id_col: str = "id", seed: int | Column = 42) -> DataFrame:
    """Shuffled k-fold: adds ``fold``."""
    return hash_rank(df, id_col, seed=seed, name="_r", size="_n").withColumn("fold", fold_of(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")


def contiguous_kfold(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return (
        ordered_rank(df, order, name="_r").withColumn("_n", n.scalar()).withColumn("fold", fold_of(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")
    )


def stratified_kfold(df: DataFrame, k: int, label: str, id_col: str = "id", seeds: Sequence[int] = (42, 123, 456)) -> DataFrame:
    """Stratified k-fold repeated for each seed: adds ``seed`` and ``fold``."""
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = hash_rank(rows, id_col, by=["seed", label], seed=F.col("seed"), name="_r", size="_n")
    return ranked.withColumn("fold", fold_of(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")


def by_cuts(df: DataFrame, cuts: dict[str, float], id_col: str = "id", stratify: str | None = None, seed: int = 42) -> DataFrame:
    """Assign rows to named splits by rank share, e.g. {"train": .8, "valid": .1, "test": .1}."""
    if abs(sum(cuts.values()) - 1.0) > 1e-9:
        raise ValueError("split shares must add up to 1")
    by = [stratify] if stratify else []
    ranked = hash_rank(df, id_col, by=by, seed=seed, name="_r", size="_n")
    names, expr, edge = list(cuts), None, 0.0
    for name in names[:-1]:
        edge += cuts[name]
        hit = F.col("_r") <= F.floor(F.round(F.lit(edge) * F.col("_n"), 6))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(names[-1])
    return ranked.withColumn("split", expr).drop("_r", "_n")


def holdout(df: DataFrame, test: float = 0.2, id_col: str = "id", stratify: str | None = None, seed: int = 42) -> DataFrame:
    return by_cuts(df, {"train": 1.0 - test, "test": test}, id_col, stratify, seed)


def train_valid_test(df: DataFrame, id_col: str = "id", stratify: str | None = None, seed: int = 42, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    return by_cuts(df, dict(zip(("train", "valid", "test"), shares, strict=True)), id_col, stratify, seed)


def predetermined(df: DataFrame, folds: DataFrame, test_fold: int, valid_fold: int | None = None, id_col: str = "id") -> DataFrame:
    """Split from a fold-assignment table; ids it does not list go to training."""
    f = F.col("fold")
    rule = F.when(f == test_fold, "test")
    if valid_fold is not None:
        rule = rule.when(f == valid_fold, "valid")
    return df.join(folds.select(id_col, "fold"), id_col, "left").withColumn("split", rule.otherwise("train")).drop("fold")


def apply_split(tables: dict[str, DataFrame], split: DataFrame, id_col: str = "id") -> dict[str, DataFrame]:
    """Attach the same split, written once, to every modality."""
    cols = [c for c in ("seed", "fold", "split") if c in split.columns]
    split = cut_lineage(split.select(id_col, *cols))
    return {n: t.join(split.select(id_col, *cols), id_col) for n, t in tables.items()}


def invariants(split: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows, distinct ids and ids seen in more than one split: a clean split has overlap 0."""
    per_id = split.groupBy(id_col).agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    return per_id.agg(
        F.sum("n").alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("a") != F.col("b")).alias("overlap")
    )


def learning_fractions(df: DataFrame, label: str, id_col: str = "id", fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75), by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Nested stratified subsets, each class cut down to whole rows: one copy of a row per fraction it is in."""
    ranked = hash_rank(df, id_col, by=[*by, label], seed=seed, name="_r", size="_n")
    need = F.filter(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.col("_r") <= F.floor(F.round(f * F.col("_n"), 6)))
    return ranked.withColumn("fraction", F.explode(need)).drop("_r", "_n")


def shuffled(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_key(id_col, seed), id_col)
