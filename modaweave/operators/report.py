"""Aggregating and ranking result tables (model, fold, data part, scores)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Method prefixes counted as linear fusions (fixed values).
LINEAR_METHODS = ("pca", "ica", "ipca", "cca", "plsda")


def method_of(model: str | Column) -> Column:
    """Text before the first underscore or digit."""
    model = F.col(model) if isinstance(model, str) else model
    return F.regexp_extract(model, r"^([^_0-9]*)", 1)


def fusion_kind(model: str | Column) -> Column:
    model = F.col(model) if isinstance(model, str) else model
    return F.when(model.rlike("^(" + "|".join(LINEAR_METHODS) + ")"), "linear").otherwise("Non-linear")


def mean_by_model(rows: DataFrame, scores: Sequence[str], model: str = "model", order: str | None = None) -> DataFrame:
    out = rows.groupBy(model).agg(*[F.avg(s).alias(s) for s in scores])
    return out.orderBy(F.desc(order or scores[0]), model)


def order_folds(rows: DataFrame, score: str, model: str = "model", fold: str = "fold") -> DataFrame:
    """Fold rows in the order of their model's mean score."""
    mean = rows.groupBy(model).agg(F.avg(score).alias("model_mean"))
    return rows.join(mean, model).orderBy(F.desc("model_mean"), model, fold)


def top_per_method(means: DataFrame, score: str, model: str = "model", n: int = 1) -> DataFrame:
    w = W.partitionBy("method").orderBy(F.desc(score), model)
    return means.withColumn("method", method_of(model)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def align_to_test(rows: DataFrame, score: str, model: str = "model", data: str = "data") -> DataFrame:
    """All data parts of every model, numbered by the model's test score."""
    test = rows.filter(F.col(data) == "test").select(model, F.col(score).alias("_s"))
    w = W.orderBy(F.desc("_s"), model)  # one row per model
    return rows.join(test.withColumn("test_rank", F.row_number().over(w)).drop("_s"), model)


def side_by_side(rows: DataFrame, score: str, model: str = "model", data: str = "data", parts: Sequence[str] = ("train", "valid", "test"), limit: float = 10.0) -> DataFrame:
    """One column per data part; models with a score outside (-limit, limit) are left out."""
    wide = rows.groupBy(model).pivot(data, list(parts)).agg(F.first(score))
    return wide.filter(reduce(lambda a, b: a & b, [(F.col(p) > -limit) & (F.col(p) < limit) for p in parts]))


def box_stats(rows: DataFrame, scores: Sequence[str], model: str = "model") -> DataFrame:
    """Five-number summary per model and score; each group is one model's fold scores."""
    long = rows.unpivot([model], list(scores), "metric", "value").filter("value is not null")
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("low", "q1", "median", "q3", "high")
    return long.groupBy(model, "metric").agg(q.alias("_q")).select(model, "metric", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def best_parameters(grid_scores: DataFrame, score: str, model: str = "model", index: str = "grid_index") -> DataFrame:
    """Best validation score per model; the earlier grid entry wins a tie."""
    rest = [c for c in grid_scores.columns if c != model]
    best = grid_scores.groupBy(model).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(index)).alias("i"))).alias("_b"))
    return best.select(model, "_b.*")


def expand_grid(base: DataFrame, params: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of parameter values for each row; the first parameter varies slowest."""
    out, size = base, 1
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        size *= len(values)
    index = F.lit(0)
    for name, values in params.items():
        position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) - 1
        index = index * len(values) + position
    return out.withColumn("grid_index", index.cast("bigint"))


def gap_by_split(rows: DataFrame, keys: Sequence[str], score: str, split: str = "split", a: str = "random", b: str = "scaffold") -> DataFrame:
    """Mean score under two split kinds and the difference."""
    wide = rows.groupBy(*keys).pivot(split, [a, b]).agg(F.avg(score))
    return wide.withColumn("gap", F.col(a) - F.col(b))


def subtotals(rows: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return rows.rollup(*keys).agg(F.avg(score).alias("mean"), F.count("*").alias("rows"))


def rounded(rows: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})
