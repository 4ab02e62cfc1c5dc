"""Missing-data, distribution and class-balance reports: one aggregate pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import to_long

RESULT_NORMAL_P = 0.05


def _is_float(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] in ("double", "float")


def absent(df: DataFrame, col: str) -> Column:
    """Null, or NaN for floating columns."""
    c = F.col(f"`{col}`")
    return c.isNull() | F.isnan(c) if _is_float(df, col) else c.isNull()


def missing_total(df: DataFrame, features: Sequence[str]) -> DataFrame:
    total = sum((F.count_if(absent(df, f)) for f in features), F.lit(0))
    return df.agg(F.count("*").alias("samples"), total.cast("bigint").alias("missing"))


def missing_by_column(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (column, missing, present, percent_missing): one pass, then a constant-size unpivot."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(absent(df, f)).alias(f) for f in features])
    long = row.unpivot(["_n"], list(features), "column", "missing")
    return long.select(
        "column",
        "missing",
        (F.col("_n") - F.col("missing")).alias("present"),
        F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("_n")), F.lit(0.0)).alias("percent_missing"),
    )


def sparse_cutoff(n: int, threshold: float) -> int:
    """Fewest values a column needs to stay; 100 means at least one value."""
    return int(((100 - threshold) / 100) * n + 1)


def drop_sparse(df: DataFrame, features: Sequence[str], threshold: float, keep: Sequence[str] = ("id",)) -> DataFrame:
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(~absent(df, f)).alias(f) for f in features]).first()
    need = sparse_cutoff(counts["_n"], threshold)
    return df.select(*keep, *[f for f in features if counts[f] >= need])


def present_by_position(df: DataFrame, vector: str, threshold: float) -> DataFrame:
    """Array form of the same rule: (pos, present, keep)."""
    n = df.agg(F.count("*").alias("n"))
    need = F.floor(F.lit((100 - threshold) / 100) * n.scalar() + 1)
    return (
        df.select(F.posexplode(vector).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("present"))
        .withColumn("keep", F.col("present") >= need)
    )


def normality(df: DataFrame, features: Sequence[str], alpha: float = RESULT_NORMAL_P) -> DataFrame:
    """D'Agostino-Pearson K-squared per column, from count and population moments."""
    row = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    long = to_long(row.withColumn("_k", F.lit(0)), ["_k"], features).filter("value is not null")
    m = long.groupBy("feature").agg(
        F.count("*").cast("double").alias("n"), F.skewness("value").alias("g1"), (F.kurtosis("value") + 3.0).alias("b2")
    )
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    # skewness test
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + F.sqrt(2.0 * (beta2 - 1.0))
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    a = F.sqrt(2.0 / (w2 - 1.0))
    m = m.withColumn("z_skew", delta * F.log(y / a + F.sqrt((y / a) * (y / a) + 1.0)))
    # kurtosis test
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1.0 + 4.0 / (root * root)))
    den = 1.0 + x * F.sqrt(2.0 / (big - 4.0))
    term = F.signum(den) * F.cbrt((1.0 - 2.0 / big) / F.abs(den))
    m = m.withColumn("z_kurt", (1.0 - 2.0 / (9.0 * big) - term) / F.sqrt(2.0 / (9.0 * big)))
    k2 = F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt")
    return (
        m.withColumn("k2", k2)
        .withColumn("p_value", F.exp(-F.col("k2") / 2.0))
        .withColumn("is_normal", F.col("p_value") > alpha)
        .select("feature", "n", "k2", "p_value", "is_normal")
    )


def infer_task(df: DataFrame, label: str) -> DataFrame:
    """binary / multiclass / regression from the label's values."""
    y = F.col(label).cast("double")
    # Two distinct values are seen from min and max alone, so no distinct set is built.
    lo_hi = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    lo, hi = lo_hi.select("lo").scalar(), lo_hi.select("hi").scalar()
    return df.agg(
        F.coalesce(F.bool_and((y == lo) | (y == hi)), F.lit(False)).alias("_two"),
        F.coalesce(F.bool_and(y == F.floor(y)), F.lit(False)).alias("_int"),
        (F.min(y) < F.max(y)).alias("_varies"),
    ).select(
        F.when(F.col("_two") & F.col("_varies"), "binary").when(F.col("_int"), "multiclass").otherwise("regression").alias("task")
    )


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Minority and majority counts, imbalance ratio, minority share, total."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(
        F.min("_n").alias("minority"),
        F.max("_n").alias("majority"),
        F.sum("_n").alias("total"),
        F.count("*").alias("classes"),
        (F.max("_n") / F.min("_n")).alias("imbalance_ratio"),
        (F.min("_n") * 100.0 / F.sum("_n")).alias("minority_percent"),
    )


def resampling_decision(balance: DataFrame) -> DataFrame:
    """Which balancing route a class profile calls for.

    The cut points are fixed values: ratio 2 / 5 / 10 / 50 / 200, minority 100 / 200 / 500.
    """
    ir, mino = F.col("imbalance_ratio"), F.col("minority")
    return balance.withColumn(
        "strategy",
        F.when(F.col("classes") < 2, "single class")
        .when((ir <= 2) & (mino > 200), "class weights")
        .when((ir > 2) & (ir <= 5) & (mino > 200), "smote")
        .when((ir > 5) & (ir <= 10) & (mino > 200), "borderline smote")
        .when((ir > 10) & (ir <= 50) & mino.between(100, 500), "smote-enn")
        .when((ir > 50) & (ir <= 200) & (mino < 500), "balanced ensemble")
        .when((ir > 200) & (mino < 500), "cost weight")
        .otherwise("class weights"),
    )


def recommended_metrics(balance: DataFrame) -> DataFrame:
    """Two lists: one above an imbalance ratio of 10, one for all else."""
    ir = F.col("imbalance_ratio")
    return balance.withColumn("metrics", F.when(ir > 10, "pr_auc,f1,recall").otherwise("roc_auc,balanced_accuracy,f1"))


def class_sizes(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Share of each class per task, untested rows left out."""
    long = df.select(F.lit(0).alias("_k"), *tasks).unpivot(["_k"], list(tasks), "task", "label").filter("label is not null")
    counts = long.groupBy("task", "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy("task").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(totals), "task").select("task", "label", "n", (F.col("n") / F.col("_t")).alias("share"))


def group_statistics(df: DataFrame, group: str, tasks: Sequence[str], top: int = 10, most_tasks: int | None = None) -> DataFrame:
    """Mean target and number of known targets for the largest groups, over the first ``most_tasks`` (default: all)."""
    tasks = tasks[:most_tasks]
    return (
        df.groupBy(group)
        .agg(
            F.count("*").alias("size"),
            *[F.avg(t).alias(f"mean_{t}") for t in tasks],
            *[F.count(t).alias(f"known_{t}") for t in tasks],
        )
        .orderBy(F.desc("size"), group)
        .limit(top)
    )
