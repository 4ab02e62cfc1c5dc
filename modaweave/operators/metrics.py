"""Scores as distributed aggregates over (y, p) rows, for any grouping keys.

Threshold scores come from one pass of four counters.  Rank scores first count rows per distinct
score, so ties and hot scores are single rows, then use a running sum over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import ordered_cumsum


def _d(x: str) -> Column:
    return F.col(x).cast("double")


# -- threshold scores -----------------------------------------------------------------------------
def confusion(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """tp, tn, fp, fn with a positive prediction strictly above the threshold."""
    pos, hit = F.col(y) == 1, F.col(p) > threshold
    return df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"),
        F.count_if(~pos & ~hit).alias("tn"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"),
    )


def _ratio(a: Column, b: Column, if_zero: float | None = 0.0) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if if_zero is None else F.coalesce(r, F.lit(if_zero))


def _cells() -> tuple[Column, Column, Column, Column]:
    return _d("tp"), _d("tn"), _d("fp"), _d("fn")


def accuracy() -> Column:
    tp, tn, fp, fn = _cells()
    return _ratio(tp + tn, tp + tn + fp + fn)


def precision(zero_division: float = 0.0) -> Column:
    tp, _, fp, _ = _cells()
    return _ratio(tp, tp + fp, zero_division)


def recall() -> Column:
    tp, _, _, fn = _cells()
    return _ratio(tp, tp + fn)


def specificity() -> Column:
    _, tn, fp, _ = _cells()
    return _ratio(tn, tn + fp)


def f1() -> Column:
    tp, _, fp, fn = _cells()
    return _ratio(2 * tp, 2 * tp + fp + fn)


def balanced_accuracy() -> Column:
    """Mean recall over the classes that occur."""
    tp, tn, fp, fn = _cells()
    sens, spec = _ratio(tp, tp + fn, None), _ratio(tn, tn + fp, None)
    return F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2)


def mcc() -> Column:
    tp, tn, fp, fn = _cells()
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def kappa() -> Column:
    tp, tn, fp, fn = _cells()
    n = tp + tn + fp + fn
    agree = _ratio(tp + tn, n)
    chance = _ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return _ratio(agree - chance, 1 - chance)


THRESHOLD: dict[str, Callable[[], Column]] = {
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "specificity": specificity,
    "f1": f1,
    "balanced_accuracy": balanced_accuracy,
    "mcc": mcc,
    "kappa": kappa,
}


def threshold_scores(df: DataFrame, by: Sequence[str] = (), names: Sequence[str] = tuple(THRESHOLD), **kwargs) -> DataFrame:
    return confusion(df, by, **kwargs).withColumns({n: THRESHOLD[n]() for n in names})


# -- rank scores ------------------------------------------------------------------------------------
def _by_score(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Exact, tie-aware: the share of (positive, negative) pairs ordered right, ties count half."""
    cum = ordered_cumsum(_by_score(df, by, y, p), [p], ["neg"], by)
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return cum.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """One row per distinct score, from the highest: running tp and fp, tpr, fpr, precision, recall."""
    scored = _by_score(df, by, y, p)
    cum = ordered_cumsum(scored, [F.desc(p)], ["pos", "neg"], by, total="all_")
    return cum.select(
        *by,
        F.col(p).alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        _ratio(_d("cum_pos"), _d("all_pos"), None).alias("tpr"),
        _ratio(_d("cum_neg"), _d("all_neg"), None).alias("fpr"),
        _ratio(_d("cum_pos"), _d("cum_pos") + _d("cum_neg"), None).alias("precision"),
        _ratio(_d("cum_pos"), _d("all_pos"), None).alias("recall"),
        F.try_divide(_d("pos"), _d("all_pos")).alias("_gain"),
        F.col("pos").alias("_pos"),
        F.col("neg").alias("_neg"),
    )


def average_precision(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Sum over distinct scores of recall gain times precision."""
    return curve(df, by, y, p).groupBy(*by).agg(F.sum(F.col("_gain") * F.col("precision")).alias("average_precision"))


def pr_auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid under the precision-recall curve, started at (recall 0, precision 1).

    The point before each score follows from the running sums themselves, so no neighbouring row
    is needed.
    """
    c = curve(df, by, y, p)
    tp0, fp0 = _d("tp") - F.col("_pos"), _d("fp") - F.col("_neg")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    return c.groupBy(*by).agg(F.sum(F.col("_gain") * (F.col("precision") + before) / 2).alias("pr_auc"))


# -- regression ----------------------------------------------------------------------------------------
def regression_scores(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    e = _d(y) - _d(p)
    return (
        df.groupBy(*by)
        .agg(
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e * e).alias("mse"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.var_pop(_d(y)).alias("_v"),
        )
        .withColumn("r2", 1.0 - F.try_divide(F.col("mse"), F.col("_v")))
        .drop("_v")
    )


# -- by name -------------------------------------------------------------------------------------------
def score(df: DataFrame, metric: str, by: Sequence[str] = (), **kwargs) -> DataFrame:
    """(by..., value) for a metric chosen by name."""
    ranked = {"roc_auc": roc_auc, "auc": roc_auc, "average_precision": average_precision, "pr_auc": pr_auc}
    if metric in THRESHOLD:
        return threshold_scores(df, by, [metric], **kwargs).select(*by, F.col(metric).alias("value"))
    if metric in ranked:
        out = ranked[metric](df, by, **kwargs)
        return out.select(*by, F.col(out.columns[-1]).alias("value"))
    if metric in ("mae", "mse", "rmse", "r2"):
        return regression_scores(df, by, **kwargs).select(*by, F.col(metric).alias("value"))
    raise ValueError(f"unknown metric {metric!r}")


# -- multi-task and multi-class ------------------------------------------------------------------------
def testable_tasks(long: DataFrame, task: str = "task", y: str = "y", empty: int = -1) -> DataFrame:
    """Known labels of the tasks that show more than one class."""
    known = long.filter(F.col(y).isNotNull() & (F.col(y) != empty))
    good = known.groupBy(task).agg(F.min(y).alias("_a"), F.max(y).alias("_b")).filter("_a <> _b").select(task)
    return known.join(good, task, "left_semi")


def multitask_mean(long: DataFrame, n_tasks: int, task: str = "task", y: str = "y", p: str = "p", empty: int = -1) -> DataFrame:
    """Mean ROC AUC and accuracy over testable tasks, with the share of tasks left out."""
    use = testable_tasks(long, task, y, empty)
    auc = roc_auc(use, [task], y, p)
    acc = threshold_scores(use, [task], ["accuracy"], y=y, p=p).select(task, "accuracy")
    return auc.join(acc, task).agg(
        F.avg("roc_auc").alias("roc_auc"),
        F.avg("accuracy").alias("accuracy"),
        F.count("*").alias("tasks_used"),
        (1.0 - F.count("*") / F.lit(float(n_tasks))).alias("missing_ratio"),
    )


def argmax_class(p: str | Column) -> Column:
    """Index of the first largest score."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def per_class(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, from the pair counts."""
    pairs = df.groupBy(y, pred).agg(F.count("*").alias("n"))
    actual = pairs.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("said"))
    both = actual.join(said, "class", "full").na.fill(0, ["support", "hit", "said"])
    s, r, h = _d("said"), _d("support"), _d("hit")
    return both.select("class", "support", _ratio(h, s).alias("precision"), _ratio(h, r).alias("recall"), _ratio(2 * h, s + r).alias("f1"))


def ensemble_mean(df: DataFrame, keys: Sequence[str] = ("id", "task"), p: str = "p") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(p).alias(p))


def cv_summary(scores: DataFrame, fold: str = "fold", value: str = "score") -> DataFrame:
    """Mean over tasks inside each fold (NaN left out), then mean and population std over folds."""
    v = F.when(~F.isnan(_d(value)), _d(value))
    folds = scores.groupBy(fold).agg(F.avg(v).alias("m"))
    return folds.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def task_summary(scores: DataFrame, task: str = "task", value: str = "score") -> DataFrame:
    v = F.when(~F.isnan(_d(value)), _d(value))
    return scores.groupBy(task).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def best_epoch(log: DataFrame, run: Sequence[str], epoch: str = "epoch", value: str = "loss", patience: int | None = None) -> DataFrame:
    """Epoch with the smallest value before training would have stopped.

    With ``patience``, rows after the first gap of more than that many epochs without an
    improvement do not count.  A run's log is one row per epoch.
    """
    past = W.partitionBy(*run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    rows = log.withColumn("_best", F.min(F.struct(F.col(value), F.col(epoch))).over(past))
    if patience is not None:
        gap = F.col(epoch) - F.col("_best")[epoch]
        rows = rows.withColumn("_stopped", F.max((gap > patience).cast("int")).over(past)).filter("_stopped = 0")
    return rows.groupBy(*run).agg(F.min(F.struct(F.col(value), F.col(epoch))).alias("_m")).select(
        *run, F.col("_m")[epoch].alias("best_epoch"), F.col("_m")[value].alias("best_value")
    )


def curve_area(log: DataFrame, run: Sequence[str], x: str = "epoch", y: str = "loss") -> DataFrame:
    """Trapezoid area under a logged curve."""
    w = W.partitionBy(*run).orderBy(x)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    return log.withColumn("_a", (F.col(x) - px) * (F.col(y) + py) / 2).groupBy(*run).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))
