"""Queries for metrics and for aggregating result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import metrics, report
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query, r, with_

_CELLS = "cells AS (SELECT model, fold, count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y <> 1 AND p <= 0.5) AS tn, count(*) FILTER (y <> 1 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn FROM predictions GROUP BY model, fold)"
_D = "d AS (SELECT model, fold, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn FROM cells)"
_FORMULAS = {
    "accuracy": "(tp + tn) / (tp + tn + fp + fn)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "balanced_accuracy": "coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0))",
    "mcc": "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)",
    "kappa": "coalesce(((tp + tn) / (tp + tn + fp + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) ** 2)) / nullif(1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) ** 2), 0), 0)",
}
BASE = with_(fx.MODELS, _CELLS, _D)


@query("confusion_counts", "M1", with_(fx.MODELS, _CELLS) + "SELECT model, fold, tp, tn, fp, fn FROM cells")
def _(spark, d):
    return metrics.confusion(fx.predictions(spark, d), ["model", "fold"])


for _name, _row in (("accuracy", "M2"), ("precision", "M3"), ("recall", "M4"), ("specificity", "M5"), ("f1", "M6"), ("balanced_accuracy", "M7"), ("mcc", "M8"), ("kappa", "M9")):

    @query(f"score_{_name}", f"{_row} M15", BASE + f"SELECT model, fold, {r(_FORMULAS[_name])} AS value FROM d")
    def _(spark, d, name=_name):
        return metrics.score(fx.predictions(spark, d), name, ["model", "fold"])


@query("precision_zero_is_one", "M3", with_(fx.LABELLED, "c AS (SELECT source, CAST(count(*) FILTER (toxic = 1 AND n_chars % 100 > 97) AS DOUBLE) AS tp, CAST(count(*) FILTER (n_chars % 100 > 97) AS DOUBLE) AS said FROM labelled GROUP BY source)") + f"SELECT source, {r('coalesce(tp / nullif(said, 0), 1)')} AS precision FROM c")
def _(spark, d):
    rows = fx.labelled(spark, d).select("source", F.col("toxic").alias("y"), (F.col("n_chars") % 100).alias("p"))
    return metrics.confusion(rows, ["source"], threshold=97).select("source", metrics.precision(1.0).alias("precision"))


@query("threshold_scores", "M2 M3 M4 M5 M6 M7 M8 M9", BASE + "SELECT model, fold, " + ", ".join(f"{r(f)} AS {n}" for n, f in _FORMULAS.items()) + " FROM d")
def _(spark, d):
    return metrics.threshold_scores(fx.predictions(spark, d), ["model", "fold"]).drop("tp", "tn", "fp", "fn")


@query(
    "per_class_report",
    "M6",
    with_("t AS (SELECT CAST(o_orderstatus AS VARCHAR) AS y, CASE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'O' ELSE 'F' END AS pred FROM orders)", "k AS (SELECT DISTINCT y AS class FROM t)", "c AS (SELECT class, CAST(count(*) FILTER (y = class AND pred = class) AS DOUBLE) AS hit, count(*) FILTER (y = class) AS support, CAST(count(*) FILTER (pred = class) AS DOUBLE) AS said FROM t CROSS JOIN k GROUP BY class)")
    + f"SELECT class, support, {r('hit / said')} AS precision, {r('hit / support')} AS recall, {r('2 * hit / (said + support)')} AS f1 FROM c",
)
def _(spark, d):
    o = fx.table(spark, d, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int") % 3
    return metrics.per_class(o.select(F.col("o_orderstatus").alias("y"), F.when(level == 0, "P").when(level == 1, "O").otherwise("F").alias("pred")))


@query("macro_f1", "M6", with_("t AS (SELECT CAST(o_orderstatus AS VARCHAR) AS y, CASE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'O' ELSE 'F' END AS pred FROM orders)", "k AS (SELECT DISTINCT y AS class FROM t)", "c AS (SELECT 2.0 * count(*) FILTER (y = class AND pred = class) / (count(*) FILTER (y = class) + count(*) FILTER (pred = class)) AS f1 FROM t CROSS JOIN k GROUP BY class)") + f"SELECT {r('avg(f1)')} AS macro_f1 FROM c")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int") % 3
    rows = o.select(F.col("o_orderstatus").alias("y"), F.when(level == 0, "P").when(level == 1, "O").otherwise("F").alias("pred"))
    return metrics.per_class(rows).agg(F.avg("f1").alias("macro_f1"))


def _auc_cte(keys, src="predictions", y="y"):
    return (
        f"cnt AS (SELECT {keys}, p, CAST(sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM {src} GROUP BY {keys}, p)",
        f"run AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY p) - neg AS below FROM cnt)",
        f"auc AS (SELECT {keys}, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM run GROUP BY {keys})",
    )


@query("roc_auc", "M10", with_(fx.MODELS, *_auc_cte("model, fold")) + f"SELECT model, fold, {r('roc_auc')} AS roc_auc FROM auc")
def _(spark, d):
    return metrics.roc_auc(fx.predictions(spark, d), ["model", "fold"])


@query("roc_auc_overall", "M10", with_(fx.SCORED, "one AS (SELECT 1 AS k, y, p FROM scored)", *_auc_cte("k", "one")) + f"SELECT {r('roc_auc')} AS roc_auc FROM auc")
def _(spark, d):
    return metrics.roc_auc(fx.scored(spark, d))


_CURVE = (
    "cnt AS (SELECT model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM predictions GROUP BY model, p)",
    "cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM cnt WINDOW w AS (PARTITION BY model ORDER BY p DESC))",
)


@query("average_precision", "M11", with_(fx.MODELS, *_CURVE) + f"SELECT model, {r('sum(pos / np * (tp / (tp + fp)))')} AS average_precision FROM cum GROUP BY model")
def _(spark, d):
    return metrics.average_precision(fx.predictions(spark, d), ["model"])


@query("pr_auc_trapezoid", "M12", with_(fx.MODELS, *_CURVE, "pts AS (SELECT *, coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY model ORDER BY p DESC), 1.0) AS prev FROM cum)") + f"SELECT model, {r('sum(pos / np * ((tp / (tp + fp)) + prev) / 2)')} AS pr_auc FROM pts GROUP BY model")
def _(spark, d):
    return metrics.pr_auc(fx.predictions(spark, d), ["model"])


@query("curve_points", "M12", with_(fx.MODELS, *_CURVE) + f"SELECT model, {r('p')} AS threshold, {r('tp / np')} AS tpr, {r('fp / nn')} AS fpr, {r('tp / (tp + fp)')} AS precision FROM cum")
def _(spark, d):
    return metrics.curve(fx.predictions(spark, d), ["model"]).select("model", "threshold", "tpr", "fpr", "precision")


_REG = "rows AS (SELECT l_returnflag AS part, l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)"


@query("regression_scores", "M13 M14", with_(_REG) + f"SELECT part, {r('avg(abs(y - p))', 3)} AS mae, {r('avg((y - p) ** 2)', 1)} AS mse, {r('sqrt(avg((y - p) ** 2))', 3)} AS rmse, {r('1 - avg((y - p) ** 2) / var_pop(y)')} AS r2 FROM rows GROUP BY part")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    s = metrics.regression_scores(li, ["part"])
    return s.select("part", F.round("mae", 3).alias("mae"), F.round("mse", 1).alias("mse"), F.round("rmse", 3).alias("rmse"), "r2")


_LONG = "tasks AS (SELECT doc_id AS id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN quality = 0 THEN -1 ELSE toxic END FROM labels UNION ALL SELECT doc_id, 'constant', 1 FROM labels), known AS (SELECT t.*, CAST(n_chars % 100 AS DOUBLE) / 100 AS p FROM tasks t JOIN documents d ON t.id = d.doc_id WHERE y <> -1), usable AS (SELECT * FROM known WHERE task IN (SELECT task FROM known GROUP BY task HAVING min(y) <> max(y)))"


@query(
    "multitask_mean",
    "M16",
    with_(_LONG, *_auc_cte("task", "usable"), "acc AS (SELECT task, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM usable GROUP BY task)")
    + f"SELECT {r('avg(roc_auc)')} AS roc_auc, {r('avg(accuracy)')} AS accuracy, count(*) AS tasks_used, {r('1 - count(*) / 3.0')} AS missing_ratio FROM auc JOIN acc USING (task)",
)
def _(spark, d):
    wide = fx.labelled(spark, d).withColumn("toxic", F.when(F.col("quality") == 0, -1).otherwise(F.col("toxic"))).withColumn("constant", F.lit(1))
    wide = wide.withColumn("p", (F.col("n_chars") % 100).cast("double") / 100)
    long = wide.select("id", "p", "quality", "toxic", "constant").unpivot(["id", "p"], ["quality", "toxic", "constant"], "task", "y")
    return metrics.multitask_mean(long, 3)


@query("argmax_class", "M17", "SELECT vec_id AS id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class FROM embeddings")
def _(spark, d):
    return fx.vectors(spark, d).select("id", metrics.argmax_class("features").alias("class"))


@query("ensemble_mean", "M18 V12", with_(fx.MODELS) + f"SELECT id, {r('avg(p)')} AS p FROM predictions GROUP BY id")
def _(spark, d):
    return metrics.ensemble_mean(fx.predictions(spark, d), ["id"])


@query("ensemble_on_inputs", "V12 J9", with_(fx.MODELS, "e AS (SELECT id, avg(p) AS p FROM predictions GROUP BY id)") + f"SELECT d.doc_id AS id, {r('p')} AS p FROM documents d LEFT JOIN e ON d.doc_id = e.id")
def _(spark, d):
    from ..operators.joins import scatter

    inputs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return scatter(inputs, metrics.ensemble_mean(fx.predictions(spark, d), ["id"]), "id")


_FOLD_AUC = with_(fx.MODELS, *_auc_cte("model, fold"))


def _fold_scores(spark, d):
    return metrics.roc_auc(fx.predictions(spark, d), ["model", "fold"]).withColumnRenamed("roc_auc", "score")


@query("cv_summary", "M19", _FOLD_AUC.rstrip() + ", f AS (SELECT fold, avg(roc_auc) AS m FROM auc GROUP BY fold)\n" + f"SELECT {r('avg(m)')} AS mean, {r('stddev_pop(m)')} AS std FROM f")
def _(spark, d):
    return metrics.cv_summary(_fold_scores(spark, d))


@query("task_summary", "M19", _FOLD_AUC + f"SELECT model, {r('avg(roc_auc)')} AS mean, {r('stddev_pop(roc_auc)')} AS std FROM auc GROUP BY model")
def _(spark, d):
    return metrics.task_summary(_fold_scores(spark, d), "model")


_LOG = "log AS (SELECT l_returnflag AS run, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) + avg(l_tax) AS loss FROM lineitem GROUP BY 1, 2), epochs AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY month) AS epoch, loss FROM log)"


def _epochs(spark, d):
    from pyspark.sql import Window as W

    li = fx.table(spark, d, "lineitem")
    log = li.groupBy(F.col("l_returnflag").alias("run"), F.trunc("l_shipdate", "month").alias("month")).agg((F.avg("l_discount") + F.avg("l_tax")).alias("loss"))
    return log.select("run", F.row_number().over(W.partitionBy("run").orderBy("month")).alias("epoch"), "loss")  # one row per month


@query("best_epoch", "M20", with_(_LOG, "b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rk FROM epochs)") + f"SELECT run, epoch AS best_epoch, {r('loss')} AS best_value FROM b WHERE rk = 1")
def _(spark, d):
    return metrics.best_epoch(_epochs(spark, d), ["run"])


@query(
    "best_epoch_with_patience",
    "M20",
    with_(
        _LOG,
        "m AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS low FROM epochs)",
        "g AS (SELECT *, max(CASE WHEN loss = low THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS found FROM m)",
        "s AS (SELECT *, max(CASE WHEN epoch - found > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM g)",
        "b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rk FROM s WHERE stopped = 0)",
    )
    + f"SELECT run, epoch AS best_epoch, {r('loss')} AS best_value FROM b WHERE rk = 1",
)
def _(spark, d):
    return metrics.best_epoch(_epochs(spark, d), ["run"], patience=10)


@query("loss_curve_area", "M21", with_(_LOG, "p AS (SELECT run, (epoch - lag(epoch) OVER w) * (loss + lag(loss) OVER w) / 2 AS a FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch))") + f"SELECT run, {r('sum(a)')} AS area FROM p GROUP BY run")
def _(spark, d):
    return metrics.curve_area(_epochs(spark, d), ["run"])


@query("fit_seconds", "M22")
def _(spark, d):
    from .studies import low_data_curves

    rows = fx.vectors(spark, d).select("id", "label", "features")
    out = low_data_curves(rows, ["Naive Bayes"], seeds=(42,), folds=2, fractions=(0.5,))
    return out.select("model", "fold", (F.col("seconds") > 0).alias("timed"))


# -- result tables -----------------------------------------------------------------------------------------------
_RES = _FOLD_AUC.rstrip() + ", acc AS (SELECT model, fold, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions GROUP BY model, fold), res AS (SELECT model, fold, CAST(roc_auc AS DOUBLE) AS auc, CAST(accuracy AS DOUBLE) AS accuracy, CASE WHEN fold <= 3 THEN 'train' WHEN fold = 4 THEN 'valid' ELSE 'test' END AS data FROM auc JOIN acc USING (model, fold))"


def _results(spark, d):
    p = cut_lineage(fx.predictions(spark, d))
    a = metrics.roc_auc(p, ["model", "fold"]).withColumnRenamed("roc_auc", "auc")
    b = metrics.threshold_scores(p, ["model", "fold"], ["accuracy"]).select("model", "fold", "accuracy")
    part = F.when(F.col("fold") <= 3, "train").when(F.col("fold") == 4, "valid").otherwise("test")
    return a.join(b, ["model", "fold"]).withColumn("data", part)


@query("mean_by_model", "A1", _RES + f"\nSELECT model, {r('avg(auc)')} AS auc, {r('avg(accuracy)')} AS accuracy FROM res GROUP BY model ORDER BY 2 DESC, model")
def _(spark, d):
    return report.mean_by_model(_results(spark, d), ["auc", "accuracy"])


@query("folds_by_model_mean", "A2", _RES + f"\nSELECT model, fold, {r('auc')} AS auc, {r('avg(auc) OVER (PARTITION BY model)')} AS model_mean FROM res")
def _(spark, d):
    return report.order_folds(_results(spark, d), "auc").select("model", "fold", "auc", "model_mean")


@query("method_and_kind", "A3 A8", with_(fx.MODELS) + "SELECT DISTINCT model, regexp_extract(model, '^([^_0-9]*)', 1) AS method, CASE WHEN regexp_matches(model, '^(pca|ica|ipca|cca|plsda)') THEN 'linear' ELSE 'Non-linear' END AS kind FROM predictions")
def _(spark, d):
    m = fx.predictions(spark, d).select("model").distinct()
    return m.select("model", report.method_of("model").alias("method"), report.fusion_kind("model").alias("kind"))


@query("top_model_per_method", "A4", _RES + f", m AS (SELECT model, avg(auc) AS auc, regexp_extract(model, '^([^_0-9]*)', 1) AS method FROM res GROUP BY model), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY auc DESC, model) AS rank FROM m)\nSELECT model, {r('auc')} AS auc, method, rank FROM k WHERE rank = 1")
def _(spark, d):
    return report.top_per_method(report.mean_by_model(_results(spark, d), ["auc"]), "auc")


_PARTS = ", byd AS (SELECT model, data, avg(auc) AS auc FROM res GROUP BY model, data)"


def _by_data(spark, d):
    return _results(spark, d).groupBy("model", "data").agg(F.avg("auc").alias("auc"))


@query("parts_in_test_order", "A5", _RES + _PARTS + f", t AS (SELECT model, row_number() OVER (ORDER BY auc DESC, model) AS test_rank FROM byd WHERE data = 'test')\nSELECT model, data, {r('auc')} AS auc, test_rank FROM byd JOIN t USING (model)")
def _(spark, d):
    return report.align_to_test(cut_lineage(_by_data(spark, d)), "auc")


@query("parts_side_by_side", "A6", _RES + _PARTS + ", w AS (SELECT model, max(CASE WHEN data = 'train' THEN auc END) AS train, max(CASE WHEN data = 'valid' THEN auc END) AS valid, max(CASE WHEN data = 'test' THEN auc END) AS test FROM byd GROUP BY model)\n" + f"SELECT model, {r('train')} AS train, {r('valid')} AS valid, {r('test')} AS test FROM w WHERE abs(train) < 10 AND abs(valid) < 10 AND abs(test) < 10")
def _(spark, d):
    return report.side_by_side(_by_data(spark, d), "auc")


@query("box_plot_stats", "A7", _RES + ", l AS (SELECT model, 'auc' AS metric, auc AS v FROM res UNION ALL SELECT model, 'accuracy', accuracy FROM res)\n" + f"SELECT model, metric, {r('min(v)')} AS low, {r('quantile_cont(v, 0.25)')} AS q1, {r('median(v)')} AS median, {r('quantile_cont(v, 0.75)')} AS q3, {r('max(v)')} AS high FROM l GROUP BY model, metric")
def _(spark, d):
    return report.box_stats(_results(spark, d), ["auc", "accuracy"])


@query("best_parameters", "A9", _RES + f", g AS (SELECT model, fold AS grid_index, round(auc, 2) AS score FROM res), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, grid_index) AS rk FROM g)\nSELECT model, grid_index, {r('score')} AS score FROM k WHERE rk = 1")
def _(spark, d):
    g = _results(spark, d).select("model", F.col("fold").alias("grid_index"), F.round("auc", 2).alias("score"))
    return report.best_parameters(g, "score")


@query("expanded_grid", "A10", with_(fx.MODELS, "m AS (SELECT DISTINCT model FROM predictions)", "a AS (SELECT unnest([3, 5, 10]) AS depth, unnest([0, 1, 2]) AS i)", "b AS (SELECT unnest(['gini', 'entropy']) AS criterion, unnest([0, 1]) AS j)") + "SELECT model, CAST(depth AS BIGINT) AS depth, criterion, CAST(i * 2 + j AS BIGINT) AS grid_index FROM m CROSS JOIN a CROSS JOIN b")
def _(spark, d):
    models = fx.predictions(spark, d).select("model").distinct()
    return report.expand_grid(models, {"depth": [3, 5, 10], "criterion": ["gini", "entropy"]})


@query("split_gap", "A11", _RES + f", s AS (SELECT model, auc, CASE WHEN fold <= 2 THEN 'random' ELSE 'scaffold' END AS split FROM res), w AS (SELECT model, avg(CASE WHEN split = 'random' THEN auc END) AS random, avg(CASE WHEN split = 'scaffold' THEN auc END) AS scaffold FROM s GROUP BY model)\nSELECT model, {r('random')} AS random, {r('scaffold')} AS scaffold, {r('random - scaffold')} AS gap FROM w")
def _(spark, d):
    rows = _results(spark, d).withColumn("split", F.when(F.col("fold") <= 2, "random").otherwise("scaffold"))
    return report.gap_by_split(rows, ["model"], "auc")


@query("subtotals", "A11", _RES + f"\nSELECT data, model, {r('avg(auc)')} AS mean, count(*) AS rows FROM res GROUP BY ROLLUP (data, model)")
def _(spark, d):
    return report.subtotals(_results(spark, d), ["data", "model"], "auc")


@query("rounded_records", "A12", _RES + f"\nSELECT model, fold, {r('auc', 4)} AS auc, {r('accuracy', 4)} AS accuracy FROM res")
def _(spark, d):
    return report.rounded(_results(spark, d), ["auc", "accuracy"]).drop("data")


@query("model_score_suite", "M1 M10 M11 M12", with_(fx.MODELS, *_auc_cte("model"), "acc AS (SELECT model, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions GROUP BY model)") + f"SELECT model, {r('roc_auc')} AS roc_auc, {r('accuracy')} AS accuracy FROM auc JOIN acc USING (model)")
def _(spark, d):
    p = fx.predictions(spark, d)
    parts = [metrics.roc_auc(p, ["model"]), metrics.threshold_scores(p, ["model"], ["accuracy"]).select("model", "accuracy")]
    return reduce(lambda a, b: a.join(b, "model"), parts)

