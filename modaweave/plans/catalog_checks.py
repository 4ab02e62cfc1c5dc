"""Queries whose rows are conditions that a right result meets, so that SQL can state them: spectra by
their power sums, scores by their covariance, fits by the gradient that vanishes there."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bitsearch, descent, folds, fuse, learners, linalg, neighbours, sample, split
from ..session import cut_lineage
from ..sources import store
from . import fixtures as fx
from . import studies
from .catalog_neighbours import TANIMOTO_SQL
from .registry import query, r, with_


def _vec(spark, d) -> DataFrame:
    return cut_lineage(fx.vectors(spark, d).select("id", "label", "features"))


def _identity(n: int, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS method, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range({n}) a(i), range({n}) b(j)" for m in names)


def _covariance(df: DataFrame, vec: str, scale: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Sample covariance of a short vector column, divided by ``scale`` in rows and columns."""
    m = linalg.centred_moments(df, vec)
    c = m.covariance / (1.0 if scale is None else np.outer(scale, scale))
    return [(i, j, float(np.round(c[i, j], 4)) + 0.0) for i in range(len(c)) for j in range(len(c))]


def _rows(spark, found: dict[str, list[tuple[int, int, float]]]) -> DataFrame:
    return spark.createDataFrame([(m, *x) for m, rows in found.items() for x in rows], "method string, i int, j int, v double")


# -- fusion -------------------------------------------------------------------------------------------
_SPECTRUM = with_(
    fx.CELLS,
    "m AS (SELECT pos, avg(v) AS mu, count(*) AS n FROM cells GROUP BY pos)",
    "c AS MATERIALIZED (SELECT x.pos AS i, y.pos AS j, sum((x.v - a.mu) * (y.v - b.mu)) / (max(a.n) - 1) AS v FROM cells x JOIN cells y USING (id) JOIN m a ON a.pos = x.pos JOIN m b ON b.pos = y.pos GROUP BY ALL)",
    "q AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY ALL)",
    "t AS (SELECT 1 AS p, sum(v) AS v FROM c WHERE i = j UNION ALL SELECT 2, sum(v) FROM q WHERE i = j UNION ALL SELECT 3, sum(q.v * c.v) FROM q JOIN c ON c.i = q.j AND c.j = q.i UNION ALL SELECT 4, sum(a.v * b.v) FROM q a JOIN q b ON a.i = b.j AND a.j = b.i)",
)


def _powers(spark, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(p, float((values**p).sum())) for p in range(1, 5)], "power int, total double")


@query("pca_spectrum", "F1 F6", _SPECTRUM + f"SELECT CAST(p AS BIGINT) AS power, {r('v', 4)} AS total FROM t", digits=4)
def _(spark, d):
    return _powers(spark, fuse.pca(_vec(spark, d), 64).explained)


@query("incremental_pca_spectrum", "F2", _SPECTRUM + f"SELECT CAST(p AS BIGINT) AS power, {r('v', 4)} AS total FROM t", digits=4)
def _(spark, d):
    v = _vec(spark, d)
    return _powers(spark, fuse.incremental_pca([v.filter(F.pmod("id", F.lit(4)) == i) for i in range(4)], 64).explained)


@query("component_scores", "F1 F2 F3 F6", _identity(4, "pca", "ipca", "kpca", "ica", "wide"), digits=4)
def _(spark, d):
    """Covariance of the scores, over the components' variances: the identity."""
    v = _vec(spark, d)
    models = {
        "pca": fuse.pca(v, 4),
        "ipca": fuse.incremental_pca([v.filter(F.pmod("id", F.lit(3)) == i) for i in range(3)], 4),
        "kpca": fuse.kernel_pca(v, 4),
        "ica": fuse.ica(v, 4),
        "wide": fuse.pca(v, 4, dense=8),
    }
    return _rows(spark, {n: _covariance(m.transform(v), "features", None if m.explained is None else np.sqrt(m.explained)) for n, m in models.items()})


@query("range_finder", "F1", "SELECT CAST(i AS BIGINT) AS component, CAST(0.0 AS DOUBLE) AS apart, true AS settled FROM range(6) t(i)")
def _(spark, d):
    """Components without a covariance, against those from one."""
    v = _vec(spark, d)
    exact, lead = fuse.pca(v, 6), linalg.leading_components(v, 6, most=60)
    apart = np.abs(lead.values / exact.explained - 1).round(5) + 0.0
    return spark.createDataFrame([(i, float(apart[i]), lead.residual <= 1e-6) for i in range(6)], "component int, apart double, settled boolean")


@query("cca_scores", "F4", _identity(6, "cca"), digits=4)
def _(spark, d):
    """Covariance of both sides' scores, each side's correlation with its partner taken out: the identity."""
    v = cut_lineage(fx.vector_modalities(spark, d))
    model = fuse.cca(v, "a", "b", 3)
    rows = _covariance(model.transform(v, "a", "b"), "features")
    partner = {(i, i + 3): c for i, c in enumerate(model.correlations)} | {(i + 3, i): c for i, c in enumerate(model.correlations)}
    return _rows(spark, {"cca": [(i, j, round(x - float(np.round(partner.get((i, j), 0.0), 4)), 3) + 0.0) for i, j, x in rows]})


@query(
    "pls_first_score",
    "F5",
    with_(
        fx.CELLS,
        "z AS (SELECT id, pos, label, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS z, label - avg(label) OVER p AS y FROM cells WINDOW p AS (PARTITION BY pos))",
        "w AS (SELECT pos, sum(z * y) AS w FROM z GROUP BY pos)",
        "u AS (SELECT pos, w / sqrt(sum(w * w) OVER ()) AS w FROM w)",
    )
    + f"SELECT id, {r('sum(z * w)')} AS score FROM z JOIN u USING (pos) GROUP BY id",
)
def _(spark, d):
    v = _vec(spark, d)
    return fuse.pls(v, "label", 4).transform(v).select("id", F.col("features")[0].alias("score"))


@query("fusion_standardised", "F0 F14", " UNION ALL ".join(f"SELECT '{m}' AS method, CAST(i AS BIGINT) AS pos, CAST(0.0 AS DOUBLE) AS mean, CAST(1.0 AS DOUBLE) AS std FROM range(4) t(i)" for m in ("pca", "rks", "plsda", "integrate")), digits=6)
def _(spark, d):
    v = cut_lineage(fx.vector_modalities(spark, d))
    out = []
    for m in ("pca", "rks", "plsda", "integrate"):
        fused = cut_lineage(fuse.fuse(v, ["a", "b", "c"], m, 4, "label")[1])
        long = studies.standardised(fused)[0].select(F.posexplode("features").alias("pos", "v"))
        out.append(long.groupBy("pos").agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.stddev_pop("v").alias("std")).select(F.lit(m).alias("method"), "pos", "mean", "std"))
    return reduce(DataFrame.unionByName, out)


@query("integration_gradient", "F11", "SELECT unnest(['a', 'b', 'c']) AS modality, CAST(0.0 AS DOUBLE) AS gradient", digits=4)
def _(spark, d):
    """Largest entry of each modality's ridge gradient at its regression."""
    v = cut_lineage(fx.vector_modalities(spark, d))
    names = ["a", "b", "c"]
    model = fuse.integrate(v, names, 4)
    means = {n: linalg.vector_mean(v, n) for n in names}
    found = []
    for n in names:
        rest = [o for o in names if o != n]
        w, c = model.regressions[n]
        at = np.concatenate([means[o] for o in rest])

        def part(cols, w=w, c=c, at=at):
            x = np.column_stack(cols[1:])
            return (x - at).T @ (cols[0] - x @ w - c)

        slope = linalg.tiled_sum(v, [n, *rest], part, len(w), w.shape[1]) - w
        found.append((n, float(np.round(np.abs(slope).max(), 4))))
    return spark.createDataFrame(found, "modality string, gradient double")


@query("recompressed_prefixes", "F13", "SELECT CAST(unnest([2, 4, 8]) AS BIGINT) AS k, (SELECT count(*) FROM embeddings) AS rows, CAST(0.0 AS DOUBLE) AS apart", digits=6)
def _(spark, d):
    """A narrower output is the beginning of the widest one, row by row."""
    v = cut_lineage(fx.vector_modalities(spark, d))
    models = fuse.recompress(fuse.integrate(v, ["a", "b", "c"], 16), [2, 4, 8, 16])
    widest = models[16].transform(v).select("id", F.col("features").alias("_w"))
    out = []
    for k in (2, 4, 8):
        both = models[k].transform(v).select("id", "features").join(widest, "id")
        gap = F.array_max(F.zip_with("features", F.slice("_w", 1, k), lambda x, y: F.abs(x - y)))
        out.append(both.agg(F.count("*").alias("rows"), F.max(gap).alias("apart")).select(F.lit(k).alias("k"), "rows", "apart"))
    return reduce(DataFrame.unionByName, out)


# -- balancing ----------------------------------------------------------------------------------------
def _rare(spark, d) -> DataFrame:
    return cut_lineage(fx.vectors(spark, d).select("id", (F.col("cls") == 0).cast("int").alias("label"), "features"))


_RARE = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings), few AS (SELECT arg_min(label, (n, label)) AS label, max(n) - min(n) AS need FROM (SELECT label, count(*) AS n FROM v GROUP BY label))"
_AROUND = "around AS (SELECT a.id, a.label AS truth, b.label, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 12), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id)"
_UNIT = "(CAST('0x' || substr({h}, 1, 8) AS BIGINT) / 4294967296.0)"


def _smote_sql(starts: str) -> str:
    """Synthetic points, their first entries: from minority rows in turn towards a neighbour drawn by hash."""
    return (
        with_(
            _RARE,
            _AROUND,
            "small AS (SELECT v.* FROM v JOIN few USING (label))",
            f"start AS ({starts})",
            "turn AS (SELECT id, x, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS r, count(*) OVER () AS m FROM start)",
            "base AS (SELECT id, x, unnest(range(1, need // m + CASE WHEN r <= need % m THEN 1 ELSE 0 END + 1)) AS copy FROM turn CROSS JOIN few)",
            "near AS (SELECT a.id, b.x, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 12), b.id) AS rank, count(*) OVER (PARTITION BY a.id) AS n FROM small a JOIN small b ON a.id <> b.id)",
            "drawn AS (SELECT *, md5('42|' || CAST(id AS VARCHAR) || '#' || CAST(copy AS VARCHAR)) AS h FROM base)",
        )
        + f"SELECT 's' || CAST(d.id AS VARCHAR) || '-' || CAST(d.copy AS VARCHAR) AS id, "
        + ", ".join(f"{r(f'd.x[{i + 1}] + ' + _UNIT.format(h='md5(d.h)') + f' * (n.x[{i + 1}] - d.x[{i + 1}])')} AS c{i}" for i in range(3))
        + f" FROM drawn d JOIN near n ON n.id = d.id AND n.rank = CAST(floor({_UNIT.format(h='d.h')} * least(n.n, 5)) AS BIGINT) + 1"
    )


_DANGER = "SELECT s.id, s.x FROM small s JOIN (SELECT id, count(*) FILTER (label <> truth) AS foreign_, count(*) AS seen FROM around WHERE rank <= 10 GROUP BY id) USING (id) WHERE foreign_ * 2 > seen AND foreign_ < seen"


def _points(df: DataFrame) -> DataFrame:
    return df.filter("synthetic").select("id", *[F.col("features")[i].alias(f"c{i}") for i in range(3)])


@query("smote_points", "S18", _smote_sql("SELECT id, x FROM small"))
def _(spark, d):
    return _points(sample.smote(_rare(spark, d)))


@query("borderline_smote_points", "S19", _smote_sql(_DANGER))
def _(spark, d):
    return _points(sample.borderline_smote(_rare(spark, d)))


@query("edited_rows", "S20", with_(_RARE, _AROUND) + "SELECT id, CAST(max(truth) AS BIGINT) AS label FROM around WHERE rank <= 3 GROUP BY id HAVING count(*) FILTER (label <> truth) = 0")
def _(spark, d):
    """The editing step on its own."""
    return sample.edited(_rare(spark, d)).select("id", "label")


# -- learners -----------------------------------------------------------------------------------------
@query(
    "quadratic_covariances",
    "L8",
    with_(fx.CELLS, "c AS (SELECT x.label, x.pos AS i, y.pos AS j, covar_samp(x.v, y.v) AS v FROM cells x JOIN cells y USING (id) GROUP BY x.label, x.pos, y.pos)")
    + f"SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r('0.999 * v + CASE WHEN i = j THEN 0.001 ELSE 0 END', 4)} AS v FROM c",
    digits=4,
)
def _(spark, d):
    """The regularised class covariances whose inverses the discriminant uses."""
    model = learners.make("QDA").fit(_vec(spark, d))
    rows = [(int(c), i, j, float(v)) for c, p in zip(model.classes, model.precisions, strict=True) for i, row in enumerate(np.linalg.inv(p)) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "label int, i int, j int, v double")


def _target(spark, d) -> DataFrame:
    f = F.col("features")
    return _vec(spark, d).withColumn("label", f[0] * 3 - f[1] + f[2] * f[2] * 2)


@query("penalised_gradients", "L12", "SELECT unnest(['Linear Regression', 'Ridge', 'Lasso', 'ElasticNet']) AS learner, CAST(0.0 AS DOUBLE) AS beyond", digits=3)
def _(spark, d):
    """How far the gradient of the error leaves what each penalty allows, at the fit."""
    df = cut_lineage(_target(spark, d))
    n = df.count()
    cases = {"Linear Regression": ({}, 0.0, 0.0), "Ridge": ({"alpha": 1.0}, 0.0, 1.0 / n), "Lasso": ({"alpha": 0.01}, 0.01, 0.0), "ElasticNet": ({"alpha": 0.02, "l1": 0.5}, 0.01, 0.01)}
    out = []
    for name, (params, one, two) in cases.items():
        model = learners.make(name, "regression", **params).fit(df)
        w = np.array(model.inner.coefficients)
        scored = model.transform(df).select("features", F.array(F.col("p") - F.col("label")).alias("e"))
        slope = linalg.tiled_sum(scored, ["features", "e"], lambda c: c[0].T @ c[1], len(w), 1)[:, 0] / n + two * w
        beyond = np.where(np.abs(w) > 1e-9, np.abs(slope + one * np.sign(w)), np.maximum(np.abs(slope) - one, 0.0))
        out.append((name, float(np.round(beyond.max(), 3))))
    return spark.createDataFrame(out, "learner string, beyond double")


# -- neighbours ---------------------------------------------------------------------------------------
@query("tanimoto_nearest_packed", "K5", TANIMOTO_SQL)
def _(spark, d):
    return bitsearch.tanimoto_knn(fx.fingerprints(spark, d), 3)


@query("approximate_neighbours", "K1", "SELECT CAST(10 AS BIGINT) AS k, 10 * count(*) AS entries, true AS reached FROM embeddings")
def _(spark, d):
    """Neighbours by descent: entries found, and whether 0.95 of the exact ones are among them."""
    v = fx.vectors(spark, d).select("id", "features")
    found = cut_lineage(descent.descent_knn(v, 10))
    return descent.recall(found, neighbours.knn(v, 10)).select(F.lit(10).alias("k"), "entries", (F.col("recall") >= 0.95).alias("reached"))


# -- folds in one pass ----------------------------------------------------------------------------------
_FOLD_BAYES = with_(
    fx.VECTORS,
    "t AS (SELECT id, features, CAST(label AS DOUBLE) AS label, ntile(5) OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) - 1 AS fold FROM vectors)",
    "c AS MATERIALIZED (SELECT id, label, fold, unnest(features) AS v, unnest(range(64)) AS pos FROM t)",
    "s AS (SELECT f, label, pos, avg(v) AS mu, var_pop(v) AS var FROM c, range(5) r(f) WHERE fold <> f GROUP BY ALL)",
    "k AS (SELECT f, label, ln(count(*)) AS prior FROM t, range(5) r(f) WHERE fold <> f GROUP BY ALL)",
    "l AS (SELECT c.id, c.fold, max(c.label) AS truth, s.label, sum(-0.5 * ln(s.var) - (c.v - s.mu) ** 2 / (2 * s.var)) + max(k.prior) AS ll FROM c JOIN s ON s.pos = c.pos AND s.f = c.fold JOIN k ON k.label = s.label AND k.f = c.fold GROUP BY c.id, c.fold, s.label)",
    "p AS (SELECT id, fold, max(truth) AS label, 1 / (1 + exp(max(ll) FILTER (label = 0) - max(ll) FILTER (label = 1))) AS p FROM l GROUP BY id, fold)",
)


@query("fold_predictions", "V1 V4 L5", _FOLD_BAYES + f"SELECT id, CAST(fold AS BIGINT) AS fold, label, 'Naive Bayes' AS model, {r('p')} AS p FROM p")
def _(spark, d):
    return folds.out_of_fold(split.kfold(_vec(spark, d), 5), ["Naive Bayes"])


@query(
    "fold_scores",
    "V1 V4 M2 M6 M10",
    _FOLD_BAYES.rstrip()
    + """,
cut AS (SELECT fold, label = 1 AS y, p > 0.5 AS g, p FROM p),
tally AS (SELECT fold, count(*) FILTER (y AND g) AS tp, count(*) FILTER (NOT y AND NOT g) AS tn, count(*) FILTER (NOT y AND g) AS fp, count(*) FILTER (y AND NOT g) AS fn FROM cut GROUP BY fold),
auc AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS roc_auc FROM cut a JOIN cut b ON a.fold = b.fold AND a.y AND NOT b.y GROUP BY a.fold)
"""
    + f"SELECT 'all Naive Bayes' AS model, CAST(fold + 1 AS BIGINT) AS fold, {r('(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)')} AS accuracy, {r('2.0 * tp / (2 * tp + fp + fn)')} AS f1, {r('roc_auc')} AS roc_auc FROM tally JOIN auc USING (fold)",
)
def _(spark, d):
    return studies.cross_validate_additive({"all": _vec(spark, d)}, ["Naive Bayes"]).select("model", "fold", "accuracy", "f1", "roc_auc")


# -- stored layout --------------------------------------------------------------------------------------
@query("stored_alignment", "IO10 J1 J6", with_(fx.COMMON) + f"SELECT id, {r('balance')} AS balance, {r('n_orders')} AS n_orders, {r('n_events')} AS n_events FROM account JOIN ordering USING (id) JOIN activity USING (id)")
def _(spark, d):
    """Tables written once by id, joined bucket against bucket."""
    kept = store.store(fx.modalities(spark, d))
    f = F.col("features")
    return kept.aligned().select("id", f[0].alias("balance"), f[2].alias("n_orders"), f[5].alias("n_events"))
