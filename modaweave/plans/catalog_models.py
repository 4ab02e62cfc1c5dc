"""Queries for fusion, learners and experiment drivers.

Fits run over whole tables.  Where SQL can state the result it is checked; otherwise the table of
scores is checked for rows and the operator against numpy in the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fuse, learners, linalg, neighbours, split
from ..operators.modality import ModalitySet
from ..session import cut_lineage
from . import fixtures as fx
from . import studies
from .registry import query, r, with_


def _wide(df, vec="features", n=4, prefix="c"):
    return df.select("id", *[F.col(vec)[i].alias(f"{prefix}{i}") for i in range(n)])


def _vec(spark, d):
    return fx.vectors(spark, d).select("id", "label", "features")


def _target(spark, d):
    """A smooth target for regression: a fixed blend of the first positions."""
    f = F.col("features")
    return _vec(spark, d).withColumn("label", f[0] * 3 - f[1] + f[2] * f[2] * 2)


def _set(spark, d) -> tuple[ModalitySet, DataFrame]:
    v = fx.vector_modalities(spark, d)
    sizes = {"a": 24, "b": 20, "c": 20}
    tables = {n: v.select("id", *[F.col(n)[i].alias(f"{n}{i}") for i in range(k)]) for n, k in sizes.items()}
    return ModalitySet(tables), v.select("id", "label")


# -- fusion ------------------------------------------------------------------------------------------------------
@query("fusion_dispatch", "F0 F14", " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS rows, CAST(4 AS BIGINT) AS width FROM embeddings" for m in ("pca", "rks", "plsda", "integrate")))
def _(spark, d):
    v = cut_lineage(fx.vector_modalities(spark, d))
    out = [fuse.fuse(v, ["a", "b", "c"], m, 4, "label")[1].agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width")).select(F.lit(m).alias("method"), "rows", "width") for m in ("pca", "rks", "plsda", "integrate")]
    return reduce(DataFrame.unionByName, out)


@query("pca", "F1")
def _(spark, d):
    v = _vec(spark, d)
    return _wide(fuse.pca(v, 4).transform(v))


@query("pca_explained", "F1")
def _(spark, d):
    m = fuse.pca(_vec(spark, d), 8)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(m.explained)], "component int, variance double")


@query("gramian_moments", "F1 F2", with_(fx.CELLS) + f"SELECT x.pos AS i, y.pos AS j, {r('sum(x.v * y.v)', 4)} AS v FROM cells x JOIN cells y USING (id) GROUP BY 1, 2", digits=4)
def _(spark, d):
    m = linalg.moments(_vec(spark, d))
    rows = [(i, j, float(m.outer[i, j])) for i in range(64) for j in range(64)]
    return spark.createDataFrame(rows, "i int, j int, v double")


@query("incremental_pca", "F2")
def _(spark, d):
    v = cut_lineage(split.kfold(_vec(spark, d), 4))
    model = fuse.incremental_pca([v.filter(F.col("fold") == i) for i in range(4)], 4)
    return _wide(model.transform(v))


@query("ica", "F3")
def _(spark, d):
    v = cut_lineage(_vec(spark, d))
    return _wide(fuse.ica(v, 4).transform(v))


@query("cca_pair", "F4")
def _(spark, d):
    v = fx.vector_modalities(spark, d)
    return _wide(fuse.cca(v, "a", "b", 3).transform(v, "a", "b"), n=6)


@query("plsda", "F5")
def _(spark, d):
    v = _vec(spark, d)
    return _wide(fuse.pls(v, "label", 4).transform(v))


@query("kernel_pca", "F6")
def _(spark, d):
    v = _vec(spark, d)
    return _wide(fuse.kernel_pca(v, 4).transform(v))


@query("random_kernel_features", "F7")
def _(spark, d):
    return _wide(fuse.random_features(64, 8).transform(_vec(spark, d)))


@query("spectral_embedding", "F8")
def _(spark, d):
    near = neighbours.edges(neighbours.knn(_vec(spark, d), 8))
    return _wide(fuse.spectral_embedding(cut_lineage(near), 3, rounds=9), n=3)


@query("tensor_fusion", "F9")
def _(spark, d):
    v = cut_lineage(fuse.top_features(fx.vector_modalities(spark, d), ["a", "b", "c"], "label", 20))
    return _wide(fuse.tensor_fusion(v, ["a", "b", "c"], 4).transform(v, ["a", "b", "c"]))


@query(
    "select_k_best",
    "F10",
    with_(fx.CELLS, "c AS (SELECT pos, corr(v, label) AS rho, count(*) AS n FROM cells GROUP BY pos)", "f AS (SELECT pos, rho * rho / (1 - rho * rho) * (n - 2) AS f FROM c)")
    + f"SELECT pos, {r('f', 4)} AS f_score, row_number() OVER (ORDER BY f DESC, pos) AS rank FROM f QUALIFY rank <= 10",
    digits=4,
)
def _(spark, d):
    return fuse.select_k_best(_vec(spark, d), "label", 10)


@query("cross_modal_integration", "F11")
def _(spark, d):
    v = fx.vector_modalities(spark, d)
    return _wide(fuse.integrate(v, ["a", "b", "c"], 4).transform(v))


@query(
    "reconstruction_losses",
    "F12",
    with_(fx.CELLS, "m AS (SELECT pos, avg(v) AS mu FROM cells GROUP BY pos)", "x AS (SELECT id, pos, v, mu FROM cells JOIN m USING (pos) WHERE pos < 64)", "l AS (SELECT pos // 32 AS part, avg((v - mu) ** 2) AS e FROM x GROUP BY 1)")
    + f"SELECT {r('max(CASE WHEN part = 0 THEN e END)')} AS encoding_loss_a, {r('max(CASE WHEN part = 1 THEN e END)')} AS encoding_loss_b, {r('sum(e)')} AS total_encoding_loss, {r('sum(e)')} AS total_reconstruction_loss, {r('0.33 * sum(e) / 2 + 0.33 * sum(e) / 2')} AS total_loss FROM l",
)
def _(spark, d):
    # The column mean stands in for the encoder, so every part of the loss has a closed form.
    v = fx.vectors(spark, d).select("id", F.slice("features", 1, 32).alias("a"), F.slice("features", 33, 32).alias("b"))
    for n in ("a", "b"):
        mean = linalg.vector_mean(v, n)
        v = v.withColumn(f"enc_{n}", F.array(*[F.lit(float(x)) for x in mean]))
    v = v.withColumn("key", F.concat("enc_a", "enc_b"))
    out = fuse.reconstruction_losses(v, ["a", "b"], {"a": "enc_b", "b": "enc_a"}, ("key", "key"))
    return out.select("encoding_loss_a", "encoding_loss_b", "total_encoding_loss", "total_reconstruction_loss", "total_loss")


@query("recompressed_widths", "F13", " UNION ALL ".join(f"SELECT count(*) AS rows, CAST({k} AS BIGINT) AS width, CAST({k} AS BIGINT) AS k FROM embeddings" for k in (2, 4, 8, 16)))
def _(spark, d):
    v = cut_lineage(fx.vector_modalities(spark, d))
    models = fuse.recompress(fuse.integrate(v, ["a", "b", "c"], 16), [2, 4, 8, 16])
    rows = [m.transform(v).agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width")).withColumn("k", F.lit(k)) for k, m in models.items()]
    return reduce(DataFrame.unionByName, rows)


@query("standardised_fusion", "F14")
def _(spark, d):
    v = _vec(spark, d)
    fused = cut_lineage(fuse.pca(v, 4).transform(v))
    out = studies.standardised(fused)[0]
    return out.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query("text_to_embedding_map", "F15 K12 M13")
def _(spark, d):
    from ..operators.tokens import fingerprint_bits, words

    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), fingerprint_bits(words("text"), 1, 64).cast("array<double>").alias("x"))
    rows = cut_lineage(docs.join(fx.vectors(spark, d).select("id", "features"), "id"))
    return fuse.score_mapping(rows, fuse.map_to_embedding(rows, "x", "features"), "x", "features")


# -- learners ------------------------------------------------------------------------------------------------------------
_LEARNERS = (
    ("logistic_regression", "L1", "Logistic Regression", "classification"),
    ("decision_tree", "L2", "Decision Tree", "classification"),
    ("decision_tree_regression", "L2", "Decision Tree", "regression"),
    ("random_forest", "L3", "Random Forest", "classification"),
    ("random_forest_regression", "L3", "Random Forest", "regression"),
    ("support_vector_machine", "L4", "Support Vector Machine", "classification"),
    ("naive_bayes", "L5", "Naive Bayes", "classification"),
    ("k_neighbours", "L6", "KNN", "classification"),
    ("k_neighbours_regression", "L6", "K Neighbors", "regression"),
    ("multilayer_perceptron", "L7", "MLP", "classification"),
    ("quadratic_discriminant", "L8", "QDA", "classification"),
    ("ada_boost", "L9", "AdaBoost", "classification"),
    ("ada_boost_regression", "L9", "AdaBoost", "regression"),
    ("extra_trees", "L10", "Extra Trees", "classification"),
    ("extra_trees_regression", "L10", "Extra Trees", "regression"),
    ("gradient_boosting", "L11", "XGBoost", "classification"),
    ("gradient_boosting_regression", "L11", "Gradient Boosting", "regression"),
    ("linear_regression", "L12", "Linear Regression", "regression"),
    ("ridge", "L12", "Ridge", "regression"),
    ("lasso", "L12", "Lasso", "regression"),
    ("elastic_net", "L12", "ElasticNet", "regression"),
    ("kernel_ridge", "L13", "Kernel Ridge", "regression"),
    ("balanced_ensemble", "L14", "Balanced Ensemble", "classification"),
    ("robust_regression", "L15", "Support Vector Machine", "regression"),
)
_SMALL = {"Lasso": {"alpha": 0.01}, "ElasticNet": {"alpha": 0.01}}



def _knn_sql(target, metric, k, weight):
    """Neighbour learners can be stated in SQL: all pairs of the two split parts."""
    return (
        with_(
            fx.VECTORS,
            f"t AS (SELECT id, features, {target} AS label, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) <= floor(round(0.75 * count(*) OVER (), 6)) AS train FROM vectors)",
            f"p AS (SELECT q.id, q.label AS truth, n.id AS nid, n.label, {metric} AS dist FROM t q JOIN t n ON NOT q.train AND n.train)",
            f"k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), nid) AS rk FROM p QUALIFY rk <= {k})",
        )
        + f"SELECT id, {r('max(truth)')} AS label, {r(f'sum(({weight}) * label) / sum({weight})')} AS p FROM k GROUP BY id"
    )


_BAYES = (
    with_(
        fx.VECTORS,
        "t AS (SELECT id, features, CAST(label AS DOUBLE) AS label, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) <= floor(round(0.75 * count(*) OVER (), 6)) AS train FROM vectors)",
        "c AS (SELECT id, label, train, unnest(features) AS v, unnest(range(64)) AS pos FROM t)",
        "s AS (SELECT label, pos, avg(v) AS mu, var_pop(v) AS var FROM c WHERE train GROUP BY ALL)",
        "k AS (SELECT label, ln(count(*)) AS prior FROM t WHERE train GROUP BY label)",
        "l AS (SELECT c.id, max(c.label) AS truth, s.label, sum(-0.5 * ln(s.var) - (c.v - s.mu) ** 2 / (2 * s.var)) + max(k.prior) AS ll FROM c JOIN s ON s.pos = c.pos JOIN k ON k.label = s.label WHERE NOT c.train GROUP BY c.id, s.label)",
        "p AS (SELECT id, max(truth) AS label, max(ll) FILTER (label = 0) - max(ll) FILTER (label = 1) AS gap FROM l GROUP BY id)",
    )
    + f"SELECT id, {r('label')} AS label, {r('1 / (1 + exp(gap))')} AS p FROM p"
)

_GAPS = "list_transform(list_zip(q.features, n.features), lambda z: abs(z[1] - z[2]) ** {p})"
_CHECKED = {
    "naive_bayes": _BAYES,
    "k_neighbours": _knn_sql("CAST(label AS DOUBLE)", f"list_sum({_GAPS.format(p=3)}) ** (1.0 / 3)", 11, "1.0 / (dist + 1e-8)"),
    "k_neighbours_regression": _knn_sql("features[1] * 3 - features[2] + features[3] * features[3] * 2", f"sqrt(list_sum({_GAPS.format(p=2)}))", 5, "1.0"),
}

for _name, _row, _learner, _task in _LEARNERS:

    @query(f"learner_{_name}", _row, _CHECKED.get(_name))
    def _(spark, d, learner=_learner, task=_task):
        data = cut_lineage(split.holdout(_vec(spark, d) if task == "classification" else _target(spark, d), 0.25))
        train, test = data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")
        model = learners.make(learner, task, **_SMALL.get(learner, {})).fit(train)
        return model.transform(test).select("id", F.col("label").cast("double").alias("label"), "p")


# -- drivers ----------------------------------------------------------------------------------------------------------------
@query("study_cross_validation", "V1")
def _(spark, d):
    ms, labels = _set(spark, d)
    return studies.cross_validate_fusions(ms, labels, ["pca", "plsda"], 4, ["Logistic Regression"], folds=5)


@query("study_group_split", "V2")
def _(spark, d):
    df = fx.grouped_vectors(spark, d).select("id", "label", "features", "grp")
    return studies.group_split_study({"raw_64": df}, "grp", ["Decision Tree"], grids={"Decision Tree": {"max_depth": [2, 4]}}, kind="balanced")


@query("study_holdout_fusions", "V3")
def _(spark, d):
    ms, labels = _set(spark, d)
    return studies.holdout_fusions(ms, labels, ["pca", "integrate"], 4, ["Naive Bayes"])


@query("study_base_models", "V4")
def _(spark, d):
    ms, labels = _set(spark, d)
    return studies.base_models(ms, labels, ["Naive Bayes"], folds=5)


@query("study_distribution_shift", "V5")
def _(spark, d):
    v = fx.grouped_vectors(spark, d)
    wide = v.select("id", "features", "grp", F.col("label").alias("low"), (F.col("cls") % 2).alias("odd"))
    long = wide.unpivot(["id", "features", "grp"], ["low", "odd"], "task", "label")
    return studies.distribution_shift(long, "grp", ["Naive Bayes"])


@query("study_low_data", "V6")
def _(spark, d):
    return studies.low_data_curves(_vec(spark, d), ["Naive Bayes"]).drop("seconds")


@query("study_descriptor_benchmark", "V7")
def _(spark, d):
    v = cut_lineage(fx.vector_modalities(spark, d))
    tables = {n: v.select("id", "label", F.col(n).alias("features")) for n in ("a", "b")}
    return studies.descriptor_benchmark(tables, ["Naive Bayes"]).drop("seconds")


@query("study_classification", "V8")
def _(spark, d):
    v = cut_lineage(fx.vector_modalities(spark, d))
    tables = {n: v.select("id", F.col(n).alias("features")) for n in ("a", "b")}
    return studies.classification_benchmark(tables, v.select("id", "label"), ["Naive Bayes"], strategy="downsampling")


@query("study_regression", "V9")
def _(spark, d):
    v = cut_lineage(_target(spark, d))
    out = [studies.regression_benchmark({"all": v.select("id", "features")}, v.select("id", (F.col("label") + 3).alias("label")), ["Ridge"], t).withColumn("transform", F.lit(t or "none")) for t in (None, "log", "power")]
    return reduce(DataFrame.unionByName, out)


@query("predict_with_best", "V11")
def _(spark, d):
    data = cut_lineage(split.holdout(_vec(spark, d), 0.25))
    train, new = data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")
    results = studies.cross_validate({"raw": train}, ["Naive Bayes", "Logistic Regression"])
    return studies.predict_with_best(results, "roc_auc", {"raw": train}, {"raw": new})


@query("ensemble_predict", "V12")
def _(spark, d):
    data = cut_lineage(split.holdout(_vec(spark, d), 0.25))
    train, new = data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")
    models = [learners.make(n).fit(train) for n in ("Naive Bayes", "Logistic Regression")]
    return studies.ensemble_predict(models, new, data.select("id"))


@query("train_test_preparation", "V13 N15", with_(fx.COMMON, "n AS (SELECT count(*) AS n, CAST(floor(round(0.8 * count(*), 6)) AS BIGINT) AS cut FROM common)") + "SELECT 'train' AS part, cut AS rows, CAST(8 AS BIGINT) AS width FROM n UNION ALL SELECT 'test', n - cut, 8 FROM n")
def _(spark, d):
    ms = fx.modalities(spark, d)
    tr, te = studies.prepared_train_test(ms, split.holdout(ms.common_ids()))
    rows = [s.assemble().agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width")).withColumn("part", F.lit(n)) for n, s in (("train", tr), ("test", te))]
    return rows[0].unionByName(rows[1])
