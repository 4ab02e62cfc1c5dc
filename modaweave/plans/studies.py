"""Experiment drivers: loops over folds, fusions and learners on the driver, every fit and score on
the cluster.  Each returns long result rows.

Input tables have ``id``, ``label`` and ``features``; ``tables`` maps a fused-table name such as
``pca_10`` to one of them.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import folds as fold_models
from ..operators import fuse as fusion
from ..operators import groupsplit, learners, metrics, report, sample, split
from ..operators.linalg import vector_mean
from ..operators.modality import ModalitySet
from ..operators.neighbours import knn, majority_vote, weighted_votes, with_labels
from ..session import cut_lineage

CLASS_SCORES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc", "kappa")


def _scores(scored: DataFrame, task: str) -> dict[str, Any]:
    rows = scored.select(F.col("label").alias("y"), "p")
    if task == "regression":
        return metrics.regression_scores(rows).first().asDict()
    rows = cut_lineage(rows)
    out = metrics.threshold_scores(rows, names=CLASS_SCORES).first().asDict()
    out["roc_auc"] = metrics.roc_auc(rows).first()["roc_auc"]
    return out


def _table(spark, records: Sequence[dict[str, Any]]) -> DataFrame:
    """Result records, one per fitted model, as a table (a handful of numbers each)."""
    cols = list(dict.fromkeys(c for r in records for c in r))
    kind = {c: next((type(r[c]) for r in records if r.get(c) is not None), float) for c in cols}
    ddl = {str: "string", int: "bigint", bool: "boolean"}
    schema = ", ".join(f"`{c}` {ddl.get(kind[c], 'double')}" for c in cols)
    return spark.createDataFrame([tuple(r.get(c) if r.get(c) is None or kind[c] is not float else float(r[c]) for c in cols) for r in records], schema)


def standardised(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Scale vectors by the training rows' mean and population deviation."""
    mean = vector_mean(train, "features")
    sq = train.select(F.transform(F.col("features").cast("array<double>"), lambda x: x * x).alias("s"))
    std = (vector_mean(sq, "s") - mean * mean).clip(0) ** 0.5
    std[std == 0] = 1.0
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)])
    z = F.zip_with(F.col("features").cast("array<double>"), pairs, lambda x, q: (x - q["m"]) / q["s"])
    return [d.withColumn("features", z) for d in (train, *others)]


def cross_validate(tables: Mapping[str, DataFrame], models: Sequence[str], folds: int = 5, task: str = "classification", seed: int = 42) -> DataFrame:
    """Every fused table with every learner over shuffled folds."""
    records = []
    for name, df in tables.items():
        data = cut_lineage(split.kfold(df, folds, seed=seed))
        for f in range(folds):
            train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
            for m in models:
                got = _scores(learners.make(m, task).fit(train).transform(test), task)
                kind = "linear" if name.startswith(report.LINEAR_METHODS) else "Non-linear"
                records.append({"model_type": kind, "model": f"{name} {m}", "fold": f + 1, **got})
    return _table(next(iter(tables.values())).sparkSession, records)


def cross_validate_additive(tables: Mapping[str, DataFrame], models: Sequence[str], folds: int = 5, task: str = "classification", seed: int = 42) -> DataFrame:
    """``cross_validate`` for learners that follow from sums (``folds.FITS``): one pass over a table for
    all its folds and learners, one to score it, and one grouped job for the scores."""
    out = []
    for name, df in tables.items():
        data = cut_lineage(split.kfold(df, folds, seed=seed))
        scored = cut_lineage(fold_models.out_of_fold(data, models, task).select("model", (F.col("fold") + 1).alias("fold"), F.col("label").alias("y"), "p"))
        by = ["model", "fold"]
        if task == "regression":
            got = metrics.regression_scores(scored, by)
        else:
            got = metrics.threshold_scores(scored, by, names=CLASS_SCORES).join(metrics.roc_auc(scored, by), by)
        kind = "linear" if name.startswith(report.LINEAR_METHODS) else "Non-linear"
        out.append(got.withColumn("model", F.concat(F.lit(f"{name} "), "model")).withColumn("model_type", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


def cross_validate_fusions(ms: ModalitySet, labels: DataFrame, methods: Sequence[str], k: int, models: Sequence[str], folds: int = 5, task: str = "classification", seed: int = 42) -> DataFrame:
    """Fusions fitted inside each training fold, so no test row shapes the representation."""
    wide = cut_lineage(split.kfold(_joined(ms, labels), folds, seed=seed))
    records = []
    for f, method in product(range(folds), methods):
        train, test = wide.filter(F.col("fold") != f), wide.filter(F.col("fold") == f)
        model, fused = fusion.fuse(train, list(ms.tables), method, k, "label")
        held = _apply(model, method, test, list(ms.tables))
        fused, held = cut_lineage(fused), cut_lineage(held)
        for m in models:
            got = _scores(learners.make(m, task).fit(fused).transform(held), task)
            kind = "linear" if method.startswith(report.LINEAR_METHODS) else "Non-linear"
            records.append({"model_type": kind, "model": f"{method}_{k} {m}", "fold": f + 1, **got})
    return _table(wide.sparkSession, records)


def _apply(model, method: str, df: DataFrame, names: Sequence[str]) -> DataFrame:
    if method == "cca":
        out = df
        for i, (pair, mod) in enumerate(model.items()):
            out = mod.transform(out, *pair, out=f"_pair{i}")
        parts = [f"_pair{i}" for i in range(len(model))]
        return out.withColumn("features", F.concat(*[F.col(p) for p in parts])).drop(*parts)
    if method == "integrate":
        return model.transform(df)
    if method == "tensordecompose":
        return model.transform(df, names)
    return model.transform(df.withColumn("features", F.concat(*[F.col(n).cast("array<double>") for n in names])))


def _joined(ms: ModalitySet, labels: DataFrame) -> DataFrame:
    out = labels
    for n, df in ms.tables.items():
        out = out.join(df.select("id", F.array(*[F.col(c).cast("double") for c in ms.features(n)]).alias(n)), "id")
    return out


def base_models(ms: ModalitySet, labels: DataFrame, models: Sequence[str], folds: int = 5, task: str = "classification") -> DataFrame:
    """Each modality on its own, as the comparison line."""
    wide = _joined(ms, labels)
    tables = {n: wide.select("id", "label", F.col(n).alias("features")) for n in ms.tables}
    return cross_validate(tables, models, folds, task).withColumn("model_type", F.lit("No fusion"))


def group_split_study(tables: Mapping[str, DataFrame], group: str, models: Sequence[str], task: str = "classification", kind: str = "three_way", grids: Mapping[str, Mapping[str, Sequence]] | None = None) -> DataFrame:
    """Group split, grid search on validation rows, refit, scores on train, valid and test."""
    make_split = {"three_way": groupsplit.three_way, "random": groupsplit.random_groups, "balanced": groupsplit.balanced_groups, "size": groupsplit.size_ordered}[kind]
    target = "r2" if task == "regression" else "roc_auc"
    records = []
    for name, df in tables.items():
        data = cut_lineage(make_split(df, group))
        parts = {s: data.filter(F.col("split") == s) for s in ("train", "valid", "test")}
        for m in models:
            grid = (grids or learners.GRIDS).get(m, {})
            best = None
            for values in product(*grid.values()):
                params = dict(zip(grid, values, strict=True))
                fitted = learners.make(m, task, **params).fit(parts["train"])
                got = _scores(fitted.transform(parts["valid"]), task)[target]
                if best is None or (got is not None and (best[0] is None or got > best[0])):
                    best = (got, params, fitted)
            for part, rows in parts.items():
                records.append({"model": f"{name} {m}", "data": part, "parameters": str(best[1]), **_scores(best[2].transform(rows), task)})
    return _table(next(iter(tables.values())).sparkSession, records)


def holdout_fusions(ms: ModalitySet, labels: DataFrame, methods: Sequence[str], k: int, models: Sequence[str], task: str = "classification", test: float = 0.2) -> DataFrame:
    wide = cut_lineage(split.holdout(_joined(ms, labels), test))
    train, held = wide.filter("split = 'train'"), wide.filter("split = 'test'")
    records = []
    for method in methods:
        model, fused = fusion.fuse(train, list(ms.tables), method, k, "label")
        fused, rest = cut_lineage(fused), cut_lineage(_apply(model, method, held, list(ms.tables)))
        for m in models:
            records.append({"model": f"{method}_{k} {m}", **_scores(learners.make(m, task).fit(fused).transform(rest), task)})
    return _table(wide.sparkSession, records)


def distribution_shift(long: DataFrame, group: str, models: Sequence[str], min_rows: int = 20, strategy: str = "downsampling") -> DataFrame:
    """Each task with a random and a group split: train and test scores per learner.

    ``long`` has id, task, label, features and the group column.
    """
    from ..operators.clean import population_gate

    records = []
    for t in [r["task"] for r in population_gate(long, "task", "label", min_rows).orderBy("task").collect()]:
        rows = cut_lineage(long.filter((F.col("task") == t) & F.col("label").isNotNull()).drop("task"))
        parts = {"random": split.holdout(rows, 0.2, stratify="label"), "scaffold": groupsplit.two_way(rows, group)}
        for kind, tagged in parts.items():
            tagged = cut_lineage(tagged)
            train, route = sample.rebalance(tagged.filter("split = 'train'").select("id", "label", "features"), strategy=strategy)
            train, test = standardised(cut_lineage(train), tagged.filter("split = 'test'"))
            train, test = cut_lineage(train), cut_lineage(test)
            for m in learners.for_route(route) or models:
                model = learners.make(m).fit(train)
                for part, d in (("train", train), ("test", test)):
                    records.append({"task": t, "split": kind, "model": m, "data": part, **_scores(model.transform(d), "classification")})
    return _table(long.sparkSession, records)


def _seeded_sets(df: DataFrame, folds: int, seeds: Sequence[int], fractions: Sequence[float] | None = None) -> tuple[dict[tuple, DataFrame], dict[tuple, DataFrame]]:
    """Balanced training rows per (seed, held-out fold) or (seed, fold, fraction), and test rows per (seed, fold).

    All sets are ranked together, on ids and labels alone; then each row is written once, with the numbers
    of the sets it is in.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))  # ids may repeat
    tagged = cut_lineage(split.stratified_kfold(rows.select("_row", "id", "label"), folds, "label", seeds=seeds))
    sets = tagged.withColumn("held", F.explode(F.array(*[F.lit(f) for f in range(folds)]))).filter("held <> fold")
    by, keys = ["seed", "held"], {"seed": list(seeds), "held": list(range(folds))}
    if fractions is not None:
        sets = cut_lineage(split.learning_fractions(sets, "label", fractions=fractions, by=by, seed=F.col("seed")))
        by, keys = [*by, "fraction"], {**keys, "fraction": list(fractions)}
    sets = sample.undersample(sets, "label", seed=F.col("seed"), by=by)

    def number(names: Mapping[str, str]) -> Column:
        """Place of a row's set among the products of the keys."""
        out = F.lit(0)
        for column, key in names.items():
            at = F.array_position(F.array(*[F.lit(v) for v in keys[key]]), F.col(column)) - 1
            out = out * len(keys[key]) + at
        return out.cast("int")

    train_of = sets.groupBy("_row").agg(F.collect_list(number({k: k for k in by})).alias("_train"))
    test_of = tagged.groupBy("_row").agg(F.collect_list(number({"seed": "seed", "fold": "held"})).alias("_test"))
    held = cut_lineage(rows.join(test_of, "_row").join(train_of, "_row", "left"))
    pick = lambda column, names: {key: held.filter(F.array_contains(column, i)).select(*df.columns) for i, key in enumerate(product(*(keys[k] for k in names)))}
    return pick("_train", by), pick("_test", ["seed", "held"])


def _scored_together(scored: Sequence[DataFrame]) -> list[dict[str, Any]]:
    """``_scores`` of many written (y, p) tables of a classification, in one grouped job each."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_k", F.lit(k)) for k, s in enumerate(scored)])
    both = metrics.threshold_scores(rows, ["_k"], names=CLASS_SCORES).join(metrics.roc_auc(rows, ["_k"]), "_k")
    got = {r["_k"]: {c: v for c, v in r.asDict().items() if c != "_k"} for r in both.collect()}
    return [got[k] if k in got else _scores(s.withColumnRenamed("y", "label"), "classification") for k, s in enumerate(scored)]


def low_data_curves(df: DataFrame, models: Sequence[str], seeds: Sequence[int] = (42, 123, 456), folds: int = 5, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75)) -> DataFrame:
    """Scores per learner, seed, fold and share of the training rows; ``seconds`` are those of the fit and of
    the predictions."""
    train, test = _seeded_sets(df, folds, seeds, fractions)
    records, scored = [], []
    for s, f, frac, m in product(seeds, range(folds), fractions, models):
        began = time.time()
        fitted = learners.make(m).fit(cut_lineage(train[s, f, frac]))
        scored.append(cut_lineage(fitted.transform(test[s, f]).select(F.col("label").alias("y"), "p")))
        records.append({"model": m, "seed": s, "fold": f + 1, "fraction": frac, "seconds": time.time() - began})
    names = ("model", "seed", "fold", "fraction", "roc_auc", "balanced_accuracy", "seconds")
    both = [{**r, **got} for r, got in zip(records, _scored_together(scored), strict=True)]
    return _table(df.sparkSession, [{c: r[c] for c in names} for r in both])


def descriptor_benchmark(tables: Mapping[str, DataFrame], models: Sequence[str], seeds: Sequence[int] = (42, 123, 456), folds: int = 5, done: DataFrame | None = None) -> DataFrame:
    """Stratified folds x seeds per descriptor with under-sampled, scaled training rows.

    ``done`` holds finished (descriptor, seed, fold) records to leave out.
    """
    finished = set() if done is None else {tuple(r) for r in done.select("descriptor", "seed", "fold").distinct().collect()}
    records, scored = [], []
    for name, df in tables.items():
        todo = [(s, f) for s, f in product(seeds, range(folds)) if (name, s, f + 1) not in finished]
        if not todo:
            continue
        train_sets, test_sets = _seeded_sets(df, folds, seeds)
        for s, f in todo:
            train, test = standardised(cut_lineage(train_sets[s, f]), test_sets[s, f])
            train, test = cut_lineage(train), cut_lineage(test)
            sizes = {"train_size": train.count(), "test_size": test.count()}
            for m in models:
                began = time.time()
                fitted = learners.make(m).fit(train)
                scored.append(cut_lineage(fitted.transform(test).select(F.col("label").alias("y"), "p")))
                records.append({"descriptor": name, "model": m, "seed": s, "fold": f + 1, **sizes, "seconds": time.time() - began})
    both = [{**r, **got} for r, got in zip(records, _scored_together(scored) if scored else [], strict=True)]
    return _table(next(iter(tables.values())).sparkSession, both)


def classification_benchmark(tables: Mapping[str, DataFrame], labels: DataFrame, models: Sequence[str], strategy: str | None = None) -> DataFrame:
    """Common ids over all descriptors, one stratified hold-out for all, balanced and scaled."""
    from ..operators.joins import common_ids

    ids = cut_lineage(common_ids([labels, *tables.values()]))
    tagged = cut_lineage(split.holdout(labels.join(ids, "id", "left_semi"), 0.2, stratify="label"))
    records = []
    for name, df in tables.items():
        data = cut_lineage(tagged.join(df, "id"))
        train, route = sample.rebalance(data.filter("split = 'train'").select("id", "label", "features"), strategy=strategy)
        train, test = standardised(cut_lineage(train), data.filter("split = 'test'"))
        for m in learners.for_route(route) or models:
            got = _scores(learners.make(m).fit(train).transform(test), "classification")
            records.append({"descriptor": name, "model": m, "strategy": route, **got})
    return _table(labels.sparkSession, records)


def regression_benchmark(tables: Mapping[str, DataFrame], labels: DataFrame, models: Sequence[str], transform: str | None = None) -> DataFrame:
    """Hold-out regression; the target may be fitted on a log or power scale and is scored on its own."""
    from ..operators.scale import fit_power, yeo_johnson, yeo_johnson_inverse

    tagged = cut_lineage(split.holdout(labels, 0.2))
    records = []
    for name, df in tables.items():
        data = cut_lineage(tagged.join(df, "id"))
        train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
        forward, back = (lambda c: c), (lambda c: c)
        if transform == "log":
            forward, back = F.log1p, F.expm1
        elif transform == "power":
            lam = fit_power(train, ["label"])["label"]
            forward, back = (lambda c: yeo_johnson(c, lam)), (lambda c: yeo_johnson_inverse(c, lam))
        fit_rows = cut_lineage(train.withColumn("label", forward(F.col("label").cast("double"))))
        fit_rows, test = standardised(fit_rows, test)
        for m in models:
            scored = learners.make(m, "regression").fit(fit_rows).transform(test)
            records.append({"descriptor": name, "model": m, **_scores(scored.withColumn("p", back(F.col("p"))), "regression")})
    return _table(labels.sparkSession, records)


def similarity_study(df: DataFrame, k: int = 20, vote: int = 5) -> dict[str, DataFrame]:
    """Leave-one-out neighbour votes: scores at ``vote`` neighbours, weighted scores for every k."""
    near = cut_lineage(with_labels(knn(df, k), df))
    votes = majority_vote(near, vote).select(F.col("truth").alias("y"), F.col("positive_share").alias("p"))
    weighted = cut_lineage(weighted_votes(near))
    rows = weighted.select("k", F.col("truth").alias("y"), F.col("score").alias("p"))
    # The weighted vote calls a tie positive, so its class comes from the prediction column.
    hard = weighted.select("k", F.col("truth").alias("y"), F.col("predicted").alias("p"))
    per_k = reduce(
        lambda a, b: a.join(b, "k"),
        [
            metrics.roc_auc(rows, ["k"]),
            metrics.average_precision(rows, ["k"]),
            metrics.threshold_scores(hard, ["k"], ["accuracy", "balanced_accuracy", "f1"]).drop("tp", "tn", "fp", "fn"),
        ],
    )
    base = metrics.threshold_scores(votes, names=["accuracy", "balanced_accuracy", "f1", "mcc"])
    auc = metrics.roc_auc(votes)
    return {"neighbours": near, "votes": base.withColumn("roc_auc", auc.scalar()), "weighted": per_k}


def best_model(results: DataFrame, score: str) -> DataFrame:
    """Name of the model with the best mean score."""
    means = results.groupBy("model").agg(F.avg(score).alias("_s"))
    return means.agg(F.max_by("model", F.struct("_s", "model")).alias("model"))


def predict_with_best(results: DataFrame, score: str, train: Mapping[str, DataFrame], new: Mapping[str, DataFrame], task: str = "classification") -> DataFrame:
    """Refit the best (table, learner) of a result table and score new rows with it."""
    table, learner = best_model(results, score).first()["model"].split(" ", 1)
    return learners.make(learner, task).fit(train[table]).transform(new[table]).select("id", "p")


def ensemble_predict(models: Sequence[learners.Model], df: DataFrame, inputs: DataFrame) -> DataFrame:
    """Mean over several fitted models, back on every input row (null where none was scored)."""
    parts = [m.transform(df).select("id", "p") for m in models]
    stacked = reduce(DataFrame.unionByName, parts)
    return inputs.join(metrics.ensemble_mean(stacked, ["id"]), "id", "left")


def prepare(ms: ModalitySet, threshold: float = 100.0, impute: str = "mean", scale: str = "standardize") -> ModalitySet:
    """Common ids, sparse features out, filled, scaled: the path in front of every fusion.

    With mean filling and standardising one aggregate per modality gives everything: filling with the mean leaves the mean alone and shrinks the variance
    by the share of present values.
    """
    kept = ms.keep_common()
    if (impute, scale) == ("mean", "standardize"):
        # The modalities' statistics are separate jobs, so they may share the cluster.
        with ThreadPoolExecutor(max_workers=4) as pool:
            jobs = {n: pool.submit(_mean_fill_standardise, t, ms.features(n), ms.id_col, threshold) for n, t in kept.tables.items()}
            return ModalitySet({n: j.result() for n, j in jobs.items()}, ms.id_col, kept.labels)
    return kept.drop_sparse_features(threshold).impute(impute).scale(scale)


def _mean_fill_standardise(df: DataFrame, features: Sequence[str], id_col: str, threshold: float) -> DataFrame:
    return df.select(id_col, *_mean_std_columns(df, features, threshold))


def _mean_std_columns(fit_on: DataFrame, features: Sequence[str], threshold: float = 100.0) -> list:
    """Fill-and-standardise expressions for the features dense enough in ``fit_on``."""
    from ..operators.profile import absent, sparse_cutoff

    seen = {f: F.when(~absent(fit_on, f), F.col(f).cast("double")) for f in features}
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(features):
        aggs += [F.count(seen[f]).alias(f"c{i}"), F.avg(seen[f]).alias(f"m{i}"), F.var_pop(seen[f]).alias(f"v{i}")]
    row = fit_on.agg(*aggs).first()
    need = sparse_cutoff(row["n"], threshold)
    cols = []
    for i, f in enumerate(features):
        if row[f"c{i}"] >= need:
            sd = (row[f"v{i}"] * row[f"c{i}"] / row["n"]) ** 0.5 or 1.0
            cols.append(((F.coalesce(seen[f], F.lit(row[f"m{i}"])) - F.lit(row[f"m{i}"])) / F.lit(sd)).alias(f))
    return cols


def prepared_train_test(ms: ModalitySet, split_table: DataFrame) -> tuple[ModalitySet, ModalitySet]:
    """Fill and scale with statistics of the training rows only.

    Each aligned modality is written once, then read for its statistics and for both outputs.
    """
    train, test = {}, {}
    for n, df in split.apply_split(ms.tables, split_table, ms.id_col).items():
        df = cut_lineage(df)
        cols = _mean_std_columns(df.filter("split = 'train'"), ms.features(n))
        train[n] = df.filter("split = 'train'").select(ms.id_col, *cols)
        test[n] = df.filter("split <> 'train'").select(ms.id_col, *cols)
    return ModalitySet(train, ms.id_col, ms.labels), ModalitySet(test, ms.id_col, ms.labels)
