import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modaweave.operators import clean, entropy, groupsplit, impute, infer, learners, metrics, profile, ranking, sample, scale, split, tokens
from modaweave.operators.modality import ModalitySet
from modaweave.plans import studies
from modaweave.session import scratch_path
from modaweave.sources import readers, writers

RNG = np.random.default_rng(2)


# -- ranks and quantiles -------------------------------------------------------------------------------
def test_ranks_with_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    df = df.withColumn("v", F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") % 11))
    rows = ranking.hash_rank(df, "id", ["g"], name="r", size="n").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["r"], r["n"]))
    assert all(sorted(x for x, _ in v) == list(range(1, len(v) + 1)) and {n for _, n in v} == {len(v)} for v in by.values())
    got = ranking.ordered_rank(df, ["v", "id"], name="r").orderBy("r").select("v", "id", "r").collect()
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)
    assert [r["r"] for r in got] == list(range(1, 3001))


def test_null_group_keys_keep_their_rows(spark):
    df = spark.range(10).withColumn("g", F.when(F.col("id") > 4, "a"))
    assert ranking.hash_rank(df, "id", ["g"]).count() == 10


def test_cumulative_sum_by_group(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("x", F.lit(2))
    out = ranking.ordered_cumsum(df, ["id"], ["x"], ["g"]).collect()
    assert all(r["cum_x"] == 2 * (r["id"] // 3 + 1) for r in out)


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 10.0], [5.0] * 40 + [1.0], list(map(float, range(97))) + [3.0] * 60])
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("f", v) for v in values] + [("g", -v) for v in values], "feature string, value double")
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    for r in ranking.exact_quantiles(df, probs).collect():
        want = np.percentile(values if r["feature"] == "f" else [-v for v in values], [100 * p for p in probs])
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want)


# -- preparation -----------------------------------------------------------------------------------------
def test_interpolation_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, None), (5, 8.0), (6, None)], "id bigint, x double")
    got = [r["x"] for r in impute.impute(df, ["x"], "interpolate").orderBy("id").collect()]
    assert got == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_mode_prefers_the_smallest(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 1.0), (5, None)], "id bigint, x double")
    assert impute.fill_values(df, ["x"], "most_frequent") == {"x": 1.0}


def test_knn_fill_without_donors_uses_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 4.0), (3, None, 6.0), (4, None, None)], "id bigint, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in impute.impute(df, ["a", "b"], "knn", k=1).collect()}
    assert got[1] == (1.0, 4.0) and got[3] == (2.0, 6.0) and got[4] == (1.5, 5.0)


def test_knn_fill_from_training_rows(spark):
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, 10.0, 9.0)], "id bigint, a double, b double")
    test = spark.createDataFrame([(1, 9.0, None)], "id bigint, a double, b double")
    assert impute.knn(test, ["a", "b"], k=1, donors=train).first()["b"] == 9.0


def test_scaler_zero_spread_and_inverse(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, float("nan")), (3, 5.0, 3.0)], "id bigint, c double, x double")
    s = scale.fit(df, ["c", "x"], fill=-1.0)
    rows = s.transform(df).orderBy("id").collect()
    assert [r["c"] for r in rows] == [0, 0, 0] and [r["x"] for r in rows] == [-1.0, -1.0, 1.0]
    assert [r["x"] for r in s.inverse(s.transform(df.filter("id <> 2"))).orderBy("id").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError):
        scale.fit(df, ["c"], "unknown")


def test_power_fit_is_the_likelihood_maximum(spark):
    x = np.exp(RNG.normal(size=400))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, x double")

    def loglik(lam, kind):
        y = ((x + 1) ** lam - 1) / lam if kind == "yeo-johnson" else (x**lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.log1p(x) if kind == "yeo-johnson" else np.log(x)).sum()

    for kind in ("yeo-johnson", "box-cox"):
        got = scale.fit_power(df, ["x"], kind)["x"]
        grid = np.linspace(-3, 5, 80001)
        want = grid[np.argmax([loglik(g, kind) if abs(g) > 1e-9 else -np.inf for g in grid[::20]]) * 20]
        assert abs(got - want) < 5e-3
    z = np.array([r["x"] for r in scale.transform(df, ["x"], "powertransformer").collect()])
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9


def test_yeo_johnson_round_trip_on_both_sides(spark):
    df = spark.createDataFrame([(float(v),) for v in (-3, -0.5, 0, 0.5, 4)], "x double")
    for lam in (0.0, 0.7, 2.0, -1.0):
        y = scale.yeo_johnson(F.col("x"), lam)
        assert all(abs(r["x"] - r["b"]) < 1e-9 for r in df.select("x", scale.yeo_johnson_inverse(y, lam).alias("b")).collect())


def test_quantile_transform_matches_interpolation(spark):
    x = np.concatenate([RNG.normal(size=150), np.zeros(50)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, x double")
    got = np.array([r["x"] for r in scale.transform(df, ["x"], "quantiletransformer").orderBy("id").collect()])
    ref = np.linspace(0, 1, len(x))
    knots = np.percentile(x, ref * 100)
    want = 0.5 * (np.interp(x, knots, ref) - np.interp(-x, -knots[::-1], -ref[::-1]))
    assert np.allclose(got, want)
    normal = np.array([r["x"] for r in scale.transform(df, ["x"], "quantiletransformer", output="normal").collect()])
    assert np.isfinite(normal).all()


def test_log_of_non_positive_is_null(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double")
    for m in ("ln", "log10", "log2"):
        assert [r["x"] for r in scale.transform(df, ["x"], m).collect()] == [None, None, 0.0]


def test_sparse_cutoff():
    assert profile.sparse_cutoff(100, 100) == 1 and profile.sparse_cutoff(100, 20) == 81


def test_empty_intersection_stays_empty(spark):
    a = spark.createDataFrame([(1, 1.0)], "id bigint, x double")
    b = spark.createDataFrame([(2, 1.0)], "id bigint, y double")
    assert ModalitySet({"a": a, "b": b}).keep_common().tables["a"].count() == 0
    with pytest.raises(ValueError):
        ModalitySet({"a": a}, id_col="key")


def test_prepare_equals_the_long_way(spark):
    rows = [(i, float(i % 5) if i % 4 else None, float(i)) for i in range(40)]
    ms = ModalitySet({"a": spark.createDataFrame(rows, "id bigint, x double, y double"), "b": spark.range(5, 60).withColumn("z", F.col("id") * 1.0)})
    fast = studies.prepare(ms).assemble().orderBy("id").collect()
    slow = ms.keep_common().drop_sparse_features().impute().scale().assemble().orderBy("id").collect()
    assert [r["id"] for r in fast] == [r["id"] for r in slow]
    assert np.allclose([r["features"] for r in fast], [r["features"] for r in slow])


def test_clean_helpers(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 3.0]), (3, [float("inf"), 5.0])], "id bigint, v array<double>")
    assert [r["id"] for r in clean.drop_unclean(df, "v").collect()] == [2]
    got = {r["id"]: r["v"] for r in clean.fill_unclean_with_means(df, "v").collect()}
    assert got == {1: [1.0, 4.0], 2: [1.0, 3.0], 3: [1.0, 4.0]}


# -- splits ------------------------------------------------------------------------------------------------
def greedy(sizes, rules):
    totals = dict.fromkeys([s for s, _ in rules], 0)
    out = {}
    for g, n in sizes:
        name = next(s for s, ok in rules if ok(totals, n))
        totals[name] += n
        out[g] = name
    return out


@pytest.mark.parametrize("trial", range(2))
def test_group_splits_match_the_sequential_rule(spark, trial):
    from hashlib import md5

    rnd = random.Random(trial)
    rows, i = [], 0
    for g in range(60):
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 9, 20 if g else 150])):
            rows.append((i, g))
            i += 1
    rnd.shuffle(rows)
    rows = [(j, g) for j, (_, g) in enumerate(rows)]
    n = len(rows)
    size, first = {}, {}
    for j, g in rows:
        size[g] = size.get(g, 0) + 1
        first.setdefault(g, j)
    df = spark.createDataFrame(rows, "id bigint, grp bigint")
    key = lambda g, s: md5(f"{s}|{g}".encode()).hexdigest() + f"|{g}"
    cases = {
        "two": (groupsplit.two_way(df, "grp"), sorted(size, key=lambda g: (-size[g], first[g])), [("train", lambda t, s: t["train"] + s <= 0.8 * n), ("test", lambda t, s: True)]),
        "three": (groupsplit.three_way(df, "grp"), sorted(size, key=lambda g: (-size[g], -first[g])), [("train", lambda t, s: t["train"] + s <= 0.8 * n), ("valid", lambda t, s: t["train"] + t["valid"] + s <= 0.9 * n + 1e-9), ("test", lambda t, s: True)]),
        "random": (groupsplit.random_groups(df, "grp"), sorted(size, key=lambda g: key(g, 42)), [("valid", lambda t, s: t["valid"] + s <= int(0.1 * n)), ("test", lambda t, s: t["test"] + s <= int(0.1 * n)), ("train", lambda t, s: True)]),
        "balanced": (groupsplit.balanced_groups(df, "grp"), sorted(size, key=lambda g: ("0" if size[g] > 0.05 * n else "1") + key(g, 0)), [("train", lambda t, s: t["train"] + s <= 0.8 * n), ("valid", lambda t, s: t["valid"] + s <= 0.1 * n), ("test", lambda t, s: True)]),
    }
    for name, (out, order, rules) in cases.items():
        want = greedy([(g, size[g]) for g in order], rules)
        got = {r["grp"]: r["split"] for r in out.select("grp", "split").distinct().collect()}
        assert got == want, name
        assert out.count() == n


def test_fold_sizes_and_shares(spark):
    sizes = [r["count"] for r in split.kfold(spark.range(103), 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    inv = split.invariants(split.train_valid_test(spark.range(100))).first()
    assert (inv["rows"], inv["ids"], inv["overlap"]) == (100, 100, 0)
    with pytest.raises(ValueError):
        split.by_cuts(spark.range(3), {"a": 0.5, "b": 0.4})


# -- sampling --------------------------------------------------------------------------------------------------
def test_undersample_with_a_hot_class(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 900, 0).otherwise(1))
    assert {r["y"]: r["count"] for r in sample.undersample(df, "y").groupBy("y").count().collect()} == {0: 100, 1: 100}


def test_large_and_small_fixed_samples_agree(spark, monkeypatch):
    small = {r["id"] for r in sample.fixed_size(spark.range(500), 40).collect()}
    monkeypatch.setattr(sample, "SMALL_SAMPLE", 1)
    assert small == {r["id"] for r in sample.fixed_size(spark.range(500), 40).collect()} and len(small) == 40


def test_smote_rows_lie_between_minority_neighbours(spark):
    x = np.vstack([RNG.normal(0, 1, size=(60, 3)), RNG.normal(6, 0.5, size=(11, 3))])
    df = spark.createDataFrame([(i, r.tolist(), int(i >= 60)) for i, r in enumerate(x)], "id bigint, features array<double>, label int")
    out = sample.smote(df, k=3).collect()
    made = [np.array(r["features"]) for r in out if r["synthetic"]]
    assert len(made) == 49 and all(r["label"] == 1 for r in out if r["synthetic"])
    small = x[60:]
    for v in made:
        ok = False
        for a in small:
            for b in small:
                d = b - a
                t = (v - a) @ d / max(d @ d, 1e-12)
                ok = ok or (-1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * d, v))
        assert ok


def test_danger_and_editing(spark):
    x = [[float(i)] for i in range(20)] + [[9.4], [9.6], [50.0], [50.1], [50.2]]
    df = spark.createDataFrame([(i, v, int(i >= 20)) for i, v in enumerate(x)], "id bigint, features array<double>, label int")
    danger = {r["id"] for r in sample.danger_rows(df, m=4).collect()}
    assert danger == {20, 21}
    kept = {r["id"] for r in sample.edited(df, k=2).collect()}
    assert {22, 23, 24} <= kept and not {9, 20, 21} & kept


def test_rebalance_routes(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i % 7 == 0)) for i in range(70)], "id bigint, features array<double>, label int")
    rows, route = sample.rebalance(df)
    assert route == "class weights" and {r["weight"] for r in rows.collect()} == {1.0, 6.0}
    assert sample.rebalance(df, strategy="downsampling")[0].count() == 20


# -- metrics ------------------------------------------------------------------------------------------------------
def test_rank_scores_against_pairs(spark):
    p = RNG.integers(0, 8, 200) / 8.0
    y = (RNG.random(200) < 0.3 + 0.4 * p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, seen, hit = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        m = p == s
        hit, seen = hit + y[m].sum(), seen + m.sum()
        ap += y[m].sum() / y.sum() * hit / seen
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    with pytest.raises(ValueError):
        metrics.score(df, "unheard of")


def test_single_class_has_no_auc(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")).first()[0] is None


def test_threshold_is_strict(spark):
    c = metrics.confusion(spark.createDataFrame([(1, 0.5), (0, 0.51)], "y int, p double")).first()
    assert (c["tp"], c["tn"], c["fp"], c["fn"]) == (0, 0, 1, 1)


# -- entropy and tokens ----------------------------------------------------------------------------------------------
def test_entropy_of_a_hot_distribution(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 1, "x string")
    assert entropy.of_column(df, "x").first()["entropy"] == pytest.approx(-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)))


def test_distance_histogram_counts_every_pair(spark):
    bits = RNG.integers(0, 2, size=(90, 20))
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(bits)], "id bigint, bits array<tinyint>")
    got = {r["bin"]: r["n"] for r in entropy.distance_histogram(df, sample=90).collect()}
    assert sum(got.values()) == 90 * 89 // 2
    assert sum(r["n"] for r in entropy.distance_histogram(df, sample=30).collect()) == 30 * 29 // 2


def test_encode_both_ways(spark):
    df = spark.createDataFrame([(1, ["a", "b", "zz", "a"]), (2, []), (3, ["b"])], "id bigint, tokens array<string>")
    vocab = tokens.build_vocab(tokens.token_counts(df, "tokens").filter("token <> 'zz'"))
    a = {r["id"]: (r["token_ids"], r["length"]) for r in tokens.encode(df, "tokens", vocab).collect()}
    b = {r["id"]: (r["token_ids"], r["length"]) for r in tokens.encode(df, "tokens", vocab, broadcast_tokens=0).collect()}
    assert a == b == {1: ([2, 3, 1, 2], 4), 2: ([], 0), 3: ([3], 1)}


def test_mask_share(spark):
    df = spark.createDataFrame([(i, list(range(5, 5 + n))) for i, n in enumerate((1, 7, 40))], "id bigint, token_ids array<bigint>")
    for r, n in zip(tokens.mask_labels(df).orderBy("id").collect(), (1, 7, 40)):
        assert sum(v != 0 for v in r["labels"]) == math.ceil(0.15 * n) and len(r["labels"]) == n


def test_fingerprint_forms_agree(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["c"])], "id bigint, tokens array<string>")
    sparse = {(r["id"], r["slot"]) for r in tokens.fingerprint_slots(df, "tokens", slots=64).collect()}
    dense = {(r["id"], i) for r in df.select("id", tokens.fingerprint_bits("tokens", 2, 64).alias("b")).collect() for i, v in enumerate(r["b"]) if v}
    assert sparse == dense
    with pytest.raises(ValueError):
        tokens.generator("missing")


# -- inference, files, streams -------------------------------------------------------------------------------------------
def test_failed_batch_is_retried_by_row(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, "y")], "id bigint, text string").coalesce(1)
    good, bad = infer.good_and_rejects(infer.embed(df, "text", infer.hash_model(3)))
    assert {r["id"] for r in good.collect()} == {1, 3}
    assert [(r["id"], r["error"]) for r in bad.collect()] == [(2, "ValueError: empty input")]


def test_sink_checks_and_steps(spark):
    empty = spark.createDataFrame([], "id bigint, features array<double>")
    with pytest.raises(ValueError):
        writers.save_embeddings(empty, scratch_path(spark, "t"))
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, features array<double>")
    with pytest.raises(ValueError):
        writers.save_embeddings(uneven, scratch_path(spark, "t"))
    path, calls = scratch_path(spark, "step"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert writers.step(spark, path, build).count() == writers.step(spark, path, build).count() == 3 and len(calls) == 1


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="smiles"):
        readers.keyed(spark.range(1), ["id", "smiles"])
    with pytest.raises(ValueError, match="no id column"):
        readers.normalise_id(spark.createDataFrame([(1,)], "foo int"))


def test_in_memory_list(spark):
    rows = readers.from_list(spark, ["CCO", "C", "CCO"]).collect()
    assert [(r["id"], r["entity"]) for r in rows] == [(0, "CCO"), (1, "C"), (2, "CCO")]


def test_task_file_blanks_and_names(spark):
    path = scratch_path(spark, "tasks")
    spark.createDataFrame([("x", "1.5", ""), ("y", "", "0")], "smiles string, a string, b string").coalesce(1).write.option("header", True).csv(path)
    df, names = readers.task_file(spark, path)
    assert names == ["a", "b"] and {r["entity"]: r["targets"] for r in df.collect()} == {"x": [1.5, None], "y": [None, 0.0]}


def test_benchmark_headers(spark):
    for header in (("Drug_ID", "Drug", "Y"), ("ID", "X", "Y")):
        path = scratch_path(spark, "tab")
        spark.createDataFrame([("d1", "CCO", "1.0")], [*header]).write.option("header", True).option("sep", "\t").csv(path)
        assert readers.benchmark_file(spark, path).collect()[0].asDict() == {"id": "d1", "entity": "CCO", "y": 1.0}


def test_stream_moments_equal_batch(spark):
    from modaweave.operators.linalg import moments
    from modaweave.streaming import ingest

    x = RNG.normal(size=(90, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, features array<double>")
    path = scratch_path(spark, "src")
    df.repartition(3).write.parquet(path)
    m = ingest.accumulate_moments(ingest.file_stream(spark, path, df.schema), "features", scratch_path(spark, "state"))
    b = moments(df)
    assert m.n == b.n and np.allclose(m.raw, b.outer) and np.allclose(m.total, b.total)
    assert np.allclose(m.covariance, np.cov(x.T))


def test_learning_fractions_take_whole_rows(spark):
    df = spark.createDataFrame([(i, 1) for i in range(19)], "id bigint, y int")
    got = {r["fraction"]: r["n"] for r in split.learning_fractions(df, "y").groupBy("fraction").agg(F.count("*").alias("n")).collect()}
    assert got == {0.1: 1, 0.25: 4, 0.5: 9, 0.75: 14}


def test_rebalance_knows_its_routes(spark):
    df = spark.createDataFrame([(i, int(i == 0), [float(i)]) for i in range(60)], "id bigint, label int, features array<double>")
    rows, route = sample.rebalance(df)
    assert route == "balanced ensemble" and rows.count() == 60 and learners.for_route(route) == ["Balanced Ensemble"]
    with pytest.raises(ValueError):
        sample.rebalance(df, strategy="smoteenn")


@pytest.mark.parametrize(("kind", "shift"), [("box-cox", 0.0), ("box-cox", 100.0), ("yeo-johnson", 100.0), ("yeo-johnson", -100.0), ("yeo-johnson", -2.0)])
def test_power_exponent_is_the_likeliest(spark, kind, shift):
    x = np.random.default_rng(8).gamma(2.0, 1.0, 60) + shift + (1e-3 if not shift else 0.0)

    def score(lam):
        from decimal import Decimal, localcontext

        with localcontext() as ctx:
            ctx.prec = 140
            one, p = Decimal(1), Decimal(lam)
            t, jac = [], Decimal(0)
            for v in map(Decimal, map(float, x)):
                base, e, sign = (v, p, 1) if kind == "box-cox" else (v + 1, p, 1) if v >= 0 else (one - v, 2 - p, -1)
                t.append(sign * (base.ln() if abs(e) < Decimal("1e-20") else ((base.ln() * e).exp() - 1) / e))
                jac += sign * base.ln()
            mean = sum(t) / len(t)
            var = sum((a - mean) ** 2 for a in t) / len(t)
            return float(-Decimal(len(t)) / 2 * var.ln() + (p - 1) * jac)

    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = scale.fit_power(df, ["x"], kind)["x"]
    step = max(0.02, abs(got) * 0.002)
    assert score(got) >= max(score(got - step), score(got + step)) - 1e-9


@pytest.mark.parametrize("name", ["QDA", "AdaBoost", "MLP"])
def test_weights_change_the_fit(spark, name):
    x = RNG.normal(size=(160, 2))
    y = (x[:, 0] + 0.8 * RNG.normal(size=160) > 0).astype(int)
    df = spark.createDataFrame([(i, int(k), r.tolist(), 6.0 if k else 1.0) for i, (k, r) in enumerate(zip(y, x, strict=True))], "id bigint, label int, features array<double>, weight double")
    plain, heavy = (learners.make(name).fit(d).transform(df).agg(F.avg("p")).first()[0] for d in (df.drop("weight"), df))
    assert heavy > plain + 0.01


def test_penalised_weights_count_as_rows(spark):
    x = RNG.normal(size=(40, 2))
    rows = [(i, float(v @ [1.0, -2.0] + 0.1 * RNG.normal()), v.tolist(), float(1 + i % 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, label double, features array<double>, weight double")
    again = df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_c", "weight")
    for model in ("Ridge", "Lasso"):
        a, b = (np.array([r["p"] for r in learners.make(model, "regression", alpha=0.05).fit(d).transform(df).orderBy("id").collect()]) for d in (df, again))
        assert np.allclose(a, b, atol=1e-4)


# -- learners ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", learners.names("classification"))
def test_classifiers_separate_blobs(spark, name):
    x = np.vstack([RNG.normal(-2, 0.7, size=(40, 3)), RNG.normal(2, 0.7, size=(40, 3))])
    df = spark.createDataFrame([(i, r.tolist(), int(i >= 40)) for i, r in enumerate(x)], "id bigint, features array<double>, label int")
    small = {"Balanced Ensemble": {"size": 2, "rounds": 2}, "AdaBoost": {"rounds": 2}, "MLP": {"rounds": 30}, "Gradient Boosting": {"rounds": 3}}.get(name, {})
    scored = learners.make(name, **small).fit(df).transform(df)
    assert scored.count() == 80
    assert metrics.roc_auc(scored.select(F.col("label").alias("y"), "p")).first()[0] > 0.95


@pytest.mark.parametrize("name", ["Linear Regression", "Ridge", "K Neighbors", "AdaBoost", "Kernel Ridge"])
def test_regressors_fit_a_line(spark, name):
    x = RNG.uniform(-1, 1, size=(120, 2))
    df = spark.createDataFrame([(i, r.tolist(), float(3 * r[0] - r[1])) for i, r in enumerate(x)], "id bigint, features array<double>, label double")
    scored = learners.make(name, "regression", **({"alpha": 0.01} if "Ridge" in name else {})).fit(df).transform(df)
    assert metrics.regression_scores(scored.select(F.col("label").alias("y"), "p")).first()["r2"] > 0.8


def test_ridge_penalty_matches_the_closed_form(spark):
    x = RNG.normal(size=(50, 3))
    y = x @ np.array([1.0, 2.0, -1.0]) + 0.5
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id bigint, features array<double>, label double")
    m = learners.make("Ridge", "regression", alpha=5.0).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.inner.coefficients.toArray(), want, atol=1e-4)
    with pytest.raises(ValueError):
        learners.make("Ridge", "classification")


def test_elastic_net_meets_its_optimality_condition(spark):
    x = RNG.normal(size=(80, 3))
    y = 4 * (x @ np.array([1.0, 0.0, -1.0])) + RNG.normal(size=80)
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id bigint, features array<double>, label double")
    w = learners.make("ElasticNet", "regression", alpha=0.5, l1=0.4).fit(df).inner.coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    grad = -xc.T @ (yc - xc @ w) / 80 + 0.5 * 0.6 * w
    for g, v in zip(grad, w):
        assert abs(g + 0.2 * np.sign(v)) < 1e-3 if v else abs(g) <= 0.2 + 1e-3
