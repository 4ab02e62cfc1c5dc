import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from modaweave.operators import impute, scale, wide
from modaweave.operators.modality import ModalitySet
from modaweave.plans.studies import prepare

RNG = np.random.default_rng(6)


def arrays(spark, x):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")


def matrix(df):
    return np.array([[np.nan if v is None else v for v in r["features"]] for r in df.orderBy("id").collect()], dtype=float)


@pytest.fixture
def x():
    x = RNG.normal(1e6, 1, size=(57, 5))
    x[RNG.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 3.0
    return x


def test_statistics_match_numpy_however_split(spark, x):
    for parts in (1, 7):
        s = wide.position_stats(arrays(spark, x).repartition(parts))
        assert s.rows == 57 and (s.present == (~np.isnan(x)).sum(0)).all()
        assert np.allclose(s.mean, np.nanmean(x, 0)) and np.allclose(s.variance, np.nanvar(x, 0), rtol=1e-6)
        assert (s.low == np.nanmin(x, 0)).all() and (s.high == np.nanmax(x, 0)).all()


@pytest.mark.parametrize("method", wide.SCALINGS)
def test_scaling_equals_the_column_form(spark, x, method):
    df = arrays(spark, x)
    cols = df.select("id", *[F.col("features")[i].alias(f"f{i}") for i in range(5)])
    names = [f"f{i}" for i in range(5)]
    want = scale.fit(cols, names, method).transform(cols).orderBy("id").select(*names).toPandas().to_numpy(dtype=float)
    assert np.allclose(matrix(wide.fit(wide.position_stats(df), method).transform(df)), want, equal_nan=True, atol=1e-5)


def test_filling_equals_the_column_form(spark, x):
    df = arrays(spark, x)
    cols = df.select("id", *[F.col("features")[i].alias(f"f{i}") for i in range(5)])
    want = impute.impute(cols, [f"f{i}" for i in range(5)], "mean").orderBy("id").drop("id").toPandas().to_numpy(dtype=float)
    assert np.allclose(matrix(wide.mean_filler(wide.position_stats(df)).transform(df)), want)


def test_prepare_equals_the_column_form(spark, x):
    df = arrays(spark, x)
    a = df.select("id", *[F.col("features")[i].alias(f"a{i}") for i in range(3)])
    b = df.filter("id > 5").select("id", F.col("features")[3].alias("b0"), F.lit(None).cast("double").alias("b1"))
    want = prepare(ModalitySet({"a": a, "b": b}), 90.0).assemble()
    got, names = wide.WideSet.from_columns({"a": a, "b": b}).prepare(90.0)
    assert names == ["a0", "a1", "a2", "b0"]
    assert np.allclose(matrix(got), matrix(want), atol=1e-5)


def test_ten_thousand_features(spark):
    d = 10_000
    value = lambda i, k: F.when((i * 31 + k) % 11 != 0, ((i * 7919 + k * 104729) % 1009) / 1009.0)
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: value(F.col("id"), k)).alias("features"))
    began = time.time()
    sets = wide.WideSet({"one": rows, "two": rows.filter("id % 5 > 0")})
    assert {r["modality"]: r["missing"] > 0 for r in sets.missing_totals().collect()} == {"one": True, "two": True}
    out, _ = sets.prepare()
    got = matrix(out)
    assert got.shape == (48, 2 * d) and np.abs(got.mean(0)).max() < 1e-9 and np.abs(got.std(0) - 1).max() < 1e-6
    assert np.allclose(np.abs(matrix(wide.normalize_rows(out, "L1"))).sum(1), 1)
    assert time.time() - began < 60
