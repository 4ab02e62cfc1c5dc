"""Modality tables laid out by id: aligned without an exchange, results as without the store."""

import pytest

from modaweave.operators.modality import ModalitySet
from modaweave.sources.store import store


@pytest.fixture(scope="module")
def kept(spark):
    rows = [[(i, float(i * k), None if i % 7 == 0 else float(k)) for i in range(lo, hi)] for k, (lo, hi) in enumerate(((0, 90), (20, 120), (10, 100)), 1)]
    tables = {n: spark.createDataFrame(r, f"id long, {n}0 double, {n}1 double") for n, r in zip("abc", rows, strict=True)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 80)], "id long, label int")
    ms = ModalitySet(tables, labels=labels)
    s = store(ms, buckets=4)
    yield ms, s
    s.drop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_has_no_exchange(spark, kept):
    ms, s = kept
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (s.aligned(), s.open().leave_one_out()["a"], s.common_ids()):
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        assert "Exchange" in plan(ms.assemble())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stored_rows_are_the_same(kept):
    ms, s = kept
    assert sorted(map(tuple, s.aligned().collect()), key=str) == sorted(map(tuple, ms.assemble().collect()), key=str)
    assert sorted(r.id for r in s.common_ids().collect()) == sorted(r.id for r in ms.common_ids().collect()) == list(range(20, 80))
    for n in "abc":
        assert sorted(map(tuple, s.open().tables[n].collect()), key=str) == sorted(map(tuple, ms.tables[n].collect()), key=str)


def test_empty_and_repeated_ids(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id long, x double")
    s = store(ModalitySet({"a": a, "b": a.limit(0)}), buckets=2)
    assert s.aligned().count() == 0 and s.common_ids().count() == 0 and s.open().tables["a"].count() == 3
    s.drop()
