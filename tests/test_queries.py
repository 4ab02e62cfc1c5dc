"""Every catalogue query: against its SQL where there is one, otherwise that it gives rows."""

import oracle
import pytest

import __spark_entry__ as entry_points
from modaweave.plans import CATALOG


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is not None])
def test_matches_sql(spark, data, con, name):
    df = CATALOG[name].run(spark, data)
    assert oracle.compare(df.collect(), df.columns, con, CATALOG[name].sql) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is None])
def test_gives_rows(spark, data, name):
    assert CATALOG[name].run(spark, data).count() > 0


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
