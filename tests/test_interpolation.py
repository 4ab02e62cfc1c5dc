"""Interpolation bridges gaps in one pass over each range of rows."""

import re

from pyspark.sql import functions as F

from modaweave.operators import impute


def test_no_frame_is_open_ahead(spark):
    """A frame up to the last row is summed up anew for every row: its time is quadratic."""
    df = spark.range(50).select("id", F.when(F.col("id") % 7 == 3, F.col("id") * 2.0).alias("x"))
    plan = impute.interpolate(df, ["x"], "id")._jdf.queryExecution().toString().lower()
    assert not re.search(r"unboundedfollowing|unbounded following", plan)


def test_gaps_over_both_ends(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, None), (4, None), (5, 10.0), (6, None)], "id bigint, x double")
    got = {r["id"]: r["x"] for r in impute.interpolate(df, ["x"], "id").collect()}
    assert got == {1: None, 2: 4.0, 3: 6.0, 4: 8.0, 5: 10.0, 6: 10.0}
