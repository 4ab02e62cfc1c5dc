"""Filling missing values; statistics come from one pass, the fill itself is an expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import broadcast_small
from .ranking import exact_quantiles, ordered_rank, to_long

METHODS = ("mean", "median", "most_frequent", "interpolate", "knn")


def _clean(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def fill_values(df: DataFrame, features: Sequence[str], method: str) -> dict[str, float | None]:
    """The value each column is filled with (one number per feature)."""
    if method == "mean":
        return df.agg(*[F.avg(_clean(f)).alias(f) for f in features]).first().asDict()
    long = to_long(df.select(*[_clean(f).alias(f) for f in features], F.lit(0).alias("_k")), ["_k"], features)
    long = long.filter("value is not null")
    if method == "median":
        rows = exact_quantiles(long, [0.5]).collect()
        return {r["feature"]: r["q0"] for r in rows}
    if method == "most_frequent":
        counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("feature").agg(F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("m"))
        return {r["feature"]: -r["m"]["neg"] for r in best.collect()}
    raise ValueError(f"no such fill statistic: {method}")


def fill_with(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({f: F.coalesce(_clean(f), F.lit(v).cast("double")) for f, v in values.items()})


def interpolate(df: DataFrame, features: Sequence[str], order: str) -> DataFrame:
    """Linear by row position in ``order``: leading gaps stay null, trailing gaps repeat the last
    value.  Rows are ranked over the cluster; gaps are bridged inside ranges of rows and carried
    across range borders with one row per range."""
    ranked = ordered_rank(df, [order], name="_rn").withColumn("_blk", F.floor(F.col("_rn") / F.lit(100_000)))
    known = {f: F.when(_clean(f).isNotNull(), F.struct(F.col("_rn").alias("p"), _clean(f).alias("v"))) for f in features}
    ranked = ranked.withColumns({f"_k_{f}": c for f, c in known.items()})
    edges = ranked.groupBy("_blk").agg(
        *[F.max(f"_k_{f}").alias(f"_hi_{f}") for f in features], *[F.min(f"_k_{f}").alias(f"_lo_{f}") for f in features]
    )
    back = W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    # What follows is read as what comes before in falling order: a frame that is open ahead is summed
    # up anew for every row, so its time grows with the square of the range.
    ahead = W.orderBy(F.desc("_blk")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        "_blk",
        *[F.last(f"_hi_{f}", True).over(back).alias(f"_pb_{f}") for f in features],
        *[F.last(f"_lo_{f}", True).over(ahead).alias(f"_nb_{f}") for f in features],
    )
    before = W.partitionBy("_blk").orderBy("_rn").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("_blk").orderBy(F.desc("_rn")).rowsBetween(W.unboundedPreceding, 0)
    out = ranked.join(broadcast_small(edges), "_blk")
    fills = {}
    for f in features:
        prev = F.coalesce(F.last(f"_k_{f}", True).over(before), F.col(f"_pb_{f}"))
        nxt = F.coalesce(F.last(f"_k_{f}", True).over(after), F.col(f"_nb_{f}"))
        out = out.withColumn(f"_p_{f}", prev).withColumn(f"_n_{f}", nxt)
        p, n = F.col(f"_p_{f}"), F.col(f"_n_{f}")
        slope = F.try_divide(n["v"] - p["v"], (n["p"] - p["p"]).cast("double"))
        fills[f] = (
            F.when(_clean(f).isNotNull(), _clean(f))
            .when(p.isNull(), F.lit(None).cast("double"))
            .when(n.isNull(), p["v"])
            .otherwise(p["v"] + slope * (F.col("_rn") - p["p"]))
        )
    return out.withColumns(fills).select(*df.columns)


def knn(df: DataFrame, features: Sequence[str], id_col: str = "id", k: int = 5, donors: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Mean of the ``k`` nearest donors that have the feature; NaN-aware Euclidean distance.

    Without any donor the column mean (within the group) fills.  ``donors`` defaults to the table
    itself; pass the training rows to fill held-out rows.  ``by`` restricts donors to one class.
    """
    from .neighbours import nearest_donors

    src = donors if donors is not None else df
    keys = [by] if by else []
    arr = F.array(*[_clean(f) for f in features])
    left = df.select(F.col(id_col).alias("qid"), *keys, arr.alias("v"))
    right = src.select(F.col(id_col).alias("did"), *keys, arr.alias("v"))
    # Without donor rows of their own, held-out rows must not exclude an equal id.
    filled = nearest_donors(left, right, len(features), k, by=by, exclude_self=donors is None)
    means = src.groupBy(*keys).agg(*[F.avg(_clean(f)).alias(f"_m_{f}") for f in features])
    out = df.join(filled.withColumnRenamed("qid", id_col), id_col, "left")
    if by:
        out = out.join(broadcast_small(means), by, "left")
    else:
        out = out.withColumns({f"_m_{f}": means.select(f"_m_{f}").scalar() for f in features})
    fills = {f: F.coalesce(_clean(f), F.col("fill")[i], F.col(f"_m_{f}")) for i, f in enumerate(features)}
    return out.withColumns(fills).select(*df.columns)


def impute(df: DataFrame, features: Sequence[str], method: str, id_col: str = "id", order: str | None = None, **kwargs) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if method == "knn":
        return knn(df, features, id_col, **kwargs)
    if method == "interpolate":
        return interpolate(df, features, order or id_col)
    return fill_with(df, fill_values(df, features, method))
