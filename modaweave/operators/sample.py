"""Sampling and class balancing with seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import seeded_key, unit_interval
from .ranking import exact_quantiles, hash_rank, to_long

SMALL_SAMPLE = 50_000


def fixed_size(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): the n smallest keys."""
    if n <= SMALL_SAMPLE:
        # Each task keeps its n smallest; a bounded merge finishes.
        return df.withColumn("_h", seeded_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")
    return hash_rank(df, id_col, seed=seed, name="_r").filter(F.col("_r") <= n).drop("_r")


def undersample(df: DataFrame, label: str, id_col: str = "id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Cut every class to the smallest class's size."""
    ranked = hash_rank(df, id_col, by=[*by, label], seed=seed, name="_r", size="_n")
    sizes = df.groupBy(*by, label).agg(F.count("*").alias("_c"))
    if by:
        least = sizes.groupBy(*by).agg(F.min("_c").alias("_min"))
        return ranked.join(least, list(by)).filter("_r <= _min").drop("_r", "_n", "_min")
    return ranked.filter(F.col("_r") <= sizes.agg(F.min("_c")).scalar()).drop("_r", "_n")


def cost_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Positive rows weigh round(majority / minority), all others 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    ratio = counts.agg(F.round(F.max("_n") / F.min("_n")))
    return df.withColumn(out, F.when(F.col(label) == 1, ratio.scalar()).otherwise(F.lit(1.0)))


def stratified_by_quantile(df: DataFrame, value: str, budget: int, id_col: str = "id", strata: int = 20, seed: int = 42) -> DataFrame:
    """Proportional sample over equal-probability strata of ``value``, at least one row each,
    trimmed to the budget in (stratum, hash) order."""
    long = to_long(df, [id_col], [value])
    row = exact_quantiles(long, list(np.linspace(0, 1, strata + 1))).first()
    if row is None:
        return df.limit(0)
    edges = [row[f"q{i}"] for i in range(strata + 1)]
    edges[-1] += 1
    x = F.col(value).cast("double")
    # The stratum is the last one whose lower edge is reached and upper edge is not.
    stratum = None
    for i in range(strata):
        hit = (x >= edges[i]) & (x < edges[i + 1])
        stratum = F.when(hit, i) if stratum is None else stratum.when(hit, i)
    tagged = df.withColumn("stratum", stratum)
    # One row per stratum, so the running offset is over a fixed handful of rows.
    counts = tagged.groupBy("stratum").agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*"))
    quota = F.least(F.greatest(F.bround(F.col("_n") / total.scalar() * budget).cast("bigint"), F.lit(1)), F.col("_n"))
    plan = counts.withColumn("_q", quota)
    before = W.orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)
    plan = plan.withColumn("_off", F.coalesce(F.sum("_q").over(before), F.lit(0))).drop("_n")
    ranked = hash_rank(tagged, id_col, by=["stratum"], seed=seed, name="_r").join(F.broadcast(plan), "stratum")
    keep = (F.col("_r") <= F.col("_q")) & (F.col("_off") + F.col("_r") <= budget)
    return ranked.filter(keep).select(*df.columns, "stratum")


def log_quotas(sizes: DataFrame, n: int, key: str = "cluster", size: str = "size") -> DataFrame:
    """round(log1p(size) / total * n) per cluster; the remainder goes to the largest cluster.

    The remainder needs two totals and one maximum, taken as scalars, so no window gathers the
    clusters in one task.
    """
    w = F.log1p(F.col(size).cast("double"))
    total = sizes.agg(F.sum(w))
    quoted = sizes.withColumn("quota", F.bround(w / total.scalar() * n).cast("bigint"))
    rest = quoted.agg((F.lit(n) - F.sum("quota")).cast("bigint"))
    top = sizes.agg(F.min_by(key, F.struct((-F.col(size)).alias("s"), F.col(key).alias("k"))))
    return quoted.withColumn("quota", F.col("quota") + F.when(F.col(key) == top.scalar(), rest.scalar()).otherwise(F.lit(0)))


# -- synthetic minority rows --------------------------------------------------------------------
def smote(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", k: int = 5, seed: int = 42, among: DataFrame | None = None) -> DataFrame:
    """Balance two classes by points between a minority row and one of its k nearest minority
    neighbours.  Row i of the synthetic rows starts from minority row ((i-1) mod m) in hash order.

    ``among`` restricts which minority rows may start a point (the borderline form).
    """
    from .neighbours import knn

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(False))
    minority = min(counts, key=lambda c: (counts[c], c))
    need = max(counts.values()) - counts[minority]
    small = df.filter(F.col(label) == minority)
    starts = small if among is None else small.join(among.select(id_col), id_col, "left_semi")
    ranked = hash_rank(starts.select(id_col, vec), id_col, seed=seed, name="_r", size="_m")
    # Copies per starting row, then one synthetic row each.
    copies = F.floor(F.lit(need) / F.col("_m")) + F.when(F.col("_r") <= F.lit(need) % F.col("_m"), 1).otherwise(0)
    base = ranked.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).drop("_r", "_m")
    near = knn(small, k, vec, id_col, "euclidean").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near")
    )
    other = small.select(F.col(id_col).alias("_nid"), F.col(vec).alias("_nvec"))
    h = seeded_key(F.concat_ws("#", F.col(id_col), F.col("_copy")), seed)
    pick = F.floor(unit_interval(h) * F.size("_near")).cast("int")
    gap = unit_interval(F.md5(h))
    made = (
        base.join(near, F.col(id_col) == F.col("query"))
        .withColumn("_nid", F.col("_near")[pick]["neighbour"])
        .withColumn("_gap", gap)
        .join(other, "_nid")
        .select(
            F.concat(F.lit("s"), F.col(id_col).cast("string"), F.lit("-"), F.col("_copy").cast("string")).alias("_id"),
            F.zip_with(F.col(vec).cast("array<double>"), F.col("_nvec").cast("array<double>"), lambda a, b: a + F.col("_gap") * (b - a)).alias(vec),
            F.lit(minority).alias(label),
        )
    )
    real = df.select(F.col(id_col).cast("string").alias(id_col), F.col(vec).cast("array<double>").alias(vec), label, F.lit(False).alias("synthetic"))
    return real.unionByName(made.select(F.col("_id").alias(id_col), vec, label, F.lit(True).alias("synthetic")))


def danger_rows(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", m: int = 10) -> DataFrame:
    """Minority rows whose m nearest neighbours are mostly, but not all, of another class."""
    from .neighbours import knn, with_labels

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    near = with_labels(knn(df, m, vec, id_col, "euclidean"), df, id_col, label)
    votes = near.filter(F.col("truth") == float(minority)).groupBy("query").agg(
        F.count_if(F.col("label") != F.col("truth")).alias("foreign"), F.count("*").alias("seen")
    )
    return votes.filter((F.col("foreign") * 2 > F.col("seen")) & (F.col("foreign") < F.col("seen"))).select(F.col("query").alias(id_col))


def borderline_smote(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    return smote(df, label, vec, id_col, k, seed, among=danger_rows(df, label, vec, id_col, m))


def edited(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", k: int = 3) -> DataFrame:
    """Drop rows that any of their k nearest neighbours contradicts."""
    from .neighbours import knn, with_labels

    near = with_labels(knn(df, k, vec, id_col, "euclidean"), df, id_col, label)
    bad = near.filter(F.col("label") != F.col("truth")).select(F.col("query").alias(id_col)).distinct()
    return df.join(bad, id_col, "left_anti")


def smote_enn(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    from ..session import cut_lineage

    return edited(cut_lineage(smote(df, label, vec, id_col, k, seed)), label, vec, id_col)


def rebalance(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "id", strategy: str | None = None, seed: int = 42) -> tuple[DataFrame, str]:
    """Apply the route the class profile calls for (or the named one); returns (rows, route).

    A single class has nothing to balance.  "balanced ensemble" leaves the rows alone: its learner
    draws balanced copies itself, see ``learners.for_route``.  An unknown name is an error.
    """
    from .profile import class_balance, resampling_decision

    route = strategy or resampling_decision(class_balance(df, label)).first()["strategy"]
    actions = {
        "downsampling": lambda: undersample(df, label, id_col, seed),
        "smote": lambda: smote(df, label, vec, id_col, seed=seed),
        "borderline smote": lambda: borderline_smote(df, label, vec, id_col, seed=seed),
        "smote-enn": lambda: smote_enn(df, label, vec, id_col, seed=seed),
        "class weights": lambda: cost_weights(df, label),
        "cost weight": lambda: cost_weights(df, label),
        "balanced ensemble": lambda: df,
        "single class": lambda: df,
    }
    if route not in actions:
        raise ValueError(f"strategy must be one of {sorted(actions)}, got {route!r}")
    return actions[route](), route
