"""Ranks, running sums and exact quantiles that never put a whole group into one task.

Two layouts are used.

* Hash order: an md5 key is uniform, so its leading digits cut any group into even ranges that
  are already in order.  Rank = rows in earlier ranges + position inside the range.
* Value order: rows are range-partitioned on the full ordering (ties broken by id, so a hot value
  is split too), written once, and each partition's total becomes the offset of the later ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import seeded_key
from ..session import cut_lineage, layout_width


def _before(by: Sequence[str], order: str) -> W:
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def hash_rank(
    df: DataFrame,
    key: str,
    by: Sequence[str] = (),
    seed: int | str | Column = 42,
    name: str = "rank",
    size: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """1-based rank of each row in seeded hash order inside its group.

    ``size`` also adds the number of rows of the group.  ``digits`` leading hex digits give
    16**digits ranges per group.
    """
    by = list(by)
    work = df.withColumn("_h", seeded_key(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = work.groupBy(*by, "_b").agg(F.count("*").alias("_cnt"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(_before(by, "_b")), F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_cnt").over(W.partitionBy(*by)))
    offsets = offsets.drop("_cnt")
    for col in by:
        offsets = offsets.withColumnRenamed(col, f"_o_{col}")
    offsets = offsets.withColumnRenamed("_b", "_o_b")
    match = work["_b"] == offsets["_o_b"]
    for col in by:
        match = match & work[col].eqNullSafe(offsets[f"_o_{col}"])
    inside = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    return (
        work.withColumn("_i", inside)
        .join(offsets, match)
        .withColumn(name, (F.col("_off") + F.col("_i")).cast("bigint"))
        .drop("_h", "_b", "_i", "_off", "_o_b", *[f"_o_{c}" for c in by])
    )


def lay_out(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort once, and keep the layout in reliable storage.

    Adds ``_pid`` (range number, in order) and ``_seq`` (position over the whole layout).
    """
    width = layout_width(df)
    laid = (
        df.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return cut_lineage(laid)


def ordered_rank(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """1-based row number in value order (``order`` must be total), optionally inside groups."""
    by = list(by)
    laid = lay_out(df, [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order])
    counts = laid.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(_before([], "_pid")), F.lit(0)).alias("_off"))
    base = F.shiftleft(F.col("_pid").cast("bigint"), 33)
    ranked = laid.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_seq") - base + 1)
    if by:
        firsts = ranked.groupBy(*by).agg(F.min(name).alias("_first"))
        ranked = ranked.join(firsts, by).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return ranked.drop("_pid", "_seq", "_off")


def ordered_cumsum(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str],
    by: Sequence[str] = (),
    prefix: str = "cum_",
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sums in value order (``order`` must be total), optionally inside groups.

    ``total`` is a column prefix that adds each group's whole sum as well.
    """
    by = list(by)
    laid = lay_out(df, [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order])
    totals = laid.groupBy(*by, "_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wholes = [F.sum(f"_t_{v}").over(W.partitionBy(*by)).alias(f"{total}{v}") for v in values] if total else []
    offsets = totals.select(
        *by, "_pid", *[F.coalesce(F.sum(f"_t_{v}").over(_before(by, "_pid")), F.lit(0)).alias(f"_o_{v}") for v in values], *wholes
    )
    inside = W.partitionBy(*by, "_pid").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    out = laid
    for v in values:
        out = out.withColumn(f"_i_{v}", F.sum(v).over(inside))
    out = out.join(offsets, [*by, "_pid"])
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_i_{v}") + F.col(f"_o_{v}"))
    return out.drop("_pid", "_seq", *[f"_i_{v}" for v in values], *[f"_o_{v}" for v in values])


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str], names: tuple[str, str] = ("feature", "value")) -> DataFrame:
    """Wide numeric columns to (keys, feature, value) rows."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), names[0], names[1]
    )


def exact_quantiles_long(long: DataFrame, probs: Sequence[float], by: str = "feature", value: str = "value") -> DataFrame:
    """(by, i, q): the linear-interpolated quantile for each probability ``probs[i]``.

    Equal values are counted before the shuffle, so a hot value is one row; the remaining distinct
    values are ranked over the whole cluster instead of inside one aggregation buffer.  Only rows
    that hold a wanted position go on.
    """
    share = np.asarray(probs, dtype="float64")
    counted = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by, value).agg(F.count("*").alias("_c"))
    cum = ordered_cumsum(counted, [value], ["_c"], [by], prefix="_cum", total="_tot")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                pos = share * (g["_tot_c"].iat[0] - 1)
                need = np.concatenate([np.floor(pos), np.ceil(pos)])
                order = np.argsort(need, kind="stable")
                end = g["_cum_c"].to_numpy()
                lo = np.searchsorted(need[order], end - g["_c"].to_numpy(), "left")
                hi = np.searchsorted(need[order], end, "left")
                for row in np.flatnonzero(hi > lo):
                    which = order[lo[row] : hi[row]]
                    yield pd.DataFrame(
                        {
                            by: key,
                            "i": (which % len(share)).astype("int32"),
                            "upper": which >= len(share),
                            "fraction": (pos - np.floor(pos))[which % len(share)],
                            "at": float(g[value].iat[row]),
                        }
                    )

    kind = dict(long.dtypes)[by]
    found = cum.select(by, F.col(value).cast("double").alias(value), "_c", "_cum_c", "_tot_c")
    hits = found.mapInPandas(pick, f"`{by}` {kind}, i int, upper boolean, fraction double, at double")
    low, high = F.max(F.when(~F.col("upper"), F.col("at"))), F.max(F.when(F.col("upper"), F.col("at")))
    return hits.groupBy(by, "i").agg((low + (high - low) * F.max("fraction")).alias("q"))


def exact_quantiles(long: DataFrame, probs: Sequence[float], by: str = "feature", value: str = "value") -> DataFrame:
    """The same, one row per group with columns ``q0 .. q{n-1}``."""
    rows = exact_quantiles_long(long, probs, by, value)
    return rows.groupBy(by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark keeps only ``n`` per group on the map side."""
    win = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(win)).filter(F.col(name) <= n)


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join a many-row left side with a one-row-per-key right side, spreading hot keys."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")
