"""Diversity measured as Shannon entropy (bits) of count distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bit_total
from .sample import fixed_size


def of_counts(counts: DataFrame, count: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """-sum p log2 p over the rows of a count table, from two sums: log2 T - sum(n log2 n) / T."""
    n = F.col(count).cast("double")
    some = counts.filter(F.col(count) > 0)
    return some.groupBy(*by).agg(
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"), F.count("*").alias("bins")
    )


def of_column(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return of_counts(df.groupBy(*by, col).agg(F.count("*").alias("n")), "n", by)


def maximum(bins: int) -> float:
    return math.log2(bins) if bins > 1 else 0.0


def bucket(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the last bin includes the upper edge."""
    raw = F.floor(F.round(F.try_divide((x - lo) * bins, hi - lo), 9)).cast("int")
    return F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(bins - 1))


def bit_shares(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(pos, p): share of rows with the bit set."""
    return df.select(F.posexplode(bits).alias("pos", "bit")).groupBy("pos").agg(F.avg(F.col("bit").cast("double")).alias("p"))


def per_bit(df: DataFrame, bits: str = "bits") -> DataFrame:
    p = F.col("p")
    h = F.when((p > 0) & (p < 1), -p * F.log2(p) - (1.0 - p) * F.log2(1.0 - p)).otherwise(0.0)
    return bit_shares(df, bits).withColumn("entropy", h)


def per_bit_summary(df: DataFrame, bits: str = "bits", informative: float = 0.05) -> DataFrame:
    return per_bit(df, bits).agg(
        F.avg("entropy").alias("mean_entropy"),
        F.avg((F.col("entropy") > informative).cast("double")).alias("informative_share"),
    )


def bit_count_histogram(df: DataFrame, bits: str = "bits", bins: int = 20) -> DataFrame:
    totals = df.select(bit_total(bits).cast("double").alias("x")).groupBy("x").agg(F.count("*").alias("_c"))
    lo, hi = totals.agg(F.min("x")), totals.agg(F.max("x"))
    # numpy widens a zero-width range by half a unit on both sides.
    same = lo.scalar() == hi.scalar()
    low = F.when(same, lo.scalar() - 0.5).otherwise(lo.scalar())
    high = F.when(same, hi.scalar() + 0.5).otherwise(hi.scalar())
    return totals.groupBy(bucket(F.col("x"), low, high, bins).alias("bin")).agg(F.sum("_c").alias("n"))


def bit_count(df: DataFrame, bits: str = "bits", bins: int = 20) -> DataFrame:
    return of_counts(bit_count_histogram(df, bits, bins))


def bit_frequency(df: DataFrame, bits: str = "bits", bins: int = 50) -> DataFrame:
    tagged = bit_shares(df, bits).groupBy(bucket(F.col("p"), F.lit(0.0), F.lit(1.0), bins).alias("bin"))
    return of_counts(tagged.agg(F.count("*").alias("n")))


def distance_histogram(df: DataFrame, bits: str = "bits", id_col: str = "id", *, sample: int, bins: int = 50, seed: int = 42) -> DataFrame:
    """Histogram of pairwise Tanimoto distances inside a fixed-size sample.

    The sample is bounded, so its matrix is broadcast; each task multiplies its rows against it
    and returns only bin counts, never pairs.
    """
    picked = fixed_size(df.select(id_col, bits), sample, id_col, seed).toPandas().sort_values(id_col, kind="stable")
    spark = df.sparkSession
    mat = np.stack([np.asarray(v, dtype=np.float64) for v in picked[bits]]) if len(picked) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(mat)
    n = len(mat)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        weight = m.sum(1)
        for pdf in batches:
            i = pdf["i"].to_numpy()
            both = m[i] @ m.T
            union = np.maximum(weight[i][:, None] + weight[None, :] - both, 1e-8)
            dist = 1.0 - both / union
            later = np.arange(len(m))[None, :] > i[:, None]
            at = np.minimum(np.floor(np.round(dist[later] * bins, 9)).astype("int64"), bins - 1)
            hist = np.bincount(at, minlength=bins)
            yield pd.DataFrame({"bin": np.arange(bins, dtype="int32"), "n": hist.astype("int64")})

    rows = spark.range(0, n, 1, spark.sparkContext.defaultParallelism).withColumnRenamed("id", "i")
    return rows.mapInPandas(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def distance(df: DataFrame, bits: str = "bits", id_col: str = "id", *, sample: int, **kwargs) -> DataFrame:
    """Entropy of the pairwise distances among ``sample`` rows; the caller says how many."""
    return of_counts(distance_histogram(df, bits, id_col, sample=sample, **kwargs))


def retention_report(original: DataFrame, subset: DataFrame, bits: str = "bits", id_col: str = "id", bins: int = 20, *, sample: int) -> DataFrame:
    """Entropy of a subset next to the whole: retention and use of the maximum, in percent."""

    def side(df: DataFrame) -> DataFrame:
        pb = per_bit_summary(df, bits)
        parts = [
            bit_count(df, bits, bins).select(F.lit("bit count").alias("metric"), F.col("entropy").alias("h")),
            pb.select(F.lit("mean per bit").alias("metric"), F.col("mean_entropy").alias("h")),
            distance(df, bits, id_col, sample=sample).select(F.lit("tanimoto distance").alias("metric"), F.col("entropy").alias("h")),
            bit_frequency(df, bits).select(F.lit("bit frequency").alias("metric"), F.col("entropy").alias("h")),
            pb.select(F.lit("informative bits").alias("metric"), F.col("informative_share").alias("h")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("h", F.round("h", 4))

    a = side(original).withColumnRenamed("h", "h_original")
    b = side(subset).withColumnRenamed("h", "h_subset")
    top = (
        F.when(F.col("metric") == "bit count", round(maximum(bins), 4))
        .when(F.col("metric").isin("tanimoto distance", "bit frequency"), round(maximum(50), 4))
        .otherwise(1.0)
    )
    pct = lambda x, y: F.round(F.try_divide(x, y) * 100, 2)
    return (
        a.join(b, "metric")
        .withColumn("h_max", top)
        .withColumn("retention_pct", pct(F.col("h_subset"), F.col("h_original")))
        .withColumn("utilisation_original", pct(F.col("h_original"), F.col("h_max")))
        .withColumn("utilisation_subset", pct(F.col("h_subset"), F.col("h_max")))
    )
