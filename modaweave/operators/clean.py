"""Projection, validation and duplicate handling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, is_clean


def validate(df: DataFrame, predicate: Column, reason: str = "invalid") -> tuple[DataFrame, DataFrame]:
    """Split into (good rows, reject rows with a reason); nothing is rewritten in place."""
    flagged = df.withColumn("_ok", F.coalesce(predicate, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter("not _ok").drop("_ok").withColumn("reason", F.lit(reason))


def drop_empty(df: DataFrame, entity: str, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Drop blank entities and those that yield no tokens."""
    text = F.trim(F.col(entity))
    parts = tokens(text) if tokens else F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return df.filter((F.length(text) > 0) & (F.size(parts) > 0))


def canonicalize(df: DataFrame, key: str, normaliser: Callable[[Column], Column] | None = None, out: str = "canonical") -> DataFrame:
    """Add a canonical form of ``key``; where the normaliser gives nothing the original is kept."""
    fn = normaliser or (lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit("")))
    return df.withColumn(out, F.coalesce(fn(F.col(key)), F.col(key)))


def clean_key(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.trim(key.cast("string"))


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, as a partially aggregated minimum."""
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*key).agg(row).select(*key, "_r.*").select(*df.columns)


def drop_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Remove every key seen with more than one label."""
    bad = df.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo <> _hi").select(key)
    return df.join(bad, key, "left_anti")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def present_columns(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    return df.select(*keep, *[c for c in wanted if c in df.columns and c not in keep])


def drop_unclean(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(is_clean(vector))


def fill_unclean_with_means(df: DataFrame, vector: str) -> DataFrame:
    """A row with any non-finite entry is replaced by the vector of column means (0 where none)."""
    v = as_doubles(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    cells = df.select(F.posexplode(v).alias("pos", "x"))
    means = cells.groupBy("pos").agg(F.coalesce(F.avg(F.when(finite(F.col("x")), F.col("x"))), F.lit(0.0)).alias("m"))
    # One row per vector position: as long as a single feature row.
    packed = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mv"))
    return df.withColumn(vector, F.when(is_clean(vector), v).otherwise(packed.scalar()))


def population_gate(df: DataFrame, task: str, label: str, min_rows: int, min_share: float = 0.0) -> DataFrame:
    """Tasks with enough rows, more than one class and a large enough minority."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(task, label).agg(F.count("*").alias("_n"))
    return (
        counts.groupBy(task)
        .agg(F.sum("_n").alias("rows"), F.count("*").alias("classes"), F.min("_n").alias("minority"))
        .filter((F.col("rows") >= min_rows) & (F.col("classes") > 1) & (F.col("minority") >= min_share * F.col("rows")))
    )


def named_files(df: DataFrame, col: str) -> DataFrame:
    return df.filter((F.col(col) != "") & (F.lower(col) != "nan"))


def label_array(text: str | Column, kind: str = "int") -> Column:
    """Space-separated multi-task labels to an array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast(kind))


def frontier_properties(homo: str | Column, lumo: str | Column) -> dict[str, Column]:
    """Quantities derived from a pair of energy levels; undefined ratios are null."""
    h = F.col(homo) if isinstance(homo, str) else homo
    l = F.col(lumo) if isinstance(lumo, str) else lumo  # noqa: E741
    potential, hardness = (l + h) / 2.0, (l - h) / 2.0
    return {
        "chemical_potential": potential,
        "chemical_hardness": hardness,
        "chemical_softness": 1.0 - hardness,
        "electrophilicity": F.try_divide(potential * potential, 2.0 * hardness),
        "f_hl": F.try_divide(h, l),
        "ea": -l,
        "xmu": (-l - h) / 2.0,
        "s": F.try_divide(F.lit(2.0), l - h),
        "gap": l - h,
    }
