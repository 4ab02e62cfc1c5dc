"""Sinks with checks, shards, split folders and resumable steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import spread
from ..operators.ranking import hash_rank


def save_embeddings(df: DataFrame, path: str, id_col: str = "id", vec: str = "features") -> int:
    """Write (id, vector) as Parquet; empty tables, null ids and vectors of uneven length fail.

    The check reads what was written, so the input is computed once.
    """
    df.select(id_col, vec).write.mode("overwrite").parquet(path)
    got = (
        df.sparkSession.read.parquet(path)
        .agg(F.count("*").alias("rows"), F.count(id_col).alias("ids"), F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high"))
        .first()
    )
    if not got["rows"]:
        raise ValueError("no rows to save")
    if got["rows"] != got["ids"] or got["low"] != got["high"]:
        raise ValueError(f"inconsistent table: {got.asDict()}")
    return got["rows"]


def append_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add result rows to a folder of files; each file carries its own header."""
    df.write.mode("append").option("header", True).format(fmt).save(path)


def pending(requested: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested work that has no finished record yet."""
    return requested.join(done.select(*keys).distinct(), list(keys), "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def step(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Run a step once: a finished output is read back instead of being computed again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(requested: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute only the keys missing from ``path`` and append them."""
    spark = requested.sparkSession
    todo = pending(requested, spark.read.parquet(path), keys) if exists(spark, path) else requested
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def shard_rows(df: DataFrame, per_shard: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Seeded permutation cut into shards of a fixed number of rows: adds ``shard``."""
    ranked = hash_rank(df, id_col, seed=seed, name="_r")
    return ranked.withColumn("shard", F.floor((F.col("_r") - 1) / per_shard).cast("int")).drop("_r")


def save_shards(df: DataFrame, path: str, per_shard: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Write the shards and return the manifest (shard, n_rows)."""
    shard_rows(df, per_shard, id_col, seed).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count("*").alias("n_rows"))


def shard_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("n_files"), F.sum("n_rows").alias("n_samples"), F.max("n_rows").alias("sample_per_file")
    )


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def to_matrix_store(df: DataFrame, features: Sequence[str], ids: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """Keep common ids only and store (id, features)."""
    kept = df.join(ids.select(id_col), id_col, "left_semi")
    kept.select(id_col, F.array(*[F.col(f).cast("double") for f in features]).alias("features")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prefixed(df: DataFrame, vec: str, prefix: str, width: int, id_col: str = "id") -> DataFrame:
    """Flat table ``id, prefix0 .. prefix{width-1}``."""
    return df.select(id_col, *spread(vec, prefix, width))
