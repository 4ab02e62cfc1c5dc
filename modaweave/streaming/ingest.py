"""Streams over files of feature rows: filtered ingest, running counts, scoring, mergeable moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.infer import ModelFn, embed
from ..operators.linalg import Moments, centred_moments, moments
from ..session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of ``folder``; with ``pattern`` those it names there, single files or folders of
    part files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # The braces make any name a glob, which may stand for a file as well as for a folder.
    return reader.parquet(f"{folder.rstrip('/')}/{{{pattern}}}" if pattern else folder)


def ingest(stream: DataFrame, ids: DataFrame, key: str, valid: Column, good: str, rejects: str, checkpoint: str | None = None) -> None:
    """Append valid rows with a known id to ``good`` and the others, with a reason, to ``rejects``.

    Each micro-batch writes to its own folder under both targets, so a batch repeated after a
    failure replaces itself instead of doubling.
    """
    spark = stream.sparkSession
    known = ids.select(F.col(key).alias("_k")).distinct()

    def write(batch: DataFrame, epoch: int) -> None:
        tagged = batch.join(known, batch[key] == known["_k"], "left").withColumn(
            "reason", F.when(F.col("_k").isNull(), "unknown id").when(~F.coalesce(valid, F.lit(False)), "invalid value")
        ).drop("_k")
        tagged.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={epoch}")
        tagged.filter("reason is not null").write.mode("overwrite").parquet(f"{rejects}/batch={epoch}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def running_counts(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str | None = None) -> None:
    """Counts per key over everything seen; the latest complete result is kept in ``out``."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "counts"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_stream(stream: DataFrame, text: str, model: ModelFn, id_col: str, out: str, checkpoint: str | None = None) -> None:
    """Score new rows into a Parquet folder; the file sink's log makes each row count once."""
    query = (
        embed(stream, text, model, id_col)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "score"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def accumulate_moments(stream: DataFrame, vec: str, out: str, checkpoint: str | None = None) -> Moments:
    """Merge each micro-batch's centred moments into a state table.

    One state row set per batch number, replaced when a batch is repeated, merged when read.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        m = centred_moments(batch, vec)
        rows = [(0, float(m.n), m.total.tolist())] + [(i + 1, 0.0, r.tolist()) for i, r in enumerate(m.outer)]
        spark.createDataFrame(rows, "i int, n double, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "moments"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_moments(spark, out)


def read_moments(spark: SparkSession, path: str) -> Moments:
    """All batches' moments: products inside the batches are summed, and what lies between the batch
    means is one more moment pass over a row per batch."""
    state = spark.read.parquet(path)
    heads = state.filter("i = 0").select("n", array_to_vector("row").alias("t"))
    whole = heads.agg(F.sum("n").alias("n"), Summarizer.sum(F.col("t")).alias("t")).first()
    n, total = whole["n"], whole["t"].toArray()
    centre = F.array(*[F.lit(float(x)) for x in total / n])
    between = state.filter("i = 0").select(F.zip_with("row", centre, lambda t, c: F.sqrt("n") * (t / F.col("n") - c)).alias("v"))
    inside = state.filter("i > 0").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
    outer = np.zeros((len(total), len(total)))
    for r in inside.collect():
        outer[r["i"] - 1] = r["s"].toArray()
    return Moments(int(n), total, outer + moments(between, "v").outer, True)
