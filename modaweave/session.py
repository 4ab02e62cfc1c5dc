"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "modaweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with adaptive execution and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session without that
    setting gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="modaweave-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in reliable storage, so lost executors cost a re-read, not a recompute."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to: Spark deletes them when the
    driver's garbage is collected, which else may come after many rounds of a loop."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Write a table of group-level numbers and mark it for broadcast if its rows, as text, proved to
    take at most ``most_bytes``; otherwise it goes back as it is and joins by shuffle."""
    kept = cut_lineage(df)
    size = kept.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(kept) if size <= most_bytes else kept


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; products over many joins are cut off at 2**62."""
    try:
        return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 62)
    except ValueError:  # more digits than an int conversion accepts
        return 1 << 62


def layout_width(df: DataFrame, per_range: int = 16 << 20) -> int:
    """Ranges for an explicit layout: the configured shuffle width, fewer for a small input."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, planned_bytes(df) // per_range)))


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to be split into one piece per core.

    Decided from the planned size: an input with at least one full split per core is left as the
    scan divides it, so nothing large is ever shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if planned_bytes(df) < cores * split else df
