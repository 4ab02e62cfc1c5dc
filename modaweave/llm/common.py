"""Small helpers the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_small, cut_lineage, scratch_path

#: A word is a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that ``stored`` has written in this process and nobody has dropped.
_written: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, label)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths stored inside the block, for ``drop`` once what was made from them is written."""
    paths: list[str] = []
    mark = len(_written)
    yield paths
    paths += _written[mark:]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written:
            _written.remove(path)
    paths.clear()


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id's text, modulo 4; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4, F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 2


def unit_hash(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str | Sequence[str], most: int, by: str, seed: int = 0) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of the ``key`` columns: a training
    sample only.

    A value with fewer rows keeps them all.  Rows with the same key are one row of the sample, so a row
    that is repeated without end does not fill it; null keys take part like others, so a key should hold
    what tells rows apart.  One aggregation over ``by``; of the rows, only the sample is shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    share = df.groupBy(by).agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")).alias("_share"))
    rated = df.join(broadcast_small(share), F.col(by) == F.col("_by"))
    return rated.filter(unit_hash(*keys, seed=seed) < F.col("_share")).drop("_by", "_share").dropDuplicates([*keys, by])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), for uint64 arrays."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b).

    Alternates star contraction: every neighbour is re-linked to the smallest one, so depth halves
    with each round.  Only the edges' own nodes are returned; nodes are never gathered.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # Larger neighbours of a node go below its smallest one ...
        large = e.join(least, e.b == least.n).select("a", F.col("m").alias("b"))
        # ... and so do the node itself and its smaller neighbours.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        pairs = large.join(low, large.a == low.n)
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        new = cut_lineage(small.filter("a <> b").distinct())
        # A star forest: no node is both a leaf and a centre, and a leaf has one centre.
        centres = new.select(F.col("b").alias("n")).distinct()
        state = new.groupBy("a").agg(F.count("*").alias("k"))
        loose = state.filter("k > 1").select("a").union(new.join(centres, new.a == centres.n, "left_semi").select("a")).limit(1).count()
        e = new
        if not loose:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
