"""Modality tables laid out by id, so that aligning them again and again shuffles nothing.

Each table is written once into the same number of buckets of the id, sorted inside.  Tables opened from
the store keep that layout: a join on the id, an intersection of ids, or a filter by the common ids reads
bucket against bucket.  A bucket holds many ids by their hash, and an id that is repeated stays in one; the
number of buckets bounds a task's share, so it should grow with the largest table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.modality import ModalitySet
from ..session import layout_width, scratch_path

_LABELS = "_labels"


class ModalityStore:
    """Tables of a modality set under one name in the session's catalog, files below ``path``."""

    def __init__(self, spark: SparkSession, name: str, tables: list[str], id_col: str, labelled: bool):
        self.spark, self.name, self.tables, self.id_col, self.labelled = spark, name, tables, id_col, labelled

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def open(self) -> ModalitySet:
        """The set as stored."""
        read = lambda part: self.spark.table(self._table(part))
        return ModalitySet({t: read(t) for t in self.tables}, self.id_col, read(_LABELS) if self.labelled else None)

    def aligned(self, out: str = "features") -> DataFrame:
        """id and the features of all tables as one array, ids that every table has."""
        return self.open().assemble(out)

    def common_ids(self) -> DataFrame:
        """Distinct ids present in every table and in the labels."""
        parts = [self.spark.table(self._table(t)).select(self.id_col) for t in [*self.tables, *([_LABELS] if self.labelled else [])]]
        return reduce(lambda a, b: a.join(b.hint("merge"), self.id_col, "left_semi"), parts[1:], parts[0]).distinct()

    def drop(self) -> None:
        """Forget the tables; their files stay with the caller's folder."""
        for t in [*self.tables, *([_LABELS] if self.labelled else [])]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(t)}")


def store(ms: ModalitySet, buckets: int | None = None, path: str | None = None, name: str | None = None) -> ModalityStore:
    """Write every table of the set, and its labels, in ``buckets`` buckets of the id.

    A table is dealt by the id before it is written, so a bucket is one file.  By default the largest
    table's size sets the number of buckets.
    """
    parts = {**ms.tables, **({_LABELS: ms.labels} if ms.labels is not None else {})}
    spark = next(iter(parts.values())).sparkSession
    buckets = buckets or max(layout_width(df) for df in parts.values())
    path = path or scratch_path(spark, "modalities")
    name = name or f"modalities_{uuid.uuid4().hex[:12]}"
    for part, df in parts.items():
        laid = df.repartition(buckets, F.col(ms.id_col))
        laid.write.format("parquet").option("path", f"{path}/{part}").bucketBy(buckets, ms.id_col).sortBy(ms.id_col).saveAsTable(f"{name}_{part}")
    return ModalityStore(spark, name, list(ms.tables), ms.id_col, ms.labels is not None)
