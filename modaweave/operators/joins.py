"""Alignment joins between feature tables, labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_ids(tables: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    ids = [t.select(id_col) for t in tables]
    return reduce(lambda a, b: a.join(b, id_col, "left_semi"), ids[1:], ids[0]).distinct()


def sorted_common_ids(tables: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    return common_ids(tables, id_col).orderBy(id_col)


def align(labels: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return labels.join(vectors, key)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def missing_ids(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")


def lookup_last(rows: DataFrame, mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Map ``key`` to ``value``; the last entry wins for a repeated key, unmatched rows go."""
    last = mapping.groupBy(key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key).filter(F.col(value).isNotNull())


def scatter(inputs: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every input row, with a null prediction where none was made."""
    return inputs.join(predictions, key, "left")


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def task_rows(df: DataFrame, keys: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Wide multi-task labels to (keys, task, label), untested cells dropped."""
    return df.unpivot(list(keys), list(tasks), "task", "label").filter("label is not null")
