"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage works on all that the stage before it kept, written as Parquet and read again.  Stages
before the last return the columns of ``documents``.  A stage stores tables on its way, and its result
reads them.  ``run`` drops them when it has written that result, and keeps no state.  Where stages are
called one by one, a stage drops what the call before it left, since that call's result was written to
be handed over; if the stage before was called more than once meanwhile, only what belongs to results
that nobody holds any more.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from modaweave.llm import op1_secrets, op4_packing, op5_quality, op7_minhash, op8_mixing
from modaweave.llm.common import drop, table, tracked
from modaweave.llm.queries import text_batches, tokenizer
from modaweave.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Calls of stages on their own that may still be read: the stage, its result (weakly), what it reads.
_left: list[tuple[str, weakref.ref, list[str]]] = []


def stage_after(before: str | None) -> Callable[[Stage], Stage]:
    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            only = sum(name == before for name, _, _ in _left) == 1
            for call in list(_left):
                name, result, paths = call
                if result() is None or (only and name == before):
                    drop(spark, paths)
                    _left.remove(call)
            text_batches(spark)
            with tracked() as paths:
                out = stage(spark, docs, sf_dir)
            _left.append((stage.__name__, weakref.ref(out), paths))
            return out

        return run_stage

    return wrap


@stage_after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts."""
    return op5_quality.accepted(docs, table(spark, sf_dir, "labels"))


@stage_after("quality")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return op7_minhash.deduplicated(docs, width=5, similarity=(4, 5))


@stage_after("near_duplicates")
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return op1_secrets.redacted(docs)


@stage_after("secrets")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op8_mixing.mixed_documents(docs)


@stage_after("mixing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, ids included."""
    return op4_packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: A learned model decides in two stages, so no SQL gives these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is stored in the shared folder."""
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with tracked() as paths:
            docs = stage.__wrapped__(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            drop(spark, paths)
    return docs
