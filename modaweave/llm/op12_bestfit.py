"""Best-fit packing planned over a length histogram.

Documents longer than a sequence are cut into whole sequences and one shorter first piece.  The plan
never sees documents: the counts of piece lengths, at most ``length`` numbers, are packed best-fit,
longest first, with runs of equal bins handled at once.  The plan is a table of slots: ranks ``lo`` to
``hi`` of a length fill bins from ``first`` on, ``each`` to a bin, from ``offset`` on.  A piece then
takes the slot of its rank among the pieces of its length.

Ranks need no sort and no group in one task: a task counts the pieces of each length as it writes them,
and the counts of (task, length) give every task its first rank.

A null text counts as empty and still has its end id; repeated rows are separate documents; an empty
table gives no pieces; a very long text gives many full sequences; all documents may have one length.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import broadcast_small
from .common import stored
from .tokens import byte_bpe, slices

LENGTH = 2048
END = 0


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (size, lo, hi, first, each, offset) that pack ``counts`` pieces of each size best-fit, the
    largest first.

    Bins with the same room left are interchangeable, so they are kept as runs (first bin, number).  A
    size splits at most two runs, and a run takes at most sqrt(2 * length) different sizes, so there are
    at most 4 * length * sqrt(2 * length) slots whatever the number of documents.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    bins = 0

    def add(room: int, first: int, number: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, number))

    for size in sorted(counts, reverse=True):
        rank, count = 0, counts[size]
        while rank < count:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:  # no bin has room: open as many as the rest of this size needs
                room = length
                first, number = bins, -(-(count - rank) // (room // size))
                bins += number
            each = room // size  # a bin just used is the tightest fit as long as it has room
            full, left = min(number, (count - rank) // each), 0
            if full:
                slots.append((size, rank, rank + full * each, first, each, length - room))
                add(room - each * size, first, full)
                rank += full * each
            if full < number and rank < count:
                left = count - rank
                slots.append((size, rank, count, first + full, left, length - room))
                add(room - left * size, first + full, 1)
                rank = count
            kept = full + (left > 0)
            if kept < number:
                add(room, first + kept, number - kept)
    return slots


def pieces(docs: DataFrame, tokenizer: str, length: int, end: int, ids: bool) -> DataFrame:
    """Stored table of pieces, with the writing task ``_task`` and the rank ``_k`` among the task's pieces
    of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = byte_bpe(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                flat = [np.array([*bpe.ids(t or ""), end], dtype="<u4") for t in texts[lo:hi].to_pylist()]
                n = np.array([len(x) for x in flat])
                number = -(-n // length)
                row = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                head = n - (number - 1) * length
                size = np.where(piece == 0, head[row], length)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * length)
                raw = [flat[r][s : s + k].tobytes() for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                step = size[order]
                rank = np.empty(len(size), dtype=np.int64)
                rank[order] = np.arange(len(step)) - np.searchsorted(step, step) + seen[step]
                seen += np.bincount(size, minlength=length + 1)
                cols = {
                    "doc_id": batch.column("doc_id")[lo:hi].take(pa.array(row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(size),
                    "ids_crc32": pa.array(np.array([zlib.crc32(b) for b in raw], dtype=np.int64)),
                    "_task": pa.array(np.full(len(row), task, dtype=np.int32)),
                    "_k": pa.array(rank),
                }
                if ids:
                    cols["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _k long" + (", ids binary" if ids else "")
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(out.mapInArrow(run, schema), "bestfit-pieces")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, ids: bool = True) -> DataFrame:
    """Pieces in sequences of at most ``length`` ids: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, if asked, the ids (binary, little-endian unsigned 32-bit).

    Two numbers a piece meet its rows' first ranks, broadcast where they prove small; the slots have the
    bound that ``plan`` states.
    """
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer, length, end, ids)
    counts = rows.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    base = broadcast_small(counts.select(F.col("_task").alias("_t"), F.col("length").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), "_n"))
    histogram = {r["_l"]: r["n"] for r in base.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, length), "_size long, _lo long, _hi long, _first long, _each long, _offset long")
    ranked = rows.join(base, (rows._task == base._t) & (rows.length == base._l)).withColumn("_rank", F.col("_base") + F.col("_k"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_first") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"),
        *(["ids"] if ids else []),
    )


def op12(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack(docs, tokenizer, length, ids=False)
