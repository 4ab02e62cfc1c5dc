"""Packing along a space-filling curve.

Every document becomes a vector of hashed token counts, projected to a few dimensions; its cell's
Hilbert index orders the corpus so that neighbours on the curve are alike.  Documents are laid end
to end in that order and cut every ``length`` ids, so that only the very last sequence is short.

A null text counts as empty and still has its end id.  Equal curve keys are ordered by a stored row
key, repeated rows are separate documents, an empty table gives no pieces, and a very long text
simply fills many sequences.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_cumsum
from .common import mix64, stored
from .tokens import slices, word_bpe

LENGTH = 4096
END = 2
BUCKETS, DIMS, BITS = 1024, 4, 10


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, end id left out."""
    ids, offsets = word_bpe(path).of(texts, END)
    return [ids[i : j - 1].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


class Curve:
    """Grid cell and curve position of documents: hashed token counts, damped, projected."""

    def __init__(self, vocabulary: int = 1 << 17, seed: int = 11):
        h = mix64(np.arange(vocabulary, dtype=np.uint64))
        self.bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        self.sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
        self.projection = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))

    def cells(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros((n, DIMS))
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            part = ids[offsets[lo] : offsets[hi]] % len(self.bucket)
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])) * BUCKETS
            v = np.bincount(row + self.bucket[part], weights=self.sign[part], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
            v = np.sign(v) * np.sqrt(np.abs(v))
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            out[lo:hi] = v @ self.projection / np.where(norm > 0, norm, 1.0)
        side = 1 << BITS
        # The projections of unit vectors are about standard normal; the logistic curve evens the cells.
        return np.minimum((side / (1.0 + np.exp(-1.7 * out))).astype(np.int64), side - 1)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows of ``bits``-bit coordinates)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level on
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Stored table: doc_id, _r (row key), curve, doc_tokens, ids (binary, end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, curve = word_bpe(tokenizer), Curve()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                ids, offsets = words.of(texts[lo:hi].to_pylist(), END)
                key = hilbert_index(curve.cells(ids, offsets))
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(key), pa.array(np.diff(offsets)), raw], ["doc_id", "curve", "doc_tokens", "ids"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, curve long, doc_tokens long, ids binary")
    return stored(out.withColumn("_r", F.monotonically_increasing_id()), "pack-ids")


def _cut(length: int, ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, b, n, at in zip(pdf["doc_id"], pdf["ids"], pdf["doc_tokens"], pdf["_at"], strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    k = min(length - offset, n - start)
                    piece = b[4 * start : 4 * (start + k)]
                    for name, v in (("doc_id", doc), ("start", start), ("length", k), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset), ("ids", piece)):
                        rows[name].append(v)
                    start += k
            out = pd.DataFrame(rows)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out if ids else out.drop(columns="ids")

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked, the ids themselves (binary).

    The order is settled on (curve, row key, count) alone; ids move once, to meet their offsets.
    """
    rows = tokenised(docs, tokenizer)
    order = ordered_cumsum(rows.select("curve", "_r", "doc_tokens"), ["curve", "_r"], ["doc_tokens"])
    at = order.select(F.col("_r").alias("_o"), (F.col("cum_doc_tokens") - F.col("doc_tokens")).alias("_at"))
    placed = rows.join(at, rows._r == at._o).select("doc_id", "ids", "doc_tokens", "_at")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInPandas(_cut(length, ids), schema + (", ids binary" if ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, n_ids, ids.  A sequence holds at
    most one document start per id, so a group is bounded by the sequence length."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", F.aggregate("_p", F.lit(0).cast("bigint"), lambda acc, p: acc + p["length"]).alias("n_ids"), joined.alias("ids"))


def op4(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack(docs, tokenizer, length, ids=False)
