"""Alignment of two tokenizers over the same text, divided at shared cuts.

Each text is encoded by A and by B; byte offsets where a token of both ends are cuts.  An interval of
A tokens is divided by the common end nearest above its middle, found by bisection: look the A end up in
B, the B end found in A, and so on until they meet.  Both halves go on; an interval without a cut is a
leaf, and the tokens between two cuts are a group.  All intervals of a batch are divided together, a
level at a time, so that the depth is the logarithm of the longest text and no token is passed twice.

A link is a pair of token occurrences that end together.  Two such tokens are suffixes of one another,
so the id pairs that can occur at all follow from the vocabularies: ``linkable`` lists them, some
hundred thousand, whatever the corpus.  Counts are arrays over that list, and that list bounds what is
collected and broadcast.

Texts that are null, empty, or whose tokens do not spell them byte for byte have no tokens: all numbers
are zero and the digest is ''.  Repeated rows count each; an empty table gives no rows; a very long text
is one interval more to divide.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import byte_bpe, piece_bpe, slices


class Pair:
    """Both vocabularies in a worker: bytes, lengths, id strings and the linkable id pairs."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path, plain_specials=True), piece_bpe(b_path)
        self.bytes = [self._table(x.bytes_of) for x in (self.a, self.b)]
        self.sizes = [np.array([len(x) for x in t]) for t in self.bytes]
        self.width = max(len(t) for t in self.bytes)
        # Each id in decimal with each sign that may follow it, in rows of one width.
        told = np.array([b"%d" % i + sign for sign in (b",", b"|", b";", b"") for i in range(self.width)])
        self.text = told.view(np.uint8).reshape(len(told), -1)
        self.told = np.char.str_len(told)
        self.linkable = linkable(self.a.bytes_of, self.b.bytes_of, self.width)

    @staticmethod
    def _table(of: dict[int, bytes]) -> list[bytes]:
        return [of.get(i, b"") for i in range(max(of) + 1)]

    def spell(self, side: int, ids: list[int]) -> bytes:
        table = self.bytes[side]
        return b"".join([table[i] for i in ids])


def linkable(a: dict[int, bytes], b: dict[int, bytes], width: int) -> np.ndarray:
    """Sorted codes a * width + b of the id pairs whose bytes are suffixes of one another: at most as many
    as both vocabularies have bytes, for each way to write a suffix."""
    found: set[int] = set()
    of = [defaultdict(list), defaultdict(list)]
    for side, table in enumerate((a, b)):
        for i, x in table.items():
            of[side][x].append(i)
    for i, x in a.items():
        found.update(i * width + j for k in range(len(x)) for j in of[1].get(x[k:], ()))
    for j, x in b.items():
        found.update(i * width + j for k in range(len(x)) for i in of[0].get(x[k:], ()))
    return np.array(sorted(found), dtype=np.int64)


_loaded: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One per Python process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path)
    return _loaded[a_path, b_path]


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in ``a`` of its values that ``b`` has too, inside the intervals [first, last) of ``a``.

    ``a`` and ``b`` ascend strictly.  Divide and conquer: the common value nearest above the middle is
    found by bisecting one list for a value of the other in turn; what lies between the middle and that
    value has none and is not looked at again.
    """
    cuts = [np.zeros(0, dtype=np.int64)]
    lo, hi = first.astype(np.int64), last.astype(np.int64)
    live = lo < hi
    lo, hi = lo[live], hi[live]
    while len(lo):
        middle = (lo + hi) // 2
        at, found = middle.copy(), np.zeros(len(lo), dtype=bool)
        open_ = np.arange(len(lo))
        while len(open_):
            value = a[at[open_]]
            above = np.searchsorted(b, value)
            over = above >= len(b)
            other = b[np.where(over, 0, above)]
            met = ~over & (other == value)
            found[open_[met]] = True
            on = open_[~met & ~over]
            at[open_[over]] = hi[open_[over]]
            at[on] = np.searchsorted(a, other[~met & ~over])
            open_ = on[at[on] < hi[on]]
        cuts.append(at[found])
        # Both halves side by side: bisection for ascending values stays in near memory.
        halves = np.stack([np.stack([lo, middle], 1), np.stack([np.where(found, at + 1, hi), hi], 1)], 1).reshape(-1, 2)
        halves = halves[halves[:, 0] < halves[:, 1]]
        lo, hi = halves[:, 0], halves[:, 1]
    return np.sort(np.concatenate(cuts))


class Aligned:
    """Groups of a batch of texts.  Arrays over all texts in a row; ``*_at`` are the texts' offsets."""

    def __init__(self, both: Pair, texts: list[str | None]):
        spaced = [" " + t if t else "" for t in texts]
        a_ids = [both.a.ids(t) if t else [] for t in spaced]
        b_ids = [both.b.ids(t or "") for t in texts]
        for k, t in enumerate(spaced):
            raw = t.encode()
            if not t or both.spell(0, a_ids[k]) != raw or both.spell(1, b_ids[k].tolist()) != raw:
                a_ids[k], b_ids[k] = [], np.zeros(0, dtype=np.int64)
        self.a, self.a_at = self._flat(a_ids)
        self.b, self.b_at = self._flat(b_ids)
        ends_a, ends_b = np.cumsum(both.sizes[0][self.a]), np.cumsum(both.sizes[1][self.b])
        # A text's last tokens end together; what is left to find lies before them.
        full = np.flatnonzero(np.diff(self.a_at))
        inner = shared_cuts(ends_a, ends_b, self.a_at[full], self.a_at[full + 1] - 1)
        self.a_cut = np.sort(np.concatenate([inner, self.a_at[full + 1] - 1]))
        self.b_cut = np.searchsorted(ends_b, ends_a[self.a_cut])
        self.cut_at = np.searchsorted(self.a_cut, self.a_at)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in ids] or [np.zeros(0, dtype=np.int64)]), at

    def digests(self, both: Pair) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` for each text, '' for a text without tokens."""
        groups = len(self.a_cut)
        a_first, b_first = np.r_[0, self.a_cut + 1], np.r_[0, self.b_cut + 1]
        a_group, b_group = np.repeat(np.arange(groups), np.diff(a_first)), np.repeat(np.arange(groups), np.diff(b_first))
        a_sign, b_sign = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        a_sign[self.a_cut], b_sign[self.b_cut] = 1, 2
        b_sign[self.b_at[1:][np.diff(self.b_at) > 0] - 1] = 3
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        code[np.arange(len(self.a)) + b_first[a_group]] = self.a + a_sign * both.width
        code[np.arange(len(self.b)) + a_first[b_group + 1]] = self.b + b_sign * both.width
        whole = both.text[code].tobytes().translate(None, b"\0")
        at = np.r_[0, np.cumsum(both.told[code])][self.a_at + self.b_at].tolist()
        return [hashlib.sha256(whole[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def _rows(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary column with the bytes of each row's values."""
    flat = np.ascontiguousarray(values, dtype="<i4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat)])


def alignment(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """Stored table, a row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``,
    the places of its linked id pairs in the list of linkable pairs (binary, int32).

    ``groups`` adds the alignment itself as binaries of int32: a_ids, b_ids, and a_end, b_end, the number
    of tokens up to the end of each group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                x = Aligned(both, texts[lo:hi].to_pylist())
                which, code = pd.factorize(x.a[x.a_cut] * both.width + x.b[x.b_cut])
                n = np.diff(x.cut_at)
                cols = {
                    "doc_id": batch.column("doc_id")[lo:hi],
                    "n_a": pa.array(np.diff(x.a_at)),
                    "n_b": pa.array(np.diff(x.b_at)),
                    "n_groups": pa.array(n),
                    "n_links": pa.array(n),
                    "groups_sha256": pa.array(x.digests(both), pa.string()),
                    "links": _rows(x.cut_at, np.searchsorted(both.linkable, code)[which]),
                }
                if groups:
                    cols |= {
                        "a_ids": _rows(x.a_at, x.a),
                        "b_ids": _rows(x.b_at, x.b),
                        "a_end": _rows(x.cut_at, x.a_cut + 1 - np.repeat(x.a_at[:-1], n)),
                        "b_end": _rows(x.cut_at, x.b_cut + 1 - np.repeat(x.b_at[:-1], n)),
                    }
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    if groups:
        schema += ", a_ids binary, b_ids binary, a_end binary, b_end binary"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(run, schema), "alignment")


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(links of all rows, number in each row)."""
    n = np.array([len(x) // 4 for x in column.to_pylist()], dtype=np.int64) if len(column) else np.zeros(0, dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").astype(np.int64), n


def link_counts(aligned: DataFrame, pairs: int) -> DataFrame:
    """(pair, n): how many links of the corpus hold each linkable pair.  A task counts its rows in one
    array and emits the pairs it met; the sums of tasks meet by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_links(batch.column("links"))[0], minlength=pairs)
        met = np.flatnonzero(total)
        for k in range(0, len(met), 100_000):
            part = met[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def token_map(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n): linked ids of both vocabularies with their links over the corpus."""
    both = pair(a_path, b_path)
    spark = docs.sparkSession
    codes = spark.createDataFrame(pa.table({"pair": np.arange(len(both.linkable)), "a_id": both.linkable // both.width, "b_id": both.linkable % both.width}))
    counts = link_counts(alignment(docs, a_path, b_path, groups=False), len(both.linkable))
    return counts.join(codes, "pair").select("a_id", "b_id", "n")


def op11(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    both = pair(a_path, b_path)
    pairs, second = len(both.linkable), both.linkable % both.width
    aligned = alignment(docs, a_path, b_path, groups=False)
    counted = link_counts(aligned, pairs).toPandas()  # at most ``pairs`` rows
    count = np.zeros(pairs, dtype=np.int64)
    count[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    highest = np.zeros(both.width, dtype=np.int64)
    np.maximum.at(highest, second, count)
    tables = spark.sparkContext.broadcast((count, count == highest[second]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best = tables.value
        for batch in batches:
            links, n = _links(batch.column("links"))
            row = np.repeat(np.arange(len(n)), n)
            sums = np.zeros(len(n), dtype=np.int64)
            np.add.at(sums, row, of[links])
            top = np.bincount(row[best[links]], minlength=len(n))
            new = {"n_best": pa.array(top.astype(np.int64)), "count_sum": pa.array(sums)}
            yield pa.RecordBatch.from_pydict({c: new[c] if c in new else batch.column(c) for c in names})

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
