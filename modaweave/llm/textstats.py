"""Statistics of whole texts, for the quality operators.  One pass; work is linear in the text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, bounded_sample, held_out

_symbols = re.compile(r"[#*$%&|<>]").findall
_digits = re.compile(r"[0-9]").findall
_marks = re.compile(r"[!?]{2,}").findall

def _changed(a: str, b: str) -> int:
    """Characters that lower-casing changed."""
    if a == b:
        return 0
    if len(a) != len(b):
        return sum(c.isupper() for c in a)
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in (a, b))
    return int((x != y).sum())


COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_share", "upper_share", "mark_share", "digit_share", "same_word_share", "distinct_share", "dup_line_share", "repeat_share", "short_word_share", "mean_word", "bar_share", "long_share")


def repeat_words(words: list[str], width: int = 8) -> tuple[int, np.ndarray]:
    """Words that stand in a ``width``-word window found twice or more (the first included), and
    the words' ids in order of first sight."""
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    n = len(seq) - width + 1
    if n < 2 or len(ids) == len(seq):
        return 0, seq
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + seq[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0, seq
    # Equal hashes are only candidates: the windows themselves decide.
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    windows = np.lib.stride_tricks.sliding_window_view(seq, width)[at].astype(np.int32)
    _, inverse, counts = np.unique(np.ascontiguousarray(windows).view(f"V{4 * width}").ravel(), return_inverse=True, return_counts=True)
    mark = np.zeros(len(seq) + 1, dtype=np.int64)
    hit = at[counts[inverse] > 1]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + width, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum()), seq


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, RATIOS) of one text; a null or empty text gives zeros."""
    t = text or ""
    words = WORDS(t)
    n = len(words)
    if not n:
        return [len(t), 0, 0, len(_symbols(t)), 0, 0, 0], [0.0] * len(RATIOS)
    chars = sum(map(len, words))
    symbols = len(_symbols(t))
    lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeated, seq = repeat_words(words)
    counts = [len(t), n, chars, symbols, len(lines), dup, repeated]
    ratios = [
        symbols / chars,
        _changed(t, t.lower()) / chars,
        len(_marks(t)) / n,
        len(_digits(t)) / chars,
        float((seq[1:] == seq[:-1]).mean()) if n > 1 else 0.0,
        (int(seq.max()) + 1) / n,
        dup / len(lines),
        repeated / n,
        sum(len(w) < 3 for w in words) / n,
        min(chars / n, 20.0) / 20.0,
        t.count("|") / n,
        sum(len(w) > 25 for w in words) / n,
    ]
    return counts, ratios


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stats_column(text: pd.Series) -> pd.Series:
    return pd.Series([[float(x) for x in c] + r for c, r in map(text_stats, text)])


def stat(name: str, column: str = "_stats") -> Column:
    """One statistic out of the array that ``stats_column`` gives."""
    return F.col(column)[(COUNTS + RATIOS).index(name)]


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, _y): all labels 0 or 1 outside the held-out fold."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_y"))
    return rows.filter(F.col("_y").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 5) -> pd.DataFrame:
    """Statistics of about ``most`` labelled documents of either class (doc_id, y, COUNTS, RATIOS).

    A bounded training sample.  Labels are taken by a hash of their id from all those outside the
    held-out fold, few enough to be broadcast; where an id stands for many documents, a hash of id and
    text bounds the documents too, and equal rows count once.
    """
    chosen = bounded_sample(known_labels(labels, label).distinct(), "doc_id", most, "_y", seed)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = bounded_sample(texts, ["doc_id", "text"], most, "_y", seed + 1)
    out = texts.select("doc_id", "_y", stats_column("text").alias("_s")).toPandas()
    x = pd.DataFrame(np.array(out["_s"].tolist()).reshape(len(out), len(COUNTS + RATIOS)), columns=COUNTS + RATIOS)
    return pd.concat([out[["doc_id", "_y"]].rename(columns={"_y": "y"}), x], axis=1).sort_values(["doc_id", "y", *RATIOS], ignore_index=True)
