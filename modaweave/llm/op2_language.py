"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text.  A document, its words in
lower case without what stands between them, is encoded in blocks with every dictionary; the language whose dictionary gives
the fewest bytes wins.  Dictionaries keep all their text; where one is smaller than the best one's by
more than an eighth, the two are compared with the larger cut to its size.  A narrow margin over the runner-up is rejected: ``accepted`` is false.

All of a text is encoded; blocks keep the dictionary in play for very long ones.  A text that is
null or has no letter is ``und`` with score 0 and not accepted.  Ties go to the language with more
training rows, then by name.  Without any labelled text every document is ``und``.  Repeated rows
are judged one by one, empty tables give empty results, all columns of the input are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_small, cut_lineage
from .common import bounded_sample, held_out

BLOCK = 2048
#: Dictionaries are never cut below this for a comparison: a handful of words says nothing.
LEAST = 1 << 14
_other = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Words of letters in lower case; a word that follows itself at once counts once."""
    words = _other.sub(" ", text.lower()).split() if text else []
    return " ".join([w for w, before in zip(words, ["", *words], strict=False) if w != before])


def dictionaries(docs: DataFrame, most: int = 1500, size: int = 1 << 18, seed: int = 2, total: int = 1 << 26) -> dict[str, bytes]:
    """Language to dictionary, in order of training rows.

    About ``most`` labelled documents a language, a piece of each at a place its hash chooses, as long as
    lets all of them fill ``size`` bytes (``BLOCK`` characters at most); whole pieces fill them.  All
    dictionaries take ``total`` bytes at most: with very many languages each gets less, none is left out.
    All bound the training sample only.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("n")))
    order = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").collect()]
    size = max(1, min(size, total // max(1, len(order))))
    most = max(1, min(most, size // 32))
    pieces = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(BLOCK), F.lit(size) / F.least(F.lit(most), F.col("n"))).cast("int").alias("_piece"))
    chosen = bounded_sample(known, ["doc_id", "text"], most, "lang", seed).join(broadcast_small(pieces), F.col("lang") == F.col("_lang"))
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.greatest(F.length("text") - F.col("_piece") + 1, F.lit(1))) + 1
    chosen = chosen.select("lang", F.xxhash64("doc_id", "text").alias("k"), F.substring("text", at.cast("int"), F.col("_piece")).alias("t"))
    held: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"], r["t"])):
        p = letters(r["t"]).encode()
        if p:
            held.setdefault(r["lang"], []).append(p)
    out: dict[str, bytes] = {}
    for lang in order:
        room, parts = size, []
        for p in held.get(lang, []):
            if len(p) + 1 > room:
                break
            parts.append(p)
            room -= len(p) + 1
        out[lang] = b" ".join(parts)
    return {k: v for k, v in out.items() if v}


def _encoder(data: bytes, level: int) -> Callable[[bytes], int]:
    import zstandard

    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return lambda b: len(c.compress(b))


def _blocks(text: str) -> list[bytes]:
    b = text.encode("utf-8", "replace")
    return [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]


class Encoders:
    """Encoded sizes of blocks by language, with its whole dictionary or its last ``size`` bytes."""

    def __init__(self, dicts: list[bytes], level: int, most: int = 64) -> None:
        self.sizes = [len(d) for d in dicts]
        self.order = sorted(range(len(dicts)), key=lambda k: -self.sizes[k])
        self.whole = [_encoder(d, level) for d in dicts]
        self.cut = lru_cache(most)(lambda k, size: _encoder(dicts[k][-size:], level))

    def even(self, a: int, b: int) -> int | None:
        """The size at which languages a and b are compared; None if both as they are."""
        small, large = sorted((max(self.sizes[a], LEAST), max(self.sizes[b], LEAST)))
        return None if 8 * small >= 7 * large else small


def compared(blocks: list[bytes], encoders: Encoders) -> tuple[int, np.ndarray]:
    """(best language, lead over every language as a share), each pair at an even size.

    A larger dictionary finds more matches in any language, so languages
    come in with the most text first, and a later one wins only if it is better than every one before
    it, cut to its size.  A language with little text so changes no verdict but those it wins.
    """
    whole = np.array([sum(map(e, blocks)) for e in encoders.whole], dtype=np.float64)

    @cache
    def at(k: int, size: int | None) -> float:
        return whole[k] if size is None or encoders.sizes[k] <= size else float(sum(map(encoders.cut(k, size), blocks)))

    def lead(a: int, b: int) -> float:
        size = encoders.even(a, b)
        return at(b, size) / at(a, size) - 1

    best, *others = encoders.order
    seen = [best]
    for k in others:
        if all(lead(k, b) > 0 or (lead(k, b) == 0 and k < b) for b in [best, *seen]):
            best = k
        seen.append(k)
    return best, np.array([lead(best, k) for k in range(len(whole))])


def identify(texts: list[str | None], names: list[str], encoders: Encoders, narrow: float) -> Iterator[tuple[str, float, bool]]:
    for t in texts:
        plain = letters(t)
        if not names or not any(c.isalpha() for c in plain):
            yield "und", 0.0, False
            continue
        best, lead = compared(_blocks(plain), encoders)
        rest = np.delete(lead, best)
        share = max(0.0, float(rest.min())) if len(rest) else 1.0
        yield names[best], float(1 - np.exp(-20 * share)), bool(share >= narrow)


def with_language(docs: DataFrame, dicts: dict[str, bytes], level: int = 3, narrow: float = 0.02) -> DataFrame:
    """All documents with a struct ``_lang`` of lang_pred, score and accepted."""
    names = list(dicts)
    data = docs.sparkSession.sparkContext.broadcast(list(dicts.values()))  # ``size`` bytes a language at most

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = Encoders(data.value, level)
        for s in batches:
            yield pd.DataFrame(list(identify(s.tolist(), names, encoders, narrow)), columns=["lang_pred", "score", "accepted"])

    return docs.withColumn("_lang", predict("text"))


def op2(docs: DataFrame, **settings) -> DataFrame:
    out = with_language(docs.select("doc_id", "text"), dictionaries(docs, **settings))
    return out.select("doc_id", held_out().alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.accepted")
