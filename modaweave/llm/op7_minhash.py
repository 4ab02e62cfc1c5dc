"""Near-duplicates by b-bit MinHash.

Signature: 128 minima over a document's shingle hashes.  Five minima make a band key; only the low
four bits of each minimum are kept, packed in 64 bytes.  Documents that share a band key are
compared by bit counts: the share of equal low bits, corrected for chance collisions, estimates the
similarity.  Pairs whose estimate is not clearly too low are confirmed on their full shingle sets.

No group's pairs are all emitted.  Documents with equal sets collapse first.  Round one links a
bucket, in blocks of bounded size, to its best neighbours and to a few leaders that cover it.  Round
two compares only across what is still unlinked: documents outside a bucket's largest component
with all of that bucket, block by block.  So every pair that shares a band key and whose estimate is
high enough is either confirmed, refuted, or already joined through others.

A document without words or text has no shingles and is linked with nothing; one with fewer words
than a shingle has its whole sequence as the only one.  Repeated rows are one class and share a
component.  Ties have no effect, empty tables give empty results, whole texts are used, and columns
of other names are ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, mix64, stored

PERMUTATIONS, BAND, LOW_BITS = 128, 5, 4
BANDS = PERMUTATIONS // BAND
BLOCK = 1024
#: How far below the threshold an estimate may lie: over four standard deviations.
SLACK = 0.15

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPOTS = np.uint64(0x1111111111111111)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    s = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        s = mix64(s * _STEP + h[k : k + n])
    return np.unique(s)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def packed(least: np.ndarray) -> bytes:
    """The low bits of the minima, 16 to a 64-bit word."""
    low = (least & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64).reshape(-1, 64 // LOW_BITS)
    return (low << (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=1, dtype=np.uint64).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    m = least[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        key = mix64(key * _STEP + m[:, k])
    return key.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every signature of ``a`` with every one of ``b``, corrected for the 1 in
    2**LOW_BITS chance that different minima agree in their low bits."""
    differ = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & _SPOTS)
    chance = 1 / (1 << LOW_BITS)
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """Stored: _r, doc_id, n_shingles, digest, sig, bands for stored rows (_r, doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"n_shingles": [], "digest": [], "sig": [], "bands": []}
            for t in pdf["text"]:
                s = shingle_hashes(t, width)
                least = minima(s) if len(s) else None
                out["n_shingles"].append(len(s))
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["sig"].append(packed(least) if len(s) else None)
                out["bands"].append(band_keys(least) if len(s) else None)
            yield pd.DataFrame({"_r": pdf["_r"], "doc_id": pdf["doc_id"].astype("Int64")} | out)

    return stored(rows.mapInPandas(run, "_r long, doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "minhash-signatures")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from sorted batches; a run may span batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        k = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield pdf.iloc[i:j]
        rest = pdf.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _signature_rows(g: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(g["sig"]), dtype=np.uint64).reshape(len(g), -1)


def _alike(n1: np.ndarray, n2: np.ndarray, est: np.ndarray, share: float) -> np.ndarray:
    """Pairs that the sizes allow and the estimate does not rule out."""
    ratio = np.minimum(n1[:, None], n2[None, :]) >= share * np.maximum(n1[:, None], n2[None, :]) - 1e-9
    return ratio & (est >= share - SLACK)


def _as_pairs(chunks: list[np.ndarray]) -> pd.DataFrame:
    p = np.concatenate(chunks) if chunks else np.zeros((0, 2), dtype=np.int64)
    p.sort(axis=1)
    p = np.unique(p, axis=0)
    return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})


def _flushed(found: Iterator[np.ndarray], most: int = 50_000) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x)
        if n >= most:
            yield _as_pairs(held)
            held, n = [], 0
    yield _as_pairs(held)


def _first_round(share: float, leaders: int = 8):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for g in _groups(batches, ["key", "block"]):
            if len(g) < 2:
                continue
            ids, n, sig = g["cid"].to_numpy(), g["n_shingles"].to_numpy(), _signature_rows(g)
            est = estimated(sig, sig)
            ok = _alike(n, n, est, share)
            np.fill_diagonal(ok, False)
            if len(g) <= 4:
                i, j = np.nonzero(np.triu(ok))
                yield np.stack([ids[i], ids[j]], axis=1)
                continue
            rows = np.flatnonzero(ok.any(axis=1))
            best = np.where(ok, est, -1.0).argmax(axis=1)
            yield np.stack([ids[rows], ids[best[rows]]], axis=1)
            open_ = ok.any(axis=1)
            for _ in range(leaders):
                gain = (ok & open_[None, :]).sum(axis=1)
                lead = int(gain.argmax())
                hit = ok[lead] & open_
                if hit.sum() < 2:
                    break
                yield np.stack([np.full(hit.sum(), ids[lead]), ids[hit]], axis=1)
                open_ &= ~hit
                open_[lead] = False

    return lambda batches: _flushed(pairs(batches))


def _shared(sets: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """How many of ``q``'s shingles each set holds."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(q, every), len(q) - 1)
    return np.bincount(owner[q[at] == every], minlength=len(sets))


def _second_round(width: int, similarity: tuple[int, int]):
    """Links (component, component) between what a block's askers and its other documents are in.

    A pair is confirmed where it stands: in the first bucket that both documents are in."""
    num, den = similarity

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for g in _groups(batches, ["key", "left", "block"]):
            asks = np.flatnonzero(g["asks"].to_numpy())
            if not len(asks) or len(g) < 2:
                continue
            n, sig, comp, cid = g["n_shingles"].to_numpy(), _signature_rows(g), g["comp"].to_numpy(), g["cid"].to_numpy()
            ok = _alike(n[asks], n, estimated(sig[asks], sig), num / den)
            ok &= comp[asks][:, None] != comp[None, :]
            ok &= ~g["asks"].to_numpy()[None, :] | (cid[asks][:, None] < cid[None, :])
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            bands = np.array(g["bands"].tolist())
            first = np.argmax(bands[asks[i]] == bands[j], axis=1)
            here = bands[j, first] == g["key"].iloc[0]
            texts, sets = g["_text"].to_numpy(), {}
            i, j = i[here], j[here]
            for k in np.unique(i):
                with_ = j[i == k]
                for m in (asks[k], *with_):
                    if m not in sets:
                        sets[m] = shingle_hashes(texts[m], width)
                own = sets[asks[k]]
                both = _shared([sets[m] for m in with_], own)
                hit = with_[den * both >= num * (len(own) + n[with_] - both)]
                if len(hit):
                    yield np.stack([np.full(len(hit), comp[asks[k]]), comp[hit]], axis=1)

    return lambda batches: _flushed(links(batches))


def _confirm(width: int, similarity: tuple[int, int]):
    num, den = similarity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[int, np.ndarray] = {}

            def of(r: int, t: str) -> np.ndarray:
                if r not in seen:
                    seen[r] = shingle_hashes(t, width)
                return seen[r]

            keep = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["_ta"], pdf["_tb"], strict=True):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return run


@contextmanager
def _bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Let Spark filter the large side of a join by a Bloom filter (of bounded size) of the other."""
    wished = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k, None) for k in wished}
    for k, v in wished.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def near_duplicates(rows: DataFrame, width: int = 3, similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, _r for stored rows (_r, doc_id, text).

    ``similarity`` is a fraction (numerator, denominator) of shared over all shingles, inclusive.
    """
    share = similarity[0] / similarity[1]
    sigs = signatures(rows, width)
    classes = stored(sigs.filter("n_shingles > 0").groupBy("digest").agg(F.min("_r").alias("cid"), F.min("doc_id").alias("least")), "minhash-classes")
    reps = sigs.join(classes.select("cid"), sigs._r == F.col("cid"), "left_semi").select(F.col("_r").alias("cid"), "n_shingles", "sig", "bands")
    keyed = reps.select("cid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(keyed.join(shared, "key").join(reps.select("cid", "n_shingles", "sig"), "cid"), "minhash-members")
    with _bloom_filters(rows.sparkSession):
        wanted = rows.join(members.filter("size > 1").select(F.col("cid").alias("_c")), F.col("_r") == F.col("_c"), "left_semi")
        texts = stored(wanted.select(F.col("_r").alias("_t"), F.col("text").alias("_text")), "minhash-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("_t").alias(f"_i{k}"), F.col("_text").alias(f"_t{k}")) for k in "ab")
        both = pairs.join(left, pairs.a == left._ia).drop("_ia").join(right, F.col("b") == right._ib).select("a", "b", "_ta", "_tb")
        return stored(both.mapInPandas(_confirm(width, similarity), "a long, b long"), "minhash-links")

    block = F.pmod(F.xxhash64("cid", "key"), F.ceil(F.col("size") / F.lit(BLOCK)))
    blocks = members.withColumn("block", block)
    first = blocks.repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "cid", "n_shingles", "sig")
    links = confirmed(stored(first.mapInPandas(_first_round(share), "a long, b long").distinct(), "minhash-pairs"))
    comp = components(links)

    linked = blocks.join(comp, F.col("cid") == F.col("node"), "left").select(*blocks.columns, F.coalesce("component", "cid").alias("comp"))
    linked = stored(linked.drop("sig", "n_shingles", "size"), "minhash-linked")
    parts = linked.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("k", "comp")).alias("main")).filter("parts > 1").drop("parts")
    open_ = stored(linked.join(main, "key").withColumn("asks", F.col("comp") != F.col("main")).drop("main"), "minhash-open")
    # A block meets the askers of its own and of every other block of its bucket.
    asking = open_.filter("asks").select("key", F.col("block").alias("left")).distinct()
    facing = open_.join(asking, "key").withColumn("asks", F.col("asks") & (F.col("block") == F.col("left")))
    others = open_.select("key", F.col("block").alias("other")).distinct()
    guests = open_.filter("asks").withColumn("left", F.col("block")).join(others, "key").filter("other <> block").withColumn("block", F.col("other"))
    cols = ["key", "left", "block", "cid", "comp", "asks"]
    carried = reps.select(F.col("cid").alias("_c"), "n_shingles", "sig", "bands").join(texts, F.col("_c") == texts._t).drop("_t")
    met = facing.select(*cols).union(guests.select(*cols)).join(carried, F.col("cid") == F.col("_c")).drop("_c")
    met = met.repartition("key", "left", "block").sortWithinPartitions("key", "left", "block")
    more = stored(met.mapInPandas(_second_round(width, similarity), "a long, b long"), "minhash-links")
    # Round two only has to join the components that round one left apart.
    upper = components(more).select(F.col("node").alias("_m"), F.col("component").alias("_top"))
    named = classes.join(comp, classes.cid == comp.node, "left").select("digest", "least", F.coalesce("component", "cid").alias("comp"))
    named = cut_lineage(named.join(upper, named.comp == upper._m, "left").select("digest", "least", F.coalesce("_top", "comp").alias("comp")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = named.join(least, "comp").select(F.col("digest").alias("_d"), "component_id")
    out = sigs.select("_r", "doc_id", "n_shingles", "digest")
    return out.join(final, out.digest == final._d, "left").select("_r", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7(docs: DataFrame, **settings) -> DataFrame:
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_r", F.monotonically_increasing_id()), "minhash-rows")
    out = near_duplicates(rows.select("_r", "doc_id", "text"), **settings)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The first row of each group of near copies, with the columns it came with."""
    keyed = stored(docs.withColumn("_dup_row", F.monotonically_increasing_id()), "minhash-rows")
    rows = keyed.select(F.col("_dup_row").alias("_r"), F.col("_dup_row").alias("doc_id"), "text")
    kept = near_duplicates(rows, **settings).filter("doc_id = component_id").select(F.col("_r").alias("_dup_kept"))
    return keyed.join(kept, keyed._dup_row == kept._dup_kept, "left_semi").select(*[keyed[c] for c in docs.columns])
