"""Vocabularies, token encoding, masking, context tokens and hashed fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_slot, seeded_key
from ..functions.vectors import let
from ..session import cut_lineage, planned_bytes
from .ranking import ordered_rank

PAD, OTHER = 0, 1
SPECIALS = ("<pad>", "<other>")
BROADCAST_TOKENS = 500_000


def words(text: str | Column) -> Column:
    """Lower-cased words, split at single spaces; empty pieces dropped."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(text), " "), "")


def token_counts(df: DataFrame, tokens: str | Column) -> DataFrame:
    """(token, n); counted on the map side first, so a frequent token is one row per task."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocab(counts: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """(token, token_id, n) by falling count then token; ids start after the special tokens."""
    kept = counts.filter((F.col("n") >= min_freq) & ~F.col("token").isin(*SPECIALS))
    ranked = ordered_rank(kept, [F.desc("n"), F.asc("token")], name="_r")
    if max_size is not None:
        ranked = ranked.filter(F.col("_r") <= max_size)
    body = ranked.select("token", (F.col("_r") + len(SPECIALS) - 1).cast("bigint").alias("token_id"), "n")
    head = counts.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, token_id bigint, n bigint")
    return head.unionByName(body)


def extend_vocab(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Add counts of ``extra``; tokens unseen in ``base`` are numbered after it, in their own order."""
    shared = base.join(extra.select("token", F.col("n").alias("_m")), "token", "left").select(
        "token", "token_id", (F.col("n") + F.coalesce("_m", F.lit(0))).alias("n")
    )
    new = extra.join(base, "token", "left_anti")
    top = base.agg(F.max("token_id"))
    added = ordered_rank(new, ["token_id", "token"], name="_r").select("token", (F.col("_r") + top.scalar()).alias("token_id"), "n")
    return shared.unionByName(added)


def encode(df: DataFrame, tokens: str, vocab: DataFrame, id_col: str = "id", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(id, token_ids, length); unknown tokens get the id of ``<other>``.

    The ``broadcast_tokens`` tokens that come most often are a broadcast lookup, and where the vocabulary
    holds no more, nothing is shuffled.  Of a larger one only the other, rare tokens are joined and put
    back at their positions.
    """
    common = vocab.select("token", "token_id").orderBy("token_id").limit(broadcast_tokens + 1).collect()  # ids fall with the count
    whole = len(common) <= broadcast_tokens
    table = {r["token"]: r["token_id"] for r in common[:broadcast_tokens]}
    shared = df.sparkSession.sparkContext.broadcast(table)
    length = F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0)).alias("length")
    if whole:

        @F.pandas_udf("array<bigint>")
        def look_up(seqs: pd.Series) -> pd.Series:
            get = shared.value.get
            return pd.Series([[get(t, OTHER) for t in (() if s is None else s)] for s in seqs], dtype=object)

        return df.select(id_col, look_up(tokens).alias("token_ids"), length)

    @F.pandas_udf("array<bigint>")
    def common_ids(seqs: pd.Series) -> pd.Series:
        get = shared.value.get
        return pd.Series([[get(t, -1) for t in (() if s is None else s)] for s in seqs], dtype=object)

    # Rows are told apart by their place in the written table, so ids may repeat.
    rare = F.filter(F.transform("_ids", lambda c, i: F.when(c < 0, F.struct(i.alias("at"), F.get(F.col(tokens), i).alias("token")))), lambda x: x.isNotNull())
    coded = df.select(id_col, tokens, length, common_ids(tokens).alias("_ids"), F.monotonically_increasing_id().alias("_row"))
    held = cut_lineage(coded.select(id_col, "length", "_ids", rare.alias("_rare"), "_row"))
    cells = held.select("_row", F.explode("_rare").alias("_c")).select("_row", "_c.at", "_c.token")
    code = F.struct("at", F.col("token_id").alias("code"))
    found = cells.join(vocab.select("token", "token_id"), "token").groupBy("_row").agg(F.collect_list(code).alias("_f"))
    found = found.select("_row", F.col("_f.at").alias("_at"), F.col("_f.code").alias("_code"))

    @F.pandas_udf("array<bigint>")
    def put_back(ids: pd.Series, at: pd.Series, code: pd.Series) -> pd.Series:
        out = []
        for s, where, what in zip(ids, at, code, strict=True):
            s = np.array(s, dtype="int64")
            if where is not None:
                s[where] = what
            s[s < 0] = OTHER
            out.append(s)
        return pd.Series(out, dtype=object)

    return held.select(id_col, "length", "_ids", "_row").join(found, "_row", "left").select(id_col, put_back("_ids", "_at", "_code").alias("token_ids"), "length")


def mask_labels(df: DataFrame, token_ids: str = "token_ids", id_col: str = "id", share: float = 0.15, seed: int = 42) -> DataFrame:
    """(id, labels): ceil(share * n) seeded positions keep their id as label, the others are 0."""
    key = lambda i: seeded_key(F.concat_ws("#", F.col(id_col).cast("string"), i.cast("string")), seed)
    shuffled = F.array_sort(F.transform(token_ids, lambda t, i: F.struct(key(i).alias("h"), i.alias("i"), t.alias("t"))))
    n_mask = F.ceil(F.round(F.size(token_ids) * share, 9)).cast("int")
    zero = F.lit(0).cast("bigint")
    # The position in the shuffled order decides; sorting by place restores the sequence.
    marked = F.transform(shuffled, lambda s, r: F.struct(s["i"].alias("i"), F.when(r < n_mask, s["t"]).otherwise(zero).alias("t")))
    return df.filter(F.size(token_ids) > 0).select(
        id_col, F.transform(F.array_sort(marked), lambda s: s["t"]).alias("labels"), n_mask.alias("masked")
    )


def context_tokens(df: DataFrame, tokens: str, id_col: str = "id") -> DataFrame:
    """(id, pos, context): each token with its sorted, counted direct neighbours, as in ``b_a1_c1``."""
    gap = F.array(F.lit(None).cast("string"))
    n = F.size(tokens)
    zipped = F.arrays_zip(
        F.col(tokens).alias("token"),
        F.concat(gap, F.slice(tokens, 1, F.greatest(n - 1, F.lit(0)))).alias("l"),
        F.concat(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), gap).alias("r"),
    )
    rows = df.filter(n > 0).select(id_col, F.posexplode(zipped).alias("pos", "_s"))
    rows = rows.select(id_col, "pos", *[F.col("_s")[c].alias(f"_{c}") for c in ("token", "l", "r")])
    one = lambda c: F.concat(F.col(c), F.lit("1"))
    around = (
        F.when(F.col("_l").isNull() & F.col("_r").isNull(), None)
        .when(F.col("_l").isNull(), one("_r"))
        .when(F.col("_r").isNull(), one("_l"))
        .when(F.col("_l") == F.col("_r"), F.concat("_l", F.lit("2")))
        .when(F.col("_l") < F.col("_r"), F.concat_ws("_", one("_l"), one("_r")))
        .otherwise(F.concat_ws("_", one("_r"), one("_l")))
    )
    return rows.select(id_col, "pos", F.concat_ws("_", "_token", around).alias("context"))


def count_rare(df: DataFrame, word: str, chunk_rows: int = 1 << 20) -> DataFrame:
    """(word, n) for words that mostly come once, so that counting them before the shuffle spares few rows.

    A task counts ``chunk_rows`` words at a time and sends those of one slot, a share of all words by hash,
    as one sorted text, which packs well.  The slots grow in number with the input, and each is counted on
    its own, so that nothing outgrows memory.  Words are neither null nor hold a space.
    """
    slots = max(1, min(1 << 15, planned_bytes(df) >> 20))

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).group_by("word", use_threads=False).aggregate([("slot", "min"), ([], "count_all")])
        words, slot = t["word"].combine_chunks(), t["slot_min"].to_numpy().astype("int16")
        if words.null_count or pc.any(pc.match_substring(words, " ")).as_py():
            raise ValueError("words to count must not be null or hold a space")
        order = pc.sort_indices(words).to_numpy()
        order = order[np.argsort(slot[order], kind="stable")]
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        edges = pa.array(np.r_[first, len(slot)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(edges, words.take(pa.array(order))), " ")
        n = pa.ListArray.from_arrays(edges, pa.array(t["count_all"].to_numpy()[order]))
        return pa.RecordBatch.from_arrays([pa.array(slot[first].astype("int32")), texts, n], ["slot", "words", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def add(t: pa.Table) -> pa.Table:
        words, n = pc.list_flatten(pc.split_pattern(t["words"], " ")), pc.list_flatten(t["n"])
        total = pa.table({"word": words, "n": n}).group_by("word", use_threads=False).aggregate([("n", "sum")]).sort_by("word")
        return pa.table({word: total["word"], "n": total["n_sum"]})

    slot = F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")
    sent = df.select(slot.alias("slot"), F.col(word).alias("word")).mapInArrow(pack, "slot int, words string, n array<bigint>")
    return sent.groupBy("slot").applyInArrow(add, f"`{word}` string, n bigint")


def pattern_flags(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """One 0/1 column per named regular expression."""
    return df.withColumns({name: F.col(text).rlike(rx).cast("int") for name, rx in patterns.items()})


def shingles(tokens: str | Column, n: int = 2) -> Column:
    """Distinct runs of n tokens; a shorter sequence is one shingle."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    runs = lambda t: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " ")
    )
    return F.array_distinct(let(tokens, runs))


def fingerprint_slots(df: DataFrame, tokens: str, id_col: str = "id", n: int = 2, slots: int = 2048) -> DataFrame:
    """Sparse hashed fingerprint: (id, slot, n) with n the number of shingles that hit the slot."""
    return (
        df.select(id_col, F.explode(shingles(tokens, n)).alias("_s"))
        .select(id_col, hash_slot(F.col("_s"), slots).alias("slot"))
        .groupBy(id_col, "slot")
        .agg(F.count("*").alias("n"))
    )


def fingerprint_bits(tokens: str | Column, n: int = 2, slots: int = 2048) -> Column:
    """Dense bit array of the same fingerprint, computed inside the row."""
    hit = F.array_distinct(F.transform(shingles(tokens, n), lambda s: hash_slot(s, slots).cast("int")))
    return let(hit, lambda h: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.array_contains(h, i).cast("tinyint")))


def masked_mean_pool(df: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """(key, pos, value): mean of the unmasked vectors per position."""
    cells = df.filter(F.col(mask) == 1).select(key, F.posexplode(vec).alias("pos", "v"))
    return cells.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


# -- named feature generators ------------------------------------------------------------------------
GENERATORS: dict[str, Callable[[Column], Column]] = {}


def register_generator(name: str) -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    """Decorator: make a Column-to-Column feature generator available under a name."""

    def add(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
        GENERATORS[name] = fn
        return fn

    return add


def generator(name: str) -> Callable[[Column], Column]:
    if name not in GENERATORS:
        raise ValueError(f"no feature generator {name!r}; known: {sorted(GENERATORS)}")
    return GENERATORS[name]


@register_generator("length")
def _length(text: Column) -> Column:
    return F.array(F.length(text).cast("double"), F.size(words(text)).cast("double"))


@register_generator("character_share")
def _character_share(text: Column) -> Column:
    total = F.greatest(F.length(text), F.lit(1))
    kinds = ("[^a-zA-Z]", "[^0-9]", r"[^\s]")
    return F.array(*[F.length(F.regexp_replace(text, k, "")) / total for k in kinds])


@register_generator("hashed_bits")
def _hashed_bits(text: Column) -> Column:
    return fingerprint_bits(words(text), 2, 64).cast("array<double>")
