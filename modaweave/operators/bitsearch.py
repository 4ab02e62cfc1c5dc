"""Exact nearest fingerprints on packed bits.

Bits are packed into longs, so a shared count is one bit count of an AND per 64 bits.  Rows lie in buckets
by their number of set bits, cut into blocks.  The similarity of two rows is at most the smaller count over
the larger: a first pass over one small block of the nearest counts gives each query a k-th similarity, and a
second visits only counts that can still reach it.  There chunks of queries with one count meet a block in
one task, in tiles that stay in the processor's cache; with both counts fixed a distance within the limit is
a shared count from some number on, so pairs below it end as one comparison, and only each query's k + 1
best leave the task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_small, cut_lineage
from .neighbours import _first_of_rows
from .ranking import top_per_group

BLOCK_ROWS = 256
#: Rows of a chunk of queries and of a block in the second pass, and of a tile of their pairs.
CHUNK_ROWS = 32768
TILE_ROWS, TILE_COLUMNS = 64, 4096


def packed(bits: str | Column, width: int) -> Column:
    """array<bigint>: bit i of the array is bit i % 64 of word i // 64."""
    b = F.col(bits) if isinstance(bits, str) else bits

    def word(w: int) -> Column:
        part = F.slice(b, 64 * w + 1, min(64, width - 64 * w))
        places = F.transform(part, lambda x, i: F.when(x.cast("int") != 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))

    return F.array(*[word(w) for w in range(-(-width // 64))])


def set_bits(words: str | Column) -> Column:
    w = F.col(words) if isinstance(words, str) else words
    return F.aggregate(w, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def shared_bits(a: str, b: str, words: int) -> Column:
    """Set bits that two packed columns have in common, unrolled."""
    parts = [F.bit_count(F.col(a)[i].bitwiseAND(F.col(b)[i])) for i in range(words)]
    return reduce(lambda x, y: x + y, parts)


def _nearest_in_block(q: np.ndarray, n: int, limit: np.ndarray, ids: np.ndarray, block: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): the first k rows of a block within each query's limit, by distance and row.

    ``q`` and ``block`` are unsigned words of rows with ``n`` and ``m`` set bits, the block in id order."""
    # The distance of every shared count, falling; the least count within a limit.
    shares = np.arange(min(n, m) + 1)
    dist = np.round(1.0 - shares / np.maximum((n + m - shares).astype(float), 1e-8), 12)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), TILE_ROWS):
        x, reach = q[s : s + TILE_ROWS], limit[s : s + TILE_ROWS].copy()
        least = np.searchsorted(-dist, -reach)
        r, c, d = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        for t in range(0, len(block), TILE_COLUMNS):
            y = block[t : t + TILE_COLUMNS]
            both = np.bitwise_count(x[:, None, 0] & y[None, :, 0])
            if x.shape[1] > 1:
                both = both.astype(np.uint32)
                for w in range(1, x.shape[1]):
                    both += np.bitwise_count(x[:, None, w] & y[None, :, w])
            i, j = np.nonzero(both >= least.astype(both.dtype)[:, None])
            if not len(i):
                continue
            r, c, d = _first_of_rows(np.r_[r, i], np.r_[c, j + t], np.r_[d, dist[both[i, j]]], k)
            # A full list admits only nearer rows: later ones have larger ids.
            size = np.bincount(r, minlength=len(x))
            full = size >= k
            worst = np.full(len(x), np.inf)
            worst[r] = d  # rows ascend by distance, so the last stays
            least[full] = np.maximum(least[full], np.searchsorted(-dist, -worst[full], side="right"))
        found.append((r + s, ids[c], d))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), ids[:0], np.zeros(0))


def _second_pass(asked: DataFrame, classes: DataFrame, held: dict[int, int], k: int, kind: str, chunk: int) -> DataFrame:
    """(vid, nid, distance): of every query (vid, words, n, limit), the k best rows of each block of rows
    whose counts are within its reach (low, high)."""
    spark = asked.sparkSession
    parts = broadcast_small(spark.createDataFrame([(n, -(-rows // chunk)) for n, rows in held.items()], "m int, blocks int"))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    queries = asked.join(parts.withColumnRenamed("m", "n"), "n").withColumn("chunk", dealt("vid")).drop("blocks")
    meets = queries.withColumn("m", F.explode(F.sequence("low", F.greatest("low", "high")))).join(parts, "m")
    meets = meets.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("n", "chunk", "m", "block", "vid", "words", "limit")
    # Which chunks of queries a block meets: one row per pair of chunks.
    spans = queries.groupBy("n", "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = broadcast_small(spans.withColumn("m", F.explode(F.sequence("low", F.greatest("low", "high")))).select("n", "chunk", "m"))
    rows = classes.select(F.col("n").alias("m"), F.col("vid").alias("nid"), F.col("words").alias("other")).join(parts, "m").withColumn("block", dealt("nid")).drop("blocks")
    copies = rows.join(spans, "m").select("n", "chunk", "m", "block", "nid", "other")

    def compare(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"vid": [], "nid": [], "distance": []})
        c = c.sort_values("nid")
        x, y = (np.stack([np.asarray(w, dtype=np.int64) for w in side]).view(np.uint64) for side in (q["words"], c["other"]))
        row, nid, distance = _nearest_in_block(x, int(key[0]), q["limit"].to_numpy(dtype=np.float64), c["nid"].to_numpy(), y, int(key[2]), k)
        return pd.DataFrame({"vid": q["vid"].to_numpy()[row], "nid": nid, "distance": distance})

    by = ["n", "chunk", "m", "block"]
    return meets.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(compare, f"vid {kind}, nid {kind}, distance double")


def tanimoto_knn(df: DataFrame, k: int, bits: str = "bits", id_col: str = "id", block: int = BLOCK_ROWS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(query, neighbour, distance, rank) with rank 1..k, ties broken by neighbour id; every row asks about
    the others.  Equal fingerprints are searched once and keep their k + 1 smallest ids.  All rows have one
    width; an empty table gives no rows."""
    rows = df.select(F.col(id_col).alias("id"), F.col(bits).alias("bits"))
    head = rows.select(F.size("bits").alias("w")).first()
    kind = dict(rows.dtypes)["id"]
    if head is None:
        return df.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, distance double, rank int")
    width = head["w"]
    words = -(-width // 64)
    keyed = cut_lineage(rows.select("id", packed("bits", width).alias("words")))
    firsts = top_per_group(keyed, ["words"], [F.col("id")], k + 1)
    classes = firsts.groupBy("words").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut_lineage(classes.select(F.col("ids")[0].alias("vid"), "words", "ids", set_bits("words").alias("n")))
    sizes = classes.groupBy("n").agg(F.count("*").alias("rows"))
    held = {r["n"]: r["rows"] for r in sizes.collect()}  # at most width + 1 rows
    blocks = broadcast_small(sizes.select(F.col("n").alias("m"), F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("blocks")))
    # A block holds about ``block`` rows; which ones does not matter, so a hash of the id settles it.
    placed = classes.join(blocks, classes.n == blocks.m).select(
        F.col("m"), F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int").alias("block"), F.col("vid").alias("nid"), F.col("words").alias("other"), "ids"
    )
    placed = cut_lineage(placed)
    asked = classes.select("vid", "words", "n")

    def met(visits: DataFrame) -> DataFrame:
        """Visits (vid, words, n, m, block, limit) against the rows of their block."""
        both = visits.join(placed, ["m", "block"])
        common = shared_bits("words", "other", words)
        union = F.greatest((F.col("n") + F.col("m") - F.col("_c")).cast("double"), F.lit(1e-8))
        scored = both.withColumn("_c", common).withColumn("distance", F.round(1.0 - F.col("_c") / union, 12))
        return scored.filter(F.col("distance") <= F.col("limit")).select("vid", "nid", "distance", F.size("ids").alias("copies"))

    # First pass: the nearest counts that hold k + 1 rows or more, one block of each.
    near = {}
    for n in held:
        order = sorted(held, key=lambda m: (-min(m, n) / max(m, n, 1), m))
        got, take = 0, []
        for m in order:
            take.append(m)
            got += min(held[m], block // 2)
            if got >= 2 * (k + 1):
                break
        near[n] = take
    pick = [(n, m) for n, ms in near.items() for m in ms]
    first = broadcast_small(df.sparkSession.createDataFrame(pick, "n int, m int"))
    probe = asked.join(first, "n").join(blocks, "m").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).withColumn("limit", F.lit(2.0)).drop("blocks")
    seen = top_per_group(met(probe), ["vid"], [F.col("distance"), F.col("nid")], k + 1, "_r")
    # Copies of a fingerprint count as neighbours, itself (one id of it) does not.
    reach = seen.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance", "copies"))).alias("s"))
    zero = F.struct(F.lit(-1).cast("long").alias("have"), F.lit(2.0).alias("limit"))
    step = lambda acc, x: F.struct((acc["have"] + x["copies"]).alias("have"), F.when((acc["have"] < k) & (acc["have"] + x["copies"] >= k), x["distance"]).otherwise(acc["limit"]).alias("limit"))
    # A first pass that did not meet the query's own row has it still to come: one id more is safe.
    limit = reach.select("vid", F.aggregate("s", zero, step)["limit"].alias("limit"))
    top = max(held)
    sim = F.greatest(1.0 - F.col("limit"), F.lit(0.0))
    low = F.when(sim > 0, F.ceil(F.col("n") * sim - 1e-6)).otherwise(0).cast("int")
    high = F.when(sim > 0, F.least(F.lit(float(top)), F.floor(F.col("n") / sim + 1e-6))).otherwise(top).cast("int")
    again = cut_lineage(asked.join(limit, "vid").select("vid", "words", "n", "limit", low.alias("low"), high.alias("high")))
    found = _second_pass(again, classes, held, k + 1, kind, chunk)
    best = top_per_group(found, ["vid"], [F.col("distance"), F.col("nid")], k + 1, "_r")
    opened = best.join(placed.select("nid", "ids"), "nid").select("vid", "distance", F.explode("ids").alias("neighbour"))
    short = top_per_group(opened, ["vid"], [F.col("distance"), F.col("neighbour")], k + 1, "_r")
    lists = short.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    members = keyed.select(F.col("id").alias("query"), F.col("words")).join(asked.select("vid", F.col("words").alias("_w")), F.col("words") == F.col("_w")).select("query", "vid")
    others = F.filter("near", lambda s: s["neighbour"] != F.col("query"))
    return members.join(lists, "vid").select("query", F.posexplode(F.slice(others, 1, k)).alias("_p", "_s")).select("query", "_s.neighbour", "_s.distance", (F.col("_p") + 1).alias("rank"))
