"""Exact nearest neighbours without an all-pairs join.

``knn`` collapses identical vectors first (a hot group of copies becomes one row with its first
k+1 ids, which is all any answer can need).  What follows depends on the checked size:

* the distinct vectors fit the broadcast budget: every query batch is one matrix product against
  the broadcast matrix, and only the k best leave the task;
* otherwise, where a try on some queries shows that the bounds below rule out little: chunks of queries
  meet chunks of vectors in one task each;
* otherwise: vectors are assigned to pivots, laid out in blocks of bounded size ordered by their
  distance to the pivot, and each query visits only blocks that the triangle inequality cannot
  rule out.  Visits to a busy block are split into chunks, so no task holds more than one block
  and one chunk; only the k best per visit are emitted.

All ways are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import seeded_key
from ..session import broadcast_small, cut_lineage
from .ranking import ordered_rank, top_per_group

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 8192
CHUNK_ROWS = 8192
#: A tile of distances: 4 MB.
TILE_ROWS, TILE_COLUMNS = 256, 2048
#: Donor rows from which the borders of their blocks are learnt, and rows aimed at in a block.
SAMPLE_ROWS = 1 << 16
LEAF_ROWS = 1024
SLACK = 1e-7


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()]) if len(s) else np.zeros((0, 0))


def _prepare(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1.0, n)
    return x


def _power(x: np.ndarray, p: float) -> np.ndarray:
    """Powers of numbers that are not negative; small whole ones as products."""
    if p not in (1, 2, 3, 4):
        return x**p
    out = x
    for _ in range(int(p) - 1):
        out = out * x
    return out


def _minkowski_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, p: float) -> np.ndarray:
    """Distances of the rows ``a[i]`` and ``b[j]``, a bounded number of them at once."""
    out, step = np.empty(len(i)), max(1, (1 << 15) // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = _power(np.abs(b[j[s : s + step]] - a[i[s : s + step]]), p).sum(1) ** (1.0 / p)
    return out


def pairwise(a: np.ndarray, b: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """True metric distances between rows of two prepared matrices (cosine as chord length)."""
    if metric in ("cosine", "euclidean"):
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(sq, 0.0))
    if metric == "tanimoto":
        both = a @ b.T
        union = np.maximum(a.sum(1)[:, None] + b.sum(1)[None, :] - both, 1e-8)
        return 1.0 - both / union
    if metric == "minkowski":
        out = np.empty((len(a), len(b)))
        for i, row in enumerate(a):
            out[i] = _power(np.abs(b - row), p).sum(1) ** (1.0 / p)
        return out
    raise ValueError(f"unknown metric {metric!r}")


def measured(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, the same whichever comes first."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    both = (a * b).sum(1)
    return 1.0 - both / np.maximum(a.sum(1) + b.sum(1) - both, 1e-8)


def _measured_columns(a: np.ndarray, b: np.ndarray, cols: np.ndarray, vals: np.ndarray, metric: str) -> np.ndarray:
    """The chosen columns' (12-digit) distances, measured pair by pair."""
    out, step = vals.copy(), max(1, (16 << 20) // (8 * max(1, cols.shape[1] * b.shape[1])))
    for s in range(0, len(a), step):
        at = cols[s : s + step]
        pairs = measured(np.repeat(a[s : s + step], at.shape[1], axis=0), b[at.ravel()], metric).reshape(at.shape)
        out[s : s + step] = np.where(np.isnan(vals[s : s + step]), np.nan, np.round(pairs, 12))
    return out


def _reported(d: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances as shown to users: cosine is 1 - similarity."""
    return 1.0 - a @ b.T if metric == "cosine" else d


def _k_best(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column positions and (12-digit) distances of the k smallest entries of each row; of equal
    distances the earlier column stays, so columns in id order break ties by id."""
    dist = np.round(dist, 12)
    if dist.shape[1] <= k:
        return np.broadcast_to(np.arange(dist.shape[1]), dist.shape), dist
    cols = np.argpartition(dist, k - 1, axis=1)[:, :k]
    vals = np.take_along_axis(dist, cols, axis=1)
    limit = vals.max(axis=1)
    for i in np.flatnonzero((dist <= limit[:, None]).sum(axis=1) > k):
        near = np.flatnonzero(dist[i] <= limit[i])
        cols[i] = near[np.argsort(dist[i, near], kind="stable")[:k]]
        vals[i] = dist[i, cols[i]]
    return cols, vals


def _first_of_rows(row: np.ndarray, col: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each row in the order (distance, column)."""
    order = np.lexsort((col, dist, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[order[keep]], dist[order[keep]]


def nearest_columns(a: np.ndarray, b: np.ndarray, k: int, metric: str, p: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Columns and (12-digit) reported distances of the k nearest rows of ``b`` for each row of ``a``, of
    equal distances the earlier row of ``b``.

    Distances are formed in tiles that stay in the processor's cache.  After the first tile an entry is
    looked at only if it is below the row's k-th distance so far; a later one equal to it never counts.
    """
    k = min(k, len(b))
    cols, vals = np.empty((len(a), k), dtype=np.int64), np.empty((len(a), k))
    if not len(a) or not k:
        return cols, vals
    wide = max(TILE_COLUMNS, k)
    size = (lambda m: (m * m).sum(1)) if metric in ("euclidean", "minkowski") else (lambda m: m.sum(1))
    with np.errstate(invalid="ignore", over="ignore"):
        asize, bsize = size(a), size(b)
    if metric == "minkowski" and len(b) > k and p >= 1.5 and np.isfinite(asize).all() and np.isfinite(bsize).all():
        return _nearest_minkowski(a, b, asize, bsize, k, p)
    for s in range(0, len(a), TILE_ROWS):
        x, own = a[s : s + TILE_ROWS], asize[s : s + TILE_ROWS]
        r, c, d = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        limit = None
        for t in range(0, len(b), wide):
            y, other = b[t : t + wide], bsize[t : t + wide]
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                if limit is None or metric == "minkowski" or np.isinf(limit).any():
                    dist = _reported(pairwise(x, y, metric, p), x, y, metric)
                    dist[np.isnan(dist)] = np.inf
                    if limit is None:
                        limit = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(y) > k else dist.max(1)
                        i, j = np.nonzero(dist <= limit[:, None] + 1e-12)
                    else:
                        i, j = np.nonzero(dist <= limit[:, None])
                    near = dist[i, j]
                else:
                    # The distance only of entries whose product is large enough, within rounding.
                    both = x @ y.T
                    if metric == "cosine":
                        i, j = np.nonzero(both >= (1.0 - limit)[:, None])
                        near = 1.0 - both[i, j]
                    elif metric == "euclidean":
                        room = 1e-9 * (own + other.max())
                        np.subtract(both, 0.5 * other, out=both)
                        i, j = np.nonzero(both >= (0.5 * (own - np.maximum(limit, 0.0) ** 2) - room)[:, None])
                        near = np.sqrt(np.maximum(own[i] - 2.0 * both[i, j], 0.0))
                    else:
                        share = np.maximum(1.0 - limit, 0.0)
                        i, j = np.nonzero(both >= (share / (1.0 + share))[:, None] * (own[:, None] + other) - 1e-9)
                        near = 1.0 - both[i, j] / np.maximum(own[i] + other[j] - both[i, j], 1e-8)
                    under = near <= limit[i]
                    i, j, near = i[under], j[under], near[under]
            if not len(i):
                continue
            r, c, d = _first_of_rows(np.r_[r, i], np.r_[c, j + t], np.r_[d, np.round(near, 12)], k)
            limit = d.reshape(-1, k)[:, -1] - 4e-13
        cols[s : s + TILE_ROWS], vals[s : s + TILE_ROWS] = c.reshape(-1, k), d.reshape(-1, k)
    vals[np.isinf(vals)] = np.nan
    return cols, vals


def _nearest_minkowski(a: np.ndarray, b: np.ndarray, asize: np.ndarray, bsize: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """``nearest_columns`` for finite rows.  The euclidean distance, one product, is at most a fixed factor
    times this one: the k euclidean nearest bound the k-th distance, and only pairs that the factor leaves
    within that bound are formed."""
    factor = b.shape[1] ** (0.5 - 1.0 / p) if p > 2 else 1.0
    cols, _ = nearest_columns(a, b, k, "euclidean")
    limit = _minkowski_pairs(a, np.repeat(np.arange(len(a)), k), b, cols.ravel(), p).reshape(-1, k).max(1) + 1e-12
    vals = np.empty(cols.shape)
    for s in range(0, len(a), TILE_ROWS):
        x, own, reach = a[s : s + TILE_ROWS], asize[s : s + TILE_ROWS], limit[s : s + TILE_ROWS]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(0, len(b), TILE_COLUMNS):
            y, other = b[t : t + TILE_COLUMNS], bsize[t : t + TILE_COLUMNS]
            half = x @ y.T
            np.subtract(half, 0.5 * other, out=half)
            i, j = np.nonzero(half >= (0.5 * (own - (factor * reach) ** 2 - 1e-9 * (own + other.max())))[:, None])
            near = _minkowski_pairs(x, i, y, j, p)
            under = near <= reach[i]
            found.append((i[under], j[under] + t, np.round(near[under], 12)))
        _, c, d = _first_of_rows(*(np.concatenate(part) for part in zip(*found, strict=True)), k)
        cols[s : s + TILE_ROWS], vals[s : s + TILE_ROWS] = c.reshape(-1, k), d.reshape(-1, k)
    return cols, vals


def distinct_vectors(df: DataFrame, vec: str, id_col: str, keep: int) -> DataFrame:
    """(vid, vec, ids): identical vectors as one row with its ``keep`` smallest ids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    firsts = top_per_group(rows, ["vec"], [F.col("id")], keep)
    return firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0])


def knn(
    df: DataFrame,
    k: int,
    vec: str = "features",
    id_col: str = "id",
    metric: str = "cosine",
    queries: DataFrame | None = None,
    p: float = 2.0,
    broadcast_bytes: int = BROADCAST_BYTES,
    pairwise_measured: bool = False,
) -> DataFrame:
    """(query, neighbour, distance, rank) with rank 1..k, ties broken by neighbour id.

    With no ``queries`` every row of ``df`` asks about the others (itself left out).
    ``pairwise_measured`` (euclidean, tanimoto) measures the distances of the chosen rows again, pair by
    pair, where the search's matrix product rounds.
    """
    again = metric if pairwise_measured else None
    own = queries is None
    ask = df if own else queries
    keep = k + 1 if own else k
    corpus = cut_lineage(distinct_vectors(df, vec, id_col, keep))
    stats = corpus.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, d = stats["n"], stats["d"] or 0
    asked = corpus.select("vid", "vec") if own else distinct_vectors(ask, vec, id_col, 1).select("vid", "vec")
    # vid identifies the distinct vector on the asking side.
    if n * d * 8 <= broadcast_bytes:
        best = _search_broadcast(corpus, asked, keep, metric, p, again)
    else:
        best = _search_partitioned(corpus, asked, keep, metric, p, n, again)
    # best: (vid, nid, distance) up to the k nearest distinct vectors; open them into ids.
    opened = best.join(corpus.select(F.col("vid").alias("nid"), "ids"), "nid").select(
        "vid", "distance", F.explode("ids").alias("neighbour")
    )
    short = top_per_group(opened, ["vid"], [F.col("distance"), F.col("neighbour")], keep, "_r")
    # At most k+1 candidates per distinct vector, kept as one array so copies share them.
    lists = short.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    members = ask.select(F.col(id_col).alias("query"), F.col(vec).cast("array<double>").alias("vec"))
    # The hash comes first, so sorting and comparing rarely look into the vectors.
    same = (F.xxhash64("vec") == F.xxhash64("_v")) & (F.col("vec") == F.col("_v"))
    keyed = members.join(asked.withColumnRenamed("vec", "_v"), same).select("query", "vid")
    near = F.filter("near", lambda s: s["neighbour"] != F.col("query")) if own else F.col("near")
    return (
        keyed.join(lists, "vid")
        .select("query", F.posexplode(F.slice(near, 1, k)).alias("_p", "_s"))
        .select(
            "query",
            F.col("_s.neighbour").alias("neighbour"),
            F.col("_s.distance").alias("distance"),
            (F.col("_p") + 1).alias("rank"),
        )
    )


def _fields(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]


def _search_broadcast(corpus: DataFrame, asked: DataFrame, k: int, metric: str, p: float, again: str | None = None) -> DataFrame:
    kind_q, kind_c = _fields(asked, "vid"), _fields(corpus, "vid")

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, dtype=np.float64).tobytes())

    # Size checked by the caller; as bytes, a vector is one value on the driver and not one a component.
    held = corpus.select("vid", packed("vec").alias("vec")).toPandas().sort_values("vid")
    mat = np.stack([np.frombuffer(v) for v in held["vec"]]) if len(held) else None
    payload = corpus.sparkSession.sparkContext.broadcast((held["vid"].to_numpy(), _prepare(mat, metric) if len(held) else None))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = payload.value
        for pdf in batches:
            if not len(pdf) or mat is None:
                continue
            for s in range(0, len(pdf), CHUNK_ROWS):
                part = pdf.iloc[s : s + CHUNK_ROWS]
                a = _prepare(_stack(part["vec"]), metric)
                cols, vals = nearest_columns(a, mat, k, metric, p)
                if again:
                    vals = _measured_columns(a, mat, cols, vals, again)
                yield pd.DataFrame(
                    {
                        "vid": np.repeat(part["vid"].to_numpy(), cols.shape[1]),
                        "nid": ids[cols.ravel()],
                        "distance": vals.ravel(),
                    }
                )

    width = asked.sparkSession.sparkContext.defaultParallelism
    return asked.repartition(width).mapInPandas(scan, f"vid {kind_q}, nid {kind_c}, distance double")


def _search_partitioned(corpus: DataFrame, asked: DataFrame, k: int, metric: str, p: float, n: int, again: str | None = None) -> DataFrame:
    spark = corpus.sparkSession
    kind_q, kind_c = _fields(asked, "vid"), _fields(corpus, "vid")
    m = int(np.clip(np.sqrt(n), 1, 1024))
    # A bounded, reproducible choice of pivots: at most 1024 vectors.
    # They are found on the cluster, so the driver gets them once and not from each task.
    chosen = cut_lineage(corpus.select("vec", seeded_key("vid", "pivot").alias("_h")).orderBy("_h").limit(m)).toPandas()
    pivots = _prepare(_stack(chosen["vec"]), metric)
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell:int,radius:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "radius": pd.Series([], dtype="float64")})
        dist = pairwise(_prepare(_stack(v), metric), shared.value, metric, p)
        cell = dist.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": dist[np.arange(len(v)), cell]})

    placed = corpus.select("vid", "vec", assign("vec").alias("_a")).select("vid", "vec", "_a.cell", "_a.radius")
    ranked = ordered_rank(placed, ["radius", "vid"], by=["cell"], name="_r")
    blocks = cut_lineage(
        ranked.withColumn("block", F.floor((F.col("_r") - 1) / BLOCK_ROWS).cast("int")).drop("_r")
    )
    # One row per block: n / BLOCK_ROWS + pivots of them, a few numbers each.
    meta = (
        blocks.groupBy("cell", "block")
        .agg(F.count("*").alias("rows"), F.min("radius").alias("near"), F.max("radius").alias("far"))
        .orderBy("cell", "block")
        .toPandas()
    )
    table = spark.sparkContext.broadcast(
        tuple(meta[c].to_numpy() for c in ("cell", "block", "rows", "near", "far"))
    )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, block, rows, near, far = table.value
        for pdf in batches:
            step = max(1, (4 << 20) // len(cell))
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s : s + step]
                at = pairwise(_prepare(_stack(part["vec"]), metric), shared.value, metric, p)[:, cell]
                upper, lower = at + far, np.maximum(np.maximum(at - far, near - at), 0.0)
                # The k-th neighbour is no farther than the upper edge of the blocks that hold k rows.
                bound = np.full(len(part), np.inf)
                if rows.sum() >= k:
                    order = np.argsort(upper, axis=1)
                    reach = (np.cumsum(rows[order], axis=1) < k).sum(axis=1)
                    bound = upper[np.arange(len(part)), order[np.arange(len(part)), reach]]
                q, hit = np.nonzero(lower <= bound[:, None] + SLACK)
                yield pd.DataFrame(
                    {"vid": part["vid"].to_numpy()[q], "cell": cell[hit], "block": block[hit], "low": lower[q, hit]}
                )

    # Where bounds leave most blocks open, whole chunks against whole blocks move fewer bytes than single
    # visits do.  How many a query has to make is learnt from a bounded choice of queries.
    tile = max(1, min(4 * BLOCK_ROWS, (16 << 20) // (8 * max(1, pivots.shape[1]))))
    kinds = f"vid {kind_q}, cell int, block int, low double"
    some = cut_lineage(asked.withColumn("_h", seeded_key("vid", "visits")).orderBy("_h").limit(1024).select("vid", "vec"))
    tried = some.agg(F.count("*")).first()[0]
    if tried and some.mapInPandas(route, kinds).count() / tried > 2 * max(1.0, n / tile):
        return _search_tiles(corpus, asked, k, metric, p, tile, again)
    visits = asked.mapInPandas(route, kinds)
    first = top_per_group(visits, ["vid"], [F.col("low"), F.col("cell"), F.col("block")], 2, "_r").drop("_r")
    # Round one: the closest blocks give each query a tight k-th distance ...
    probe = cut_lineage(_visit(first, blocks, asked, k, metric, p, kind_q, kind_c, again))
    reached = top_per_group(probe, ["vid"], [F.col("distance"), F.col("nid")], k, "_r")
    limit = reached.groupBy("vid").agg(F.when(F.count("*") >= k, F.max("_m")).alias("limit"))
    # ... round two: only blocks that can still beat it.
    rest = (
        visits.join(limit, "vid", "left")
        .filter(F.col("limit").isNull() | (F.col("low") <= F.col("limit") + SLACK))
        .drop("limit")
        .join(first.select("vid", "cell", "block"), ["vid", "cell", "block"], "left_anti")
    )
    found = probe.unionByName(_visit(rest, blocks, asked, k, metric, p, kind_q, kind_c, again))
    return top_per_group(found, ["vid"], [F.col("distance"), F.col("nid")], k, "_r").select("vid", "nid", "distance")


def _search_tiles(corpus: DataFrame, asked: DataFrame, k: int, metric: str, p: float, tile: int, again: str | None = None) -> DataFrame:
    """Every query against every row, ``tile`` of each in a task; a row is copied once for each tile of
    the other side, and k rows per query and tile leave the task."""
    kind_q, kind_c = _fields(asked, "vid"), _fields(corpus, "vid")
    width, height = (max(1, -(-df.count() // tile)) for df in (corpus, asked))
    deal = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select(F.col("vid").alias("vid"), F.col("vec").alias("vec"), deal(height).alias("i")).withColumn("j", spread(width))
    c = corpus.select(F.col("vid").alias("vid"), F.col("vec").alias("vec"), deal(width).alias("j")).withColumn("i", spread(height))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"vid": [], "nid": [], "distance": []})
        c = c.sort_values("vid")
        a, b = (_prepare(_stack(side["vec"]), metric) for side in (q, c))
        cols, vals = nearest_columns(a, b, k, metric, p)
        if again:
            vals = _measured_columns(a, b, cols, vals, again)
        return pd.DataFrame({"vid": np.repeat(q["vid"].to_numpy(), cols.shape[1]), "nid": c["vid"].to_numpy()[cols.ravel()], "distance": vals.ravel()})

    found = q.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInPandas(compare, f"vid {kind_q}, nid {kind_c}, distance double")
    return top_per_group(found, ["vid"], [F.col("distance"), F.col("nid")], k, "_r").select("vid", "nid", "distance")


def _visit(visits: DataFrame, blocks: DataFrame, asked: DataFrame, k: int, metric: str, p: float, kind_q: str, kind_c: str, again: str | None = None) -> DataFrame:
    """k best per (query, block); one task sees one block and at most about CHUNK_ROWS queries."""
    # One row per block visited.
    sizes = broadcast_small(visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")))
    routed = (
        visits.join(sizes, ["cell", "block"])
        .withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int"))
        .join(asked, "vid")
        .select("vid", "vec", "cell", "block", "chunk")
    )
    copies = blocks.join(sizes, ["cell", "block"]).select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vid", "vec"
    )

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"vid": [], "nid": [], "distance": [], "_m": []})
        c = c.sort_values("vid")
        a, b, ids = _prepare(_stack(q["vec"]), metric), _prepare(_stack(c["vec"]), metric), c["vid"].to_numpy()
        out = []
        step = max(1, (32 << 20) // (8 * len(b)))
        for s in range(0, len(a), step):
            d = pairwise(a[s : s + step], b, metric, p)
            cols, vals = _k_best(_reported(d, a[s : s + step], b, metric), k)
            if again:
                vals = _measured_columns(a[s : s + step], b, cols, vals, again)
            out.append(
                pd.DataFrame(
                    {
                        "vid": np.repeat(q["vid"].to_numpy()[s : s + step], cols.shape[1]),
                        "nid": ids[cols.ravel()],
                        "distance": vals.ravel(),
                        "_m": np.take_along_axis(d, cols, axis=1).ravel(),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    key = ["cell", "block", "chunk"]
    return (
        routed.groupBy(*key)
        .cogroup(copies.groupBy(*key))
        .applyInPandas(compare, f"vid {kind_q}, nid {kind_c}, distance double, _m double")
    )


# -- answers built on the neighbour list ------------------------------------------------------
def with_labels(neighbours: DataFrame, labels: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """Attach the neighbour's label (``label``) and the query's own (``truth``)."""
    lab = labels.select(F.col(id_col), F.col(label).cast("double").alias("label"))
    return neighbours.join(lab.withColumnRenamed(id_col, "neighbour"), "neighbour").join(
        lab.select(F.col(id_col).alias("query"), F.col("label").alias("truth")), "query"
    )


def report(labelled: DataFrame, k: int) -> DataFrame:
    """One row per query: distance, neighbour and label for each rank, null where there is none."""
    cells = []
    for r in range(1, k + 1):
        at = F.col("rank") == r
        cells += [
            F.max(F.when(at, F.col("distance"))).alias(f"dist_{r}"),
            F.max(F.when(at, F.col("neighbour"))).alias(f"key_{r}"),
            F.max(F.when(at, F.col("label"))).alias(f"label_{r}"),
        ]
    return labelled.groupBy("query", "truth").agg(*cells)


def majority_vote(labelled: DataFrame, k: int = 5) -> DataFrame:
    """Share of positive neighbours among the first k, predicted class and correctness."""
    return (
        labelled.filter(F.col("rank") <= k)
        .groupBy("query", "truth")
        .agg(F.avg("label").alias("positive_share"))
        .withColumn("predicted", F.when(F.col("positive_share") > 0.5, 1.0).otherwise(0.0))
        .withColumn("correct", F.col("predicted") == F.col("truth"))
    )


def weighted_votes(labelled: DataFrame) -> DataFrame:
    """Inverse-distance weighted vote for every k at once: running sums over the rank."""
    w = F.lit(1.0) / (F.col("distance") + F.lit(1e-8))
    run = W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return labelled.select(
        "query",
        "truth",
        F.col("rank").alias("k"),
        (F.sum(w * F.col("label")).over(run) / F.sum(w).over(run)).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0))


# -- donors for missing values ------------------------------------------------------------------
@dataclass
class _Boxes:
    """The donor blocks of one class: names, rows, which positions they have, and their bounds there."""

    names: np.ndarray
    rows: np.ndarray
    has: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def gaps(self, x: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
        """Least distance of rows, known at positions ``own``, to a donor of each block."""
        shared = self.has[:, own].sum(1)
        sq = np.zeros((len(x), len(self.names)))
        with np.errstate(invalid="ignore"):
            for j in own:
                d = np.maximum(np.maximum(self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j]), 0.0)
                sq += np.where(self.has[:, j], np.nan_to_num(d, nan=0.0, posinf=np.inf), 0.0)**2
        return np.where(shared > 0, np.sqrt(width / np.maximum(shared, 1) * sq), np.inf)


def _halved(x: np.ndarray, own: Sequence[int], least: int, names: Iterator[int]) -> tuple | int:
    """Halve rows at the median of their widest position down to ``least`` rows: (position, border, lower,
    upper), or the number of a leaf."""
    if len(own) and len(x) >= 2 * least:
        part = np.clip(x[:, own], -1e150, 1e150)
        for j in np.argsort(part.min(0) - part.max(0), kind="stable"):
            border = np.median(x[:, own[j]])
            lower = x[:, own[j]] <= border
            if 0 < lower.sum() < len(x):
                return own[j], border, _halved(x[lower], own, least, names), _halved(x[~lower], own, least, names)
    return next(names)


def _leaf_of(tree: tuple | int, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    if isinstance(tree, int):
        out[at] = tree
        return
    j, border, lower, upper = tree
    under = x[at, j] <= border
    _leaf_of(lower, x, at[under], out)
    _leaf_of(upper, x, at[~under], out)


def _donor_blocks(donors: DataFrame, width: int, total: int) -> tuple[DataFrame, dict[str, _Boxes]]:
    """((did, g, v, b), boxes by class): donors laid out in blocks of nearby rows with the same gaps.

    Where the borders lie is learnt from a bounded sample of the rows; bounds and sizes are those of all
    rows, so the search stays exact.  A leaf that holds more than a block is dealt out by hash.
    """
    spark, kind = donors.sparkSession, _fields(donors, "did")
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    at = F.pmod(F.xxhash64("did", "v"), F.lit(1 << 20))
    sample = donors.filter(at < int(share * (1 << 20)) + 1).select("g", "v").toPandas()
    trees: dict[tuple[str, str], tuple | int] = {}
    x = _stack(sample["v"])
    signs = np.array(["".join("1" if m else "0" for m in row) for row in np.isnan(x)], dtype=object)
    for key, rows in pd.DataFrame({"g": sample["g"], "p": signs}).groupby(["g", "p"]).indices.items():
        own = [j for j in range(width) if key[1][j] == "0"]
        trees[key] = _halved(x[rows], own, max(8, int(min(LEAF_ROWS, BLOCK_ROWS) * share)), itertools.count())
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, leaf = _stack(pdf["v"]), np.zeros(len(pdf), dtype="int32")
            for key, rows in pdf.groupby(["g", "p"]).indices.items():
                _leaf_of(shared.value.get(key, 0), x, rows, leaf)
            pdf["leaf"] = leaf
            yield pdf

    pattern = F.array_join(F.transform("v", lambda e: F.when(e.isNull(), "1").otherwise("0")), "")
    placed = donors.withColumn("p", pattern).select("did", "g", "v", "p").mapInPandas(place, f"did {kind}, g string, v array<double>, p string, leaf int")
    placed = cut_lineage(placed)
    key = ["g", "p", "leaf"]
    crowded = broadcast_small(placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts")).filter("_parts > 1"))
    part = F.pmod(F.xxhash64("did", "v"), F.coalesce("_parts", F.lit(1)))
    blocks = cut_lineage(placed.join(crowded, key, "left").select("did", "g", "v", "p", F.concat_ws("|", "p", "leaf", part).alias("b")))
    # One row per block: about rows / LEAF_ROWS of them.
    ends = [f(F.col("v")[j]).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max)) for j in range(width)]
    meta = blocks.groupBy("g", "p", "b").agg(F.count("*").alias("rows"), *ends).orderBy("g", "b").toPandas()
    boxes = {}
    for g, rows in meta.groupby("g"):
        has = np.array([[c == "0" for c in p] for p in rows["p"]])
        low, high = (rows[[f"{n}{j}" for j in range(width)]].to_numpy(dtype=np.float64) for n in ("lo", "hi"))
        boxes[g] = _Boxes(rows["b"].to_numpy(), rows["rows"].to_numpy(), has, low, high)
    return blocks.drop("p"), boxes


def nearest_donors(left: DataFrame, right: DataFrame, width: int, k: int, by: str | None = None, exclude_self: bool = True) -> DataFrame:
    """(qid, fill): for each missing position of an incomplete row, the mean over the k nearest
    donors that have it.  Distance is sqrt(width / shared * sum of squared gaps over shared
    positions); rows without a shared position are no donors.

    A class with one block of donors meets it whole.  Larger classes lie in blocks of nearby rows: the
    closest block gives a row its k-th distance, and it then visits only blocks whose bounds are within
    that.  Each task holds one bounded donor block and one bounded chunk of incomplete rows and returns
    k candidates per missing cell.
    """
    spark = left.sparkSession
    kind = _fields(left, "qid")
    group = F.col(by).cast("string") if by else F.lit("")
    # Ids may repeat, so rows are told apart by their place in the written table.
    incomplete = left.filter(F.exists("v", lambda x: x.isNull())).select("qid", group.alias("g"), F.col("v").alias("v"))
    incomplete = cut_lineage(incomplete.withColumn("rid", F.monotonically_increasing_id()))
    donors = cut_lineage(right.select("did", group.alias("g"), "v"))
    sizes = cut_lineage(donors.groupBy("g").agg(F.count("*").alias("_n")))
    # At most rows / BLOCK_ROWS classes.
    large = {r["g"]: r["_n"] for r in sizes.filter((F.col("_n") > BLOCK_ROWS) & F.col("g").isNotNull()).collect()}
    small = sizes.filter(F.col("_n") <= BLOCK_ROWS).select("g")
    kinds = f"qid {kind}, pos int, did {_fields(right, 'did')}, dist double, value double"

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "pos": [], "did": [], "dist": [], "value": []})]
        if not len(a) or not len(b):
            return out[0]
        b = b.sort_values("did")
        x, y, qids, ids = _stack(a["v"]), _stack(b["v"]), a["qid"].to_numpy(), b["did"].to_numpy()
        has = ~np.isnan(y)
        # Rows with the same gaps share one distance matrix, filled feature by feature.
        gaps = np.isnan(x)
        patterns, member = np.unique(gaps, axis=0, return_inverse=True)
        step = max(1, (4 << 20) // (8 * len(b)))
        for i, gap in enumerate(patterns):
            rows = np.flatnonzero(member.ravel() == i)
            own = np.flatnonzero(~gap)
            shared = has[:, own].sum(1)
            factor = width / np.maximum(shared, 1)
            for s in range(0, len(rows), step):
                at = rows[s : s + step]
                sq = np.zeros((len(at), len(b)))
                for j in own:
                    d = x[at, j][:, None] - np.where(has[:, j], y[:, j], 0.0)[None, :]
                    sq += np.where(has[:, j], d * d, 0.0)
                dist = np.sqrt(factor * sq)
                dist[:, shared == 0] = np.inf
                if exclude_self:
                    dist[ids[None, :] == qids[at][:, None]] = np.inf
                for pos in np.flatnonzero(gap):
                    cols, vals = _k_best(np.where(has[:, pos], dist, np.inf), k)
                    ok = np.isfinite(vals)
                    out.append(
                        pd.DataFrame(
                            {
                                "qid": np.repeat(qids[at], cols.shape[1])[ok.ravel()],
                                "pos": int(pos),
                                "did": ids[cols[ok]],
                                "dist": vals[ok],
                                "value": y[cols[ok], pos],
                            }
                        )
                    )
        return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)

    key = ["g", "b", "c"]

    def meet(visits: DataFrame, blocks: DataFrame) -> DataFrame:
        """Visits (qid, g, v, rid, b) against the donors of their block, in chunks of visits."""
        shape = broadcast_small(visits.groupBy("g", "b").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("_nc")))
        q = visits.join(shape, ["g", "b"]).select("qid", "v", "g", "b", F.pmod(F.xxhash64("rid"), F.col("_nc")).cast("int").alias("c"))
        d = blocks.join(shape, ["g", "b"]).select("did", "v", "g", "b", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("c"))
        return q.groupBy(*key).cogroup(d.groupBy(*key)).applyInPandas(compare, kinds)

    whole = F.lit("").alias("b")
    cand = meet(incomplete.join(small, "g").select("qid", "g", "v", "rid", whole), donors.join(small, "g").select("did", "g", "v", whole))
    if large:
        names = F.broadcast(spark.createDataFrame([(g,) for g in large], "g string"))
        blocks, boxes = _donor_blocks(donors.join(names, "g").select("did", "g", "v"), width, sum(large.values()))
        table = spark.sparkContext.broadcast(boxes)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The closest blocks that hold enough donors, or, where limits are known, all others within them."""
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _stack(pdf["v"])
                again = "limits" in pdf
                reach = np.nan_to_num(_stack(pdf["limits"]), nan=np.inf) if again else None
                signs = pd.Series([m.tobytes() for m in np.isnan(x)])
                for (g, _), rows in pd.DataFrame({"g": pdf["g"].to_numpy(), "p": signs}).groupby(["g", "p"]).indices.items():
                    box: _Boxes = table.value[g]
                    gap = np.isnan(x[rows[0]])
                    own, step = np.flatnonzero(~gap), max(1, (1 << 19) // len(box.names))
                    for s in range(0, len(rows), step):
                        at = rows[s : s + step]
                        low = box.gaps(x[at], own, width)
                        first, later = np.zeros(low.shape, dtype=bool), np.zeros(low.shape, dtype=bool)
                        for pos in np.flatnonzero(gap):
                            gives = np.where(box.has[:, pos], low, np.inf)
                            order = np.argsort(gives, axis=1, kind="stable")
                            held = np.cumsum(np.where(np.isfinite(np.take_along_axis(gives, order, 1)), box.rows[order], 0), axis=1)
                            # One block more than the k rows need lies within reach: the row itself may be a donor.
                            take = (held - box.rows[order] < k + 1) & np.isfinite(np.take_along_axis(gives, order, 1))
                            chosen = np.zeros(low.shape, dtype=bool)
                            np.put_along_axis(chosen, order, take, 1)
                            first |= chosen
                            if again:
                                later |= np.isfinite(gives) & (gives <= reach[at, pos][:, None] * (1 + 1e-9) + 1e-9)
                        i, hit = np.nonzero(later & ~first if again else first)
                        yield pdf[["qid", "g", "v", "rid"]].iloc[at[i]].assign(b=box.names[hit])

        asks = cut_lineage(incomplete.join(names, "g").select("qid", "g", "v", "rid"))
        columns = f"qid {kind}, g string, v array<double>, rid bigint, b string"
        probe = cut_lineage(meet(cut_lineage(asks.mapInPandas(route, columns)), blocks))
        reached = top_per_group(probe, ["qid", "pos"], [F.col("dist"), F.col("did")], k, "_r")
        ends = reached.groupBy(F.col("qid").alias("_q"), "pos").agg(F.when(F.count("*") >= k, F.max("dist")).alias("m"))
        known = F.map_from_entries(F.collect_list(F.struct("pos", "m")))
        each = lambda m: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at(m, i))
        limits = ends.groupBy("_q").agg(known.alias("_m")).select("_q", each(F.col("_m")).alias("limits"))
        none = F.array(*[F.lit(None).cast("double")] * width)
        bounded = asks.join(limits, F.col("qid").eqNullSafe(F.col("_q")), "left").select("qid", "g", "v", "rid", F.coalesce("limits", none).alias("limits"))
        rest = cut_lineage(bounded.mapInPandas(route, columns))
        cand = cand.unionByName(probe).unionByName(meet(rest, blocks))
    best = top_per_group(cand, ["qid", "pos"], [F.col("dist"), F.col("did")], k, "_r")
    cells = best.groupBy("qid", "pos").agg(F.avg("value").alias("m"))
    at = F.map_from_entries(F.collect_list(F.struct("pos", "m")))
    return (
        cells.groupBy("qid")
        .agg(at.alias("_m"))
        .select("qid", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("_m", i)).alias("fill"))
    )


def edges(neighbours: DataFrame) -> DataFrame:
    """Undirected neighbour graph: (src, dst, distance) with src < dst."""
    a, b = F.col("query"), F.col("neighbour")
    return neighbours.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.min("distance").alias("distance"))

