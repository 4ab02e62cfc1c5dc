"""Approximate nearest neighbours by descent on a neighbour table.

Every row starts with the rows next to it in a few random projections' orders.  A round gathers, at each
row, a bounded number of its neighbours and of rows that have it as neighbour; any two of these may be
neighbours of each other.  Pairs already compared (both old) are left out, each row keeps its best ones,
and rounds end when few lists change.  A gathering holds at most four times ``sample`` rows, however many
lists a popular row is in.

Rows are numbered in the order of their ids and cut into parts of consecutive numbers; the lists of a part
are a few matrices in one row of the table.  Parts ask each other for the vectors that their gatherings
name, each once, and send back only pairs nearer than the k-th that a row has so far, its best k of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_unused
from .linalg import plain_width, project
from .neighbours import _prepare, pairwise
from .ranking import ordered_rank, top_per_group

#: Bytes of vectors and candidates that the gatherings of a part may name, rows of a part at least, candidates
#: added before they are cut to each row's best.
PART_BYTES = 256 << 20
LEAST_ROWS = 512
HELD = 1 << 21


def _near_in_order(rows: DataFrame, k: int, lines: int, seed: int) -> DataFrame:
    """(query, neighbour), some of them twice: rows at most ``k / lines`` places apart along random
    projections."""
    width = plain_width(rows, "vec")
    line = np.random.default_rng(seed).normal(size=(width, lines))
    cast = project(rows, line, None, "vec", "_t")
    reach, out = max(1, -(-k // (2 * lines))), None
    for i in range(lines):
        order = cut_lineage(ordered_rank(cast.select("id", F.col("_t")[i].alias("t")), ["t", "id"], name="at"))
        step = order.withColumn("to", F.explode(F.array(*[F.col("at") + j for j in range(-reach, reach + 1) if j])))
        part = step.join(order.select(F.col("id").alias("neighbour"), F.col("at").alias("to")), "to").select(F.col("id").alias("query"), "neighbour")
        out = part if out is None else out.unionByName(part)
    return out


def _salt(hub: np.ndarray, member: np.ndarray, seed: int) -> np.ndarray:
    """A seeded number for each pair, to draw by."""
    with np.errstate(over="ignore"):
        z = member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hub.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed % (1 << 62)) * np.uint64(0x165667B19E3779F9)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _drawn(hub: np.ndarray, member: np.ndarray, fresh: np.ndarray, sample: int, seed: int) -> np.ndarray:
    """Positions of at most ``sample`` members of each hub, new and old ones apart."""
    group = 2 * hub + fresh
    order = np.lexsort((member, _salt(hub, member, seed), group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < sample]


def _best(query: np.ndarray, other: np.ndarray, dist: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of each query, (distance, number) in order; of a pair's entries the oldest mark and
    the least distance stay."""
    order = np.lexsort((dist, fresh, other, query))
    query, other, dist, fresh = query[order], other[order], dist[order], fresh[order]
    first = np.r_[True, (np.diff(query) != 0) | (np.diff(other) != 0)] if len(query) else np.zeros(0, dtype=bool)
    query, other, dist, fresh = query[first], other[first], dist[first], fresh[first]
    order = np.lexsort((other, dist, query))
    query = query[order]
    keep = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return query[np.arange(len(query)) - np.searchsorted(query, query) < k], other[keep], dist[keep], fresh[keep]


def _read(blob: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)


def _all(blobs: pd.Series, kind: str = "<i8") -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *(_read(b, kind) for b in blobs)])


def _split(at: np.ndarray, size: int) -> Iterator[tuple[int, slice]]:
    """(part, where its rows are) of numbers in order."""
    part = at // size
    ends = np.flatnonzero(np.r_[np.diff(part) != 0, True][: len(part)]) + 1
    for s, e in zip(np.r_[0, ends[:-1]], ends, strict=False):
        yield int(part[s]), slice(s, e)


def _by_part(left: DataFrame, right: DataFrame, run: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run(part, rows of left, rows of right)``.  One grouped union and no cogroup: the planner takes the
    size of a cogroup for the product of its sides, a number whose digits multiply each round."""
    both = left.withColumn("_r", F.lit(False)).unionByName(right.withColumn("_r", F.lit(True)), allowMissingColumns=True)
    return both.groupBy("part").applyInPandas(lambda key, pdf: run(int(key[0]), pdf[~pdf["_r"]], pdf[pdf["_r"]]), schema)


def _met(hub: np.ndarray, at: np.ndarray, fresh: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(query, other, distance): of the pairs that hubs bring together, with a new one among them, each
    row's k best below its k-th.  ``at`` are positions in ``x`` and ``kth``, hubs in order."""
    held: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))]
    limit, count = kth.copy(), 0

    def best() -> tuple[np.ndarray, ...]:
        q, o, d = (np.concatenate(part) for part in zip(*held, strict=True))
        q, o, d, _ = _best(q, o, d, np.ones(len(q), dtype=np.int8), k)
        full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
        limit[q[full]] = np.minimum(limit[q[full]], d[full])
        return q, o, d

    starts = np.flatnonzero(np.r_[True, np.diff(hub) != 0][: len(hub)])
    for s, e in zip(starts, np.r_[starts[1:], len(hub)], strict=True):
        own, new = at[s:e], fresh[s:e] > 0
        v = _prepare(x[own].astype(np.float64), metric)
        with np.errstate(invalid="ignore", over="ignore"):
            d = np.round(1.0 - v @ v.T if metric == "cosine" else pairwise(v, v, metric), 12)
            ok = (d <= limit[own][:, None]) & np.isfinite(d)
        ok &= new[:, None] | new[None, :]
        np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        held.append((own[i], own[j], d[i, j]))
        count += len(i)
        if count > HELD:
            held, count = [best()], 0
    return best()


def descent_knn(df: DataFrame, k: int, vec: str = "features", id_col: str = "id", metric: str = "cosine", held: int | None = None, sample: int | None = None, lines: int = 4, rounds: int = 12, least: float = 0.001, seed: int = 42, part_bytes: int = PART_BYTES) -> DataFrame:
    """(query, neighbour, distance, rank) with rank 1..k; every row asks about the others.

    Lists are ``held`` long while they are refined (3 k and at least 30 by default): where distances
    differ little, longer lists find more.  ``sample`` (as many, by default) bounds the neighbours, and the rows that have it as neighbour, which a row
    brings together in a round, new and old ones apart.  Rounds stop when a share below ``least`` of all
    entries is new.  Fewer than two rows give none.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    given = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("id is not null").distinct()
    rows = cut_lineage(ordered_rank(given, ["id", F.xxhash64("vec")], name="at").withColumn("at", F.col("at") - 1))
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], f"query {kind}, neighbour {kind}, distance double, rank int")
    asked, k = k, max(k, held or max(3 * k, 30))
    sample = sample or k
    width = plain_width(rows, "vec")
    # Vectors travel as floats where that loses nothing.
    short = rows.agg(F.min(F.forall("vec", lambda v: v.cast("float").cast("double").eqNullSafe(v)))).first()[0]
    number = "<f4" if short else "<f8"
    # A gathering names some 2 k rows, each with a vector and up to k candidates of 24 bytes.
    hubs = max(1, part_bytes // (2 * k * (width * np.dtype(number).itemsize + 24 * k)))
    parts = max(-(-n // hubs), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    size = -(-n // parts)
    place = F.expr(f"cast(at div {size} as int)")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "vec": [x.astype(number).tobytes()]})

    tiles = cut_lineage(rows.select(place.alias("part"), "at", "vec").groupBy("part").applyInPandas(pack, "part int, vec binary"))
    lists = "part int, nbr binary, dist binary, mark binary"
    gathered = f"{lists}, hub binary, member binary, fresh binary"

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Empty lists, and gatherings of a row and those next to it."""
        low = int(key[0]) * size
        h = min(size, n - low)
        own = np.arange(low, low + h)
        both = np.unique(np.stack([np.r_[own, pdf["query"].to_numpy()], np.r_[own, pdf["neighbour"].to_numpy()]], axis=1), axis=0)
        blank = [np.full((h, k), v, dtype=t).tobytes() for v, t in ((-1, "<i8"), (np.inf, "<f8"), (0, "i1"))]
        return pd.DataFrame([(int(key[0]), *blank, both[:, 0].tobytes(), both[:, 1].tobytes(), np.ones(len(both), dtype="i1").tobytes())], columns=["part", "nbr", "dist", "mark", "hub", "member", "fresh"])

    def links(turn: int):
        def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Entries by the neighbour's part, each row's draw of a part."""
            for pdf in batches:
                for part, nbr, mark in zip(pdf["part"], pdf["nbr"], pdf["mark"], strict=True):
                    nbr, mark = _read(nbr).reshape(-1, k), _read(mark, "i1").reshape(-1, k)
                    i, j = np.nonzero(nbr >= 0)
                    hub, member, fresh = nbr[i, j], i + int(part) * size, mark[i, j]
                    keep = _drawn(hub, member, fresh, sample, seed + turn)
                    keep = keep[np.argsort(hub[keep], kind="stable")]
                    hub, member, fresh = hub[keep], member[keep], fresh[keep]
                    for to, at in _split(hub, size):
                        yield pd.DataFrame({"part": [to], "hub": [hub[at].tobytes()], "member": [member[at].tobytes()], "fresh": [fresh[at].tobytes()]})

        return back

    def gather(turn: int):
        def draw(part: int, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            """A bounded draw of each kind, and the marks of the lists after it."""
            low = part * size
            nbr, mark = _read(g["nbr"].iat[0]).reshape(-1, k), _read(g["mark"].iat[0], "i1").reshape(-1, k).copy()
            i, j = np.nonzero(nbr >= 0)
            out = _drawn(i + low, nbr[i, j], mark[i, j], sample, seed + turn)
            i, j = i[out], j[out]
            bh, bm, bf = _all(e["hub"]), _all(e["member"]), _all(e["fresh"], "i1")
            back = _drawn(bh, bm, bf, sample, seed + turn)
            hub, member, fresh = np.r_[i + low, bh[back]], np.r_[nbr[i, j], bm[back]], np.r_[mark[i, j], bf[back]]
            mark[i, j] = 0
            order = np.lexsort((-fresh, member, hub))
            hub, member, fresh = hub[order], member[order], fresh[order]
            open_ = np.zeros(len(nbr), dtype=bool)
            open_[hub[fresh > 0] - low] = True
            keep = np.r_[True, (np.diff(hub) != 0) | (np.diff(member) != 0)][: len(hub)] & open_[hub - low]
            return pd.DataFrame([(part, g["nbr"].iat[0], g["dist"].iat[0], mark.tobytes(), hub[keep].tobytes(), member[keep].tobytes(), fresh[keep].tobytes())], columns=["part", "nbr", "dist", "mark", "hub", "member", "fresh"])

        return draw

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, member in zip(pdf["part"], pdf["member"], strict=True):
                ids = np.unique(_read(member))
                for tile, at in _split(ids, size):
                    yield pd.DataFrame({"part": [tile], "to": [part], "ids": [ids[at].tobytes()]})

    def serve(part: int, t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """Vectors and k-th distances of the rows that parts ask for."""
        x = _read(t["vec"].dropna().iat[0], number).reshape(-1, width)
        kth = _read(t["dist"].dropna().iat[0], "<f8").reshape(-1, k)[:, -1]
        own = [_read(b) - part * size for b in r["ids"]]
        return pd.DataFrame({"part": r["to"].astype("int32"), "ids": r["ids"], "vec": [x[i].tobytes() for i in own], "kth": [kth[i].tobytes() for i in own]})

    def compare(part: int, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        """Each row's best of the pairs that a part's gatherings bring together, by the row's part."""
        out = [pd.DataFrame({"part": pd.Series([], dtype="int32"), "query": [], "found": [], "far": []})]
        if not len(g) or not len(s):
            return out[0]
        s = s.iloc[np.argsort([_read(b)[0] for b in s["ids"]])]
        ids, kth = _all(s["ids"]), _all(s["kth"], "<f8")
        x = np.frombuffer(b"".join(s["vec"]), dtype=number).reshape(-1, width)
        hub, member, fresh = (_read(g[c].iat[0], t) for c, t in (("hub", "<i8"), ("member", "<i8"), ("fresh", "i1")))
        q, o, d = _met(hub, np.searchsorted(ids, member), fresh, x, kth, k, metric)
        q, o = ids[q], ids[o]
        for to, at in _split(q, size):
            out.append(pd.DataFrame({"part": [to], "query": [q[at].tobytes()], "found": [o[at].tobytes()], "far": [d[at].tobytes()]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    def merge(part: int, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The k best of each row; an entry that stood before stays old."""
        low = part * size
        nbr, dist, mark = (_read(g[name].iat[0], t).reshape(-1, k) for name, t in (("nbr", "<i8"), ("dist", "<f8"), ("mark", "i1")))
        i, j = np.nonzero(nbr >= 0)
        cq, co, cd = _all(c["query"]) - low, _all(c["found"]), _all(c["far"], "<f8")
        q, o, d, f = _best(np.r_[i, cq], np.r_[nbr[i, j], co], np.r_[dist[i, j], cd], np.r_[mark[i, j], np.full(len(cq), 2, dtype="i1")], k)
        at = np.arange(len(q)) - np.searchsorted(q, q)
        nbr, dist, mark = np.full(nbr.shape, -1, dtype="<i8"), np.full(nbr.shape, np.inf), np.zeros(nbr.shape, dtype="i1")
        nbr[q, at], dist[q, at], mark[q, at] = o, d, f > 0
        return pd.DataFrame([(part, nbr.tobytes(), dist.tobytes(), mark.tobytes(), int((f == 2).sum()))], columns=["part", "nbr", "dist", "mark", "new"])

    pairs = _near_in_order(rows.select(F.col("at").alias("id"), "vec"), k, lines, seed)
    drawn = cut_lineage(pairs.withColumn("part", F.expr(f"cast(query div {size} as int)")).groupBy("part").applyInPandas(begin, gathered))
    for turn in range(rounds + 1):
        wanted = drawn.select("part", "member").mapInPandas(ask, "part int, to int, ids binary")
        kept = tiles.unionByName(drawn.select("part", "dist"), allowMissingColumns=True)
        served = _by_part(kept, wanted, serve, "part int, ids binary, vec binary, kth binary")
        found = _by_part(drawn.select("part", "hub", "member", "fresh"), served, compare, "part int, query binary, found binary, far binary")
        graph = cut_lineage(_by_part(drawn.select("part", "nbr", "dist", "mark"), found, merge, f"{lists}, new bigint"))
        new = graph.agg(F.sum("new")).first()[0]
        del drawn, wanted, kept, served, found
        drop_unused(spark)
        if turn == rounds or turn and new <= least * n * min(k, n - 1):
            break
        back = graph.select("part", "nbr", "mark").mapInPandas(links(turn), "part int, hub binary, member binary, fresh binary")
        drawn = cut_lineage(_by_part(graph.select("part", "nbr", "dist", "mark"), back, gather(turn), gathered))
        del back, graph
    names = cut_lineage(rows.select("at", "id"))
    single = names.select("id").distinct().count() == n
    most = asked if single else k

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, nbr, dist in zip(pdf["part"], pdf["nbr"], pdf["dist"], strict=True):
                nbr, dist = _read(nbr).reshape(-1, k)[:, :most], _read(dist, "<f8").reshape(-1, k)[:, :most]
                i, j = np.nonzero(nbr >= 0)
                yield pd.DataFrame({"q": i + int(part) * size, "o": nbr[i, j], "distance": dist[i, j], "rank": (j + 1).astype("int32")})

    entries = graph.select("part", "nbr", "dist").mapInPandas(unpack, "q bigint, o bigint, distance double, rank int")
    for end, name in (("q", "query"), ("o", "neighbour")):
        entries = entries.join(names.select(F.col("at").alias(end), F.col("id").alias(name)), end)
    if not single:  # an id with several vectors asks once, and counts once
        entries = entries.filter("query <> neighbour").groupBy("query", "neighbour").agg(F.min("distance").alias("distance"))
        entries = top_per_group(entries, ["query"], [F.col("distance"), F.col("neighbour")], asked)
    return entries.select("query", "neighbour", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame, slack: float = 1e-9) -> DataFrame:
    """One row: the share of exact entries that ``found`` holds, entries as near as the exact last one
    counting alike."""
    last = exact.groupBy("query").agg(F.max("distance").alias("_last"), F.count("*").alias("_n"))
    hit = found.join(last, "query").filter(F.col("distance") <= F.col("_last") + slack).groupBy("query").agg(F.count("*").alias("_h"))
    per = last.join(hit, "query", "left").select(F.least(F.coalesce("_h", F.lit(0)), "_n").alias("h"), "_n")
    return per.agg((F.sum("h") / F.sum("_n")).alias("recall"), F.sum("_n").alias("entries"))
