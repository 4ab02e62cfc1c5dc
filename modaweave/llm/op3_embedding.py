"""Near-duplicate embeddings by product quantisation.

Unit vectors fall into coarse inverted lists (k-means); residuals get one code per subspace.  A
vector probes every list whose border with its own list is near enough; in a probed list, table
lookups give approximate cosines, and what these do not rule out is compared exactly in double
precision.  Two vectors are compared only if their labels are equal.

Sufficient probes: a neighbour at the threshold is displaced by sin(angle); along the normal of a
border that is about sin(angle) / sqrt(dimension) times a standard normal.  ``deviations`` of those
are allowed for (and of the code error, in the same way); with ``deviations=None`` the whole
displacement is, which is a guarantee and visits more lists.

Equal vectors collapse first.  A task compares blocks of bounded size and gives back link counts and
a spanning star of its links, never the pairs, so a list with a third of all rows is split both ways.

Vectors that are null or zero, or hold null or non-finite components, and rows without a label link
with nothing; a null vec_id has a null component and is not kept.  Lengths may differ: only equal
lengths are compared.  Repeated rows link with each other.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored, unit_hash
from .op7_minhash import _groups

PARTS, CODES = 8, 256
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of at most ``k`` clusters (Lloyd), from a fixed seed."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


class Index:
    """Coarse centres and subspace codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists, seed=seed)
        rest = self.parts(sample - self.coarse[nearest(sample, self.coarse)])
        self.books = [kmeans(rest[:, m], CODES, seed=seed + m) for m in range(rest.shape[1])]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into equal subspaces, padded with zeros."""
        m = min(PARTS, self.dim)
        wide = -(-self.dim // m) * m
        return np.pad(x, ((0, 0), (0, wide - self.dim))).reshape(len(x), m, -1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, norm of what the codes leave) of unit vectors."""
        own = nearest(x, self.coarse)
        rest = self.parts(x - self.coarse[own])
        codes = np.stack([nearest(rest[:, m], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)
        left = sum(((rest[:, m] - b[codes[:, m]]) ** 2).sum(axis=1) for m, b in enumerate(self.books))
        return own, codes, np.sqrt(left)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists from the own one on whose border lies within ``reach`` of the vector."""
        to = x @ self.coarse.T
        norms = (self.coarse**2).sum(axis=1)
        gap = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * self.coarse @ self.coarse.T, 1e-12))
        # Signed distance from the border between the own list and each other one.
        far = ((to[np.arange(len(x)), own] - norms[own] / 2)[:, None] - (to - norms[None, :] / 2)) / gap[own]
        ok = far <= reach
        ok[np.arange(len(x)), own] = True
        ok &= np.arange(len(self.coarse))[None, :] >= own[:, None]
        return [np.flatnonzero(r) for r in ok]

    def approximate(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric products of exact queries with coded members of list ``at``, by table lookup."""
        parts = self.parts(q)
        out = np.repeat((q @ self.coarse[at])[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            out += (parts[:, m] @ book.T)[:, codes[:, m]]
        return out


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, most: int = 20_000, seed: int = 3) -> dict[int, Index]:
    """One index per vector length, from about ``most`` vectors chosen by hash; every row is indexed."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sizes.items():
        part = vectors.filter((F.col("dim") == dim) & (unit_hash("_d1", "_d2", seed=seed) < most / n)).select("_d1", "_d2", "embedding").toPandas()
        if part.empty:
            part = vectors.filter(F.col("dim") == dim).select("_d1", "_d2", "embedding").limit(1).toPandas()
        sample = _unit(part.sort_values(["_d1", "_d2"])["embedding"])
        out[dim] = Index(sample, int(np.clip(np.sqrt(n) / 2, 1, 4096)), seed)
    return out


def _placed(indexes: dict[int, Index], reach_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, g in pdf.groupby("dim", sort=False):
                index, x = indexes[dim], _unit(g["embedding"])
                own, codes, left = index.encode(x)
                yield pd.DataFrame({"cid": g["cid"], "label": g["label"], "dim": g["dim"], "weight": g["weight"], "list": own, "codes": [c.tobytes() for c in codes], "rest": left, "vector": [v.tobytes() for v in x], "probes": index.probes(x, own, reach_of(dim))})

    return run


def _stars(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, int]]:
    """(node, smallest node) for every component of a block's links."""
    open_ = link.any(axis=1)
    while open_.any():
        row = np.zeros(len(rows), dtype=bool)
        row[int(open_.argmax())] = True
        seen = 0
        while row.sum() != seen:
            seen = row.sum()
            col = link[row].any(axis=0)
            row |= link[:, col].any(axis=1)
        nodes = np.unique(np.r_[rows[row], cols[col]])
        for node in nodes[1:].tolist():
            yield node, int(nodes[0])
        open_ &= ~row


def _compared(indexes: dict[int, Index], least: float, deviations: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["label", "dim", "list", "qb", "mb"]):
            asks = g["asks"].to_numpy()
            q, m = g[asks], g[~asks]
            if q.empty or m.empty:
                continue
            index = indexes[int(g["dim"].iloc[0])]
            at = int(g["list"].iloc[0])
            vq, vm = (np.frombuffer(b"".join(s["vector"]), dtype=np.float64).reshape(len(s), -1) for s in (q, m))
            codes = np.frombuffer(b"".join(m["codes"]), dtype=np.uint8).reshape(len(m), -1)
            slack = m["rest"].to_numpy() * (1.0 if deviations is None else min(1.0, deviations / np.sqrt(index.dim))) + 1e-9
            maybe = index.approximate(vq, at, codes) >= least - slack[None, :]
            iq, im = q["cid"].to_numpy(), m["cid"].to_numpy()
            # Inside a list every pair once; between lists only the lower list asks.
            maybe &= (q["home"].to_numpy()[:, None] != at) | (iq[:, None] < im[None, :])
            i, j = np.nonzero(maybe)
            link = np.zeros(maybe.shape, dtype=bool)
            for k in range(0, len(i), 200_000):
                a, b = i[k : k + 200_000], j[k : k + 200_000]
                link[a, b] = np.einsum("ij,ij->i", vq[a], vm[b]) >= least
            if not link.any():
                continue
            wq, wm = q["weight"].to_numpy(), m["weight"].to_numpy()
            ids = np.r_[iq, im]
            n = np.r_[link @ wm, wq @ link]
            ids, n = ids[n > 0], n[n > 0]
            stars = np.array(list(_stars(link, iq, im)), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": np.r_[ids, stars[:, 0]], "b": np.r_[np.full(len(ids), -1), stars[:, 1]], "n": np.r_[n, np.zeros(len(stars), dtype=np.int64)]})

    return run


def near_duplicates(rows: DataFrame, similarity: float = 0.93, deviations: float | None = 6.0, most: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id of every row (vec_id, embedding, label)."""
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    known = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    known = known.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    known = known.select("vec_id", "label", "embedding", "_ok", F.when(F.col("_ok"), F.xxhash64("label", "embedding")).alias("_d1"), F.when(F.col("_ok"), F.xxhash64("embedding", "label", F.lit(1))).alias("_d2"))
    keyed = stored(known.withColumn("_r", F.monotonically_increasing_id()), "pq-rows")
    same = ["_d1", "_d2"]
    classes = keyed.filter("_ok").groupBy(*same).agg(F.min("_r").alias("cid"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(classes, "pq-classes")
    vectors = keyed.join(classes.select("cid", "weight"), F.col("_r") == F.col("cid")).select("cid", "label", "weight", "embedding", *same, F.size("embedding").alias("dim"))
    vectors = stored(vectors, "pq-vectors")
    indexes = fit(vectors, most)
    sine = float(np.sqrt(1 - similarity**2))

    def reach(dim: int) -> float:
        return sine * (1.0 if deviations is None else min(1.0, deviations / np.sqrt(dim)))

    schema = "cid long, label string, dim int, weight long, list int, codes binary, rest double, vector binary, probes array<int>"
    placed = stored(vectors.select("cid", "label", "weight", "embedding", "dim").mapInPandas(_placed(indexes, reach), schema), "pq-placed")
    spot = ["label", "dim", "list"]
    held = placed.groupBy(*spot).agg(F.count("*").alias("_held"))
    asked = placed.select("label", "dim", F.explode("probes").alias("list")).groupBy(*spot).agg(F.count("*").alias("_asked"))
    plan = stored(held.join(asked, spot).select(*spot, F.ceil(F.col("_held") / F.lit(BLOCK)).cast("int").alias("_mbs"), F.ceil(F.col("_asked") / F.lit(BLOCK)).cast("int").alias("_qbs")), "pq-plan")

    def spread(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """One copy of each row for every block of the other side."""
        out = side.join(plan, spot).withColumn(own, F.pmod(F.xxhash64("cid", "list"), F.col(own_n)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    carried = ["cid", "weight", "vector"]
    members = spread(placed.drop("probes"), "mb", "_mbs", "qb", "_qbs").select(*spot, "qb", "mb", F.lit(False).alias("asks"), F.col("list").alias("home"), "codes", "rest", *carried)
    queries = placed.select("label", "dim", F.col("list").alias("home"), F.explode("probes").alias("list"), *carried)
    queries = spread(queries, "qb", "_qbs", "mb", "_mbs").select(*spot, "qb", "mb", F.lit(True).alias("asks"), "home", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("rest"), *carried)
    keys = [*spot, "qb", "mb"]
    met = members.union(queries).repartition(*keys).sortWithinPartitions(*keys)
    found = stored(met.mapInPandas(_compared(indexes, similarity, deviations), "a long, b long, n long"), "pq-links")
    counts = found.filter("b = -1").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("_n"))
    comp = components(found.filter("b >= 0").select("a", "b"))
    named = classes.join(counts, classes.cid == counts._c, "left").join(comp, F.col("cid") == F.col("node"), "left")
    named = stored(named.select(*same, "least", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("comp")), "pq-named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = named.join(least, "comp").select(F.col("_d1").alias("_e1"), F.col("_d2").alias("_e2"), "n_links", "component_id")
    out = keyed.select("vec_id", *same)
    out = out.join(final, (out._d1 == final._e1) & (out._d2 == final._e2), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op3(rows: DataFrame, **settings) -> DataFrame:
    out = near_duplicates(rows, **settings)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
