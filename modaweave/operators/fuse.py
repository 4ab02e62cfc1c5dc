"""Feature selection and fusion: fitted once on the rows given, applied to any rows.

Each model keeps a projection of at most width x k numbers.  Fitting reads the table through
``moments`` (or one aggregate per iteration); applying is a broadcast matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .linalg import DENSE_WIDTH, Moments, _rows, centred_moments, covariance_times, fix_signs, leading_components, moments, plain_width, project, tiled_sum, vector_mean

METHODS = ("pca", "ipca", "ica", "kpca", "rks", "cca", "plsda", "tensordecompose", "integrate")


@dataclass
class LinearFusion:
    """x -> (x - center) @ weights."""

    center: np.ndarray
    weights: np.ndarray
    explained: np.ndarray | None = None

    def transform(self, df: DataFrame, vec: str = "features", out: str = "features") -> DataFrame:
        return project(df, self.weights, self.center, vec, out)


def _top_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), fix_signs(vectors[:, order])


def pca_from(m: Moments, k: int) -> LinearFusion:
    values, vectors = _top_eigen(m.covariance, k)
    return LinearFusion(m.mean, vectors, values)


def pca(df: DataFrame, k: int, vec: str = "features", dense: int = DENSE_WIDTH) -> LinearFusion:
    """Principal components: from the covariance up to ``dense`` features, beyond by a range finder that
    forms no width x width array."""
    if plain_width(df, vec) > dense:
        lead = leading_components(df, k, vec)
        return LinearFusion(lead.mean, lead.vectors, lead.values)
    m = centred_moments(df, vec)
    values, vectors = _top_eigen(m.outer / max(m.n - 1, 1), k)
    return LinearFusion(m.mean, vectors, values)


def incremental_pca(batches: Sequence[DataFrame], k: int, vec: str = "features") -> LinearFusion:
    """Same model from centred batch moments merged one after the other; batches of wide vectors go
    through the range finder together."""
    if plain_width(batches[0], vec) > DENSE_WIDTH:
        return pca(reduce(DataFrame.unionByName, [b.select(vec) for b in batches]), k, vec)
    return pca_from(reduce(lambda a, b: a + b, [centred_moments(b, vec) for b in batches]), k)


def kernel_pca(df: DataFrame, k: int, vec: str = "features") -> LinearFusion:
    """The linear kernel's components are the principal components."""
    return pca(df, k, vec)


def ica(df: DataFrame, k: int, vec: str = "features", rounds: int = 200, tol: float = 1e-4, seed: int = 42) -> LinearFusion:
    """Symmetric fixed-point ICA (log cosh): whitening from one covariance, then one aggregate of
    x * tanh(Wx) per round."""
    base = pca(df, k, vec)
    scale = 1.0 / np.sqrt(np.maximum(base.explained, 1e-12))
    white = LinearFusion(base.center, base.weights * scale)
    z = white.transform(df, vec, "_z").select("_z").persist()
    try:
        n = z.count()
        w = _decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
        for _ in range(rounds):
            gx, gp = _ica_step(z, w, k)
            nxt = _decorrelate(gx / n - np.diag(gp / n) @ w)
            moved = np.max(np.abs(np.abs(np.einsum("ij,ij->i", nxt, w)) - 1.0))
            w = nxt
            if moved < tol:
                break
    finally:
        z.unpersist()
    return LinearFusion(base.center, fix_signs(white.weights @ w.T))


def _decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1.0 / np.sqrt(np.maximum(s, 1e-12))) @ u.T @ w


def _ica_step(z: DataFrame, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(k * k + k)
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf["_z"])
                g = np.tanh(x @ w.T)
                acc[: k * k] += (g.T @ x).ravel()
                acc[k * k :] += (1.0 - g * g).sum(0)
        yield pd.DataFrame({"row": [acc]})

    row = z.mapInPandas(partial, "row array<double>").agg(Summarizer.sum(array_to_vector("row")).alias("s")).first()
    total = row["s"].toArray()
    return total[: k * k].reshape(k, k), total[k * k :]


@dataclass
class RandomFeatures:
    """sqrt(2/D) * cos(x W + b): random kitchen sinks for an RBF kernel."""

    weights: np.ndarray
    offset: np.ndarray

    def transform(self, df: DataFrame, vec: str = "features", out: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.offset))

        @F.pandas_udf("array<double>")
        def apply(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            w, b = shared.value
            return pd.Series(list(np.sqrt(2.0 / w.shape[1]) * np.cos(_rows(v) @ w + b)))

        return df.withColumn(out, apply(F.col(vec).cast("array<double>")))


def random_features(width: int, k: int, gamma: float = 1.0, seed: int = 42) -> RandomFeatures:
    rng = np.random.default_rng(seed)
    return RandomFeatures(np.sqrt(2.0 * gamma) * rng.normal(size=(width, k)), rng.uniform(0, 2 * np.pi, size=k))


@dataclass
class PairFusion:
    """Two projections of two vector columns, concatenated or summed."""

    left: LinearFusion
    right: LinearFusion
    correlations: np.ndarray
    mode: str = "concat"

    def transform(self, df: DataFrame, a: str, b: str, out: str = "features") -> DataFrame:
        both = self.right.transform(self.left.transform(df, a, "_ca"), b, "_cb")
        joined = F.concat("_ca", "_cb") if self.mode == "concat" else F.zip_with("_ca", "_cb", lambda x, y: x + y)
        return both.withColumn(out, joined).drop("_ca", "_cb")


def cca(df: DataFrame, a: str, b: str, k: int, mode: str = "concat", pre: int = 50, dense: int = DENSE_WIDTH) -> PairFusion:
    """Canonical correlation of two vector columns after a principal-component cut (``pre`` for the
    first, k for the second), all from one joint moment pass; wide columns are cut by the range finder
    before that."""
    widths = [plain_width(df, c) for c in (a, b)]
    if max(widths) > dense:
        cuts = [pca(df, min(keep, d), c, dense) for keep, d, c in ((pre, widths[0], a), (k, widths[1], b))]
        low = cuts[1].transform(cuts[0].transform(df, a, "_la"), b, "_lb").select("_la", "_lb")
        inner = cca(low, "_la", "_lb", k, mode, pre, max(pre, k))
        whole = [LinearFusion(c.center, c.weights @ side.weights) for c, side in zip(cuts, (inner.left, inner.right), strict=True)]
        return PairFusion(whole[0], whole[1], inner.correlations, mode)
    both = df.select(F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).alias("v"), F.size(a).alias("da"))
    da = both.select("da").first()["da"]
    m = centred_moments(both.select("v"), "v")
    cov = m.outer / max(m.n - 1, 1)
    caa, cbb, cab = cov[:da, :da], cov[da:, da:], cov[:da, da:]
    va, pa = _top_eigen(caa, min(pre, da))
    vb, pb = _top_eigen(cbb, min(k, len(cbb)))
    ka, kb = va > 1e-10 * max(va.max(), 1e-300), vb > 1e-10 * max(vb.max(), 1e-300)
    wa, wb = pa[:, ka] / np.sqrt(va[ka]), pb[:, kb] / np.sqrt(vb[kb])
    u, s, vt = np.linalg.svd(wa.T @ cab @ wb, full_matrices=False)
    r = min(k, len(s))
    left, right = wa @ u[:, :r], wb @ vt.T[:, :r]
    pick = np.abs(left).argmax(axis=0)
    sign = np.where(left[pick, np.arange(r)] < 0, -1.0, 1.0)  # one sign per pair keeps them aligned
    return PairFusion(LinearFusion(m.mean[:da], left * sign), LinearFusion(m.mean[da:], right * sign), s[:r], mode)


def _pls_wide(df: DataFrame, label: str, k: int, vec: str) -> LinearFusion:
    """The same rotations from X'y and one product X'(Xw) per component."""
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.array(F.col(label).cast("double")).alias("y"))
    mean, top = vector_mean(rows, "x"), vector_mean(rows, "y")
    n, d = rows.count(), len(mean)
    shared = df.sparkSession.sparkContext.broadcast((mean, top))

    def first(cols: list[np.ndarray]) -> np.ndarray:
        m, t = shared.value
        x, y = cols[0] - m, cols[1] - t
        return np.column_stack([(x * x).sum(0), x.T @ y, np.full(x.shape[1], (y * y).sum())])

    sums = tiled_sum(rows, ["x", "y"], first, d, 3)
    sd = np.sqrt(sums[:, 0] / max(n - 1, 1))
    sd = np.where(sd == 0, 1.0, sd)
    left = sums[:, 1] / sd / (np.sqrt(sums[0, 2] / max(n - 1, 1)) or 1.0)
    weights, loadings, sizes = np.zeros((d, 0)), np.zeros((d, 0)), []
    for _ in range(k):
        w = left / max(np.linalg.norm(left), 1e-300)
        image = covariance_times(rows, "x", mean, n, (w / sd)[:, None])[:, 0] * max(n - 1, 1) / sd
        image = image - loadings @ (np.array(sizes) * (loadings.T @ w))
        size = w @ image
        if size <= 1e-12:
            break
        p = image / size
        left = left - (left @ w) * p
        weights, loadings, sizes = np.column_stack([weights, w]), np.column_stack([loadings, p]), [*sizes, size]
    rotation = weights @ np.linalg.pinv(loadings.T @ weights)
    return LinearFusion(mean, rotation / sd[:, None])


def pls(df: DataFrame, label: str, k: int, vec: str = "features", dense: int = DENSE_WIDTH) -> LinearFusion:
    """PLS1 scores from X'X and X'y of standardised data; rotations applied to new rows.  Beyond
    ``dense`` features X'X is not formed."""
    if plain_width(df, vec) > dense:
        return _pls_wide(df, label, k, vec)
    joint = df.select(F.concat(F.col(vec).cast("array<double>"), F.array(F.col(label).cast("double"))).alias("v"))
    m = centred_moments(joint, "v")
    sd = np.sqrt(np.diag(m.outer) / max(m.n - 1, 1))
    sd = np.where(sd == 0, 1.0, sd)
    corr = m.outer / np.outer(sd, sd)
    xx, xy = corr[:-1, :-1], corr[:-1, -1]
    d = len(xy)
    weights, loadings = np.zeros((d, k)), np.zeros((d, k))
    cur_xx, cur_xy = xx.copy(), xy.copy()
    for j in range(k):
        w = cur_xy / max(np.linalg.norm(cur_xy), 1e-300)
        tt = w @ cur_xx @ w
        if tt <= 1e-12:
            weights, loadings = weights[:, :j], loadings[:, :j]
            break
        p = cur_xx @ w / tt
        q = cur_xy @ w / tt
        cur_xx = cur_xx - tt * np.outer(p, p)
        cur_xy = cur_xy - tt * q * p
        weights[:, j], loadings[:, j] = w, p
    rotation = weights @ np.linalg.pinv(loadings.T @ weights)
    return LinearFusion(m.mean[:-1], rotation / sd[:-1, None])


def select_k_best(df: DataFrame, label: str, k: int, vec: str = "features") -> DataFrame:
    """(pos, f_score, rank) by the univariate regression F statistic.

    Means first, then each feature's own square and its product with the label: three numbers a feature.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.array(F.col(label).cast("double")).alias("y"))
    shared = df.sparkSession.sparkContext.broadcast((vector_mean(rows, "x"), vector_mean(rows, "y")))

    def part(cols: list[np.ndarray]) -> np.ndarray:
        x, y = (c - m for c, m in zip(cols, shared.value, strict=True))
        return np.column_stack([(x * x).sum(0), x.T @ y, np.full(x.shape[1], (y * y).sum())])

    s = tiled_sum(rows, ["x", "y"], part, len(shared.value[0]), 3)
    n = rows.count()
    with np.errstate(divide="ignore", invalid="ignore"):
        r = s[:, 1] / np.sqrt(s[:, 0] * s[:, 2])
        f = r * r / (1.0 - r * r) * (n - 2)
    f = np.nan_to_num(f, nan=0.0)
    order = np.lexsort((np.arange(len(f)), -f))[:k]
    found = [(int(i), float(f[i]), rank + 1) for rank, i in enumerate(order)]
    return df.sparkSession.createDataFrame(found, "pos int, f_score double, rank int")


@dataclass
class Integration:
    """Each modality predicted from all the others, predictions concatenated, then compressed."""

    names: list[str]
    regressions: dict[str, tuple[np.ndarray, np.ndarray]]
    reducer: LinearFusion | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``enc_<name>``: the modality as reconstructed from the others."""
        out = df
        for n in self.names:
            rest = F.concat(*[F.col(o).cast("array<double>") for o in self.names if o != n])
            w, c = self.regressions[n]
            out = project(out.withColumn("_rest", rest), w, None, "_rest", f"enc_{n}")
            shift = F.array(*[F.lit(float(x)) for x in c])
            out = out.withColumn(f"enc_{n}", F.zip_with(f"enc_{n}", shift, lambda x, y: x + y)).drop("_rest")
        return out.withColumn("enc_all", F.concat(*[F.col(f"enc_{n}") for n in self.names]))

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        done = self.predict(df)
        return self.reducer.transform(done, "enc_all", out).drop("enc_all", *[f"enc_{n}" for n in self.names])


def integrate(df: DataFrame, names: Sequence[str], k: int, ridge: float = 1.0) -> Integration:
    """Cross-modal integration, linear: ridge regressions from one joint moment pass, then PCA."""
    names = list(names)
    sizes = df.select(*[F.size(n).alias(n) for n in names]).first().asDict()
    joint = df.select(F.concat(*[F.col(n).cast("array<double>") for n in names]).alias("v"))
    m = centred_moments(joint, "v")
    edge = np.cumsum([0] + [sizes[n] for n in names])
    spans = {n: np.arange(edge[i], edge[i + 1]) for i, n in enumerate(names)}
    models = {}
    full = np.zeros((edge[-1], edge[-1]))
    for n in names:
        mine = spans[n]
        rest = np.concatenate([spans[o] for o in names if o != n])
        w = np.linalg.solve(m.outer[np.ix_(rest, rest)] + ridge * np.eye(len(rest)), m.outer[np.ix_(rest, mine)])
        models[n] = (w, m.mean[mine] - m.mean[rest] @ w)
        full[np.ix_(rest, mine)] = w
    # The predictions are linear in the input, so their covariance needs no further pass.
    cov = full.T @ (m.outer / max(m.n - 1, 1)) @ full
    values, vectors = _top_eigen(cov, k)
    return Integration(names, models, LinearFusion(m.mean.copy(), vectors, values))


def recompress(model: Integration, widths: Sequence[int]) -> dict[int, Integration]:
    """The same integration at several output widths."""
    r = model.reducer
    return {
        k: Integration(model.names, model.regressions, LinearFusion(r.center, r.weights[:, :k], r.explained[:k])) for k in widths
    }


def reconstruction_losses(df: DataFrame, names: Sequence[str], recon: Mapping[str, str], concat: tuple[str, str]) -> DataFrame:
    """Three-part loss in one pass.

    Encoding error of each modality (``enc_<name>`` against the modality), leave-out error
    (``recon[name]`` against the other modalities), and the error of the concatenated code; the
    total weighs the two means and the last one by .33 each.
    """
    n = len(names)

    def mse(a, b):
        sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return F.sum(sq) / F.sum(F.size(a))

    dbl = lambda c: F.col(c).cast("array<double>")
    aggs = []
    for name in names:
        rest = F.concat(*[dbl(o) for o in names if o != name])
        aggs += [mse(dbl(f"enc_{name}"), dbl(name)).alias(f"encoding_loss_{name}"), mse(dbl(recon[name]), rest).alias(f"reconstruction_loss_{name}")]
    aggs.append(mse(dbl(concat[0]), dbl(concat[1])).alias("reconstruction_loss_concat"))
    out = df.agg(*aggs)
    enc = sum((F.col(f"encoding_loss_{m}") for m in names), F.lit(0.0))
    rec = sum((F.col(f"reconstruction_loss_{m}") for m in names), F.lit(0.0))
    return out.withColumns({"total_encoding_loss": enc, "total_reconstruction_loss": rec}).withColumn(
        "total_loss",
        0.33 * F.col("total_encoding_loss") / n + 0.33 * F.col("total_reconstruction_loss") / n + 0.33 * F.col("reconstruction_loss_concat"),
    )


def map_to_embedding(df: DataFrame, inputs: str, target: str, ridge: float = 1.0) -> LinearFusion:
    """Multi-output ridge from token vectors to an embedding; the offset is kept in ``explained``."""
    both = df.select(F.concat(F.col(inputs).cast("array<double>"), F.col(target).cast("array<double>")).alias("v"), F.size(inputs).alias("d"))
    d = both.select("d").first()["d"]
    m = centred_moments(both.select("v"), "v")
    w = np.linalg.solve(m.outer[:d, :d] + ridge * np.eye(d), m.outer[:d, d:])
    return LinearFusion(m.mean[:d], w, m.mean[d:])


def score_mapping(df: DataFrame, model: LinearFusion, inputs: str, target: str) -> DataFrame:
    """Mean cosine similarity and mean squared error of the mapped vectors."""
    shift = F.array(*[F.lit(float(x)) for x in model.explained])
    made = model.transform(df, inputs, "_p").withColumn("_p", F.zip_with("_p", shift, lambda x, y: x + y))
    t = F.col(target).cast("array<double>")
    sq = F.aggregate(F.zip_with("_p", t, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return made.agg(F.avg(cosine("_p", t)).alias("cosine"), (F.sum(sq) / F.sum(F.size(t))).alias("mse"))


# -- tensor decomposition ---------------------------------------------------------------------------
@dataclass
class TensorFusion:
    """Sample factors of a (modality x sample x feature) tensor with fixed other factors."""

    modality: np.ndarray
    feature: np.ndarray

    def transform(self, df: DataFrame, stacks: Sequence[str], out: str = "features") -> DataFrame:
        a, c = self.modality, self.feature
        gram = np.linalg.pinv((a.T @ a) * (c.T @ c))
        # Khatri-Rao product: one weight column per component.
        kr = np.einsum("mr,fr->mfr", a, c).reshape(-1, a.shape[1])
        row = F.concat(*[F.col(s).cast("array<double>") for s in stacks])
        return project(df.withColumn("_stack", row), kr @ gram, None, "_stack", out).drop("_stack")


def tensor_fusion(df: DataFrame, stacks: Sequence[str], k: int, rounds: int = 50, tol: float = 1e-5, seed: int = 42) -> TensorFusion:
    """CP decomposition by alternating least squares.

    With the other two factors fixed the sample factors are linear in the rows, so every update of
    the small factors only needs the second moments of the stacked rows: one pass over the data in
    all, the iterations run on a width x width matrix.
    """
    widths = df.agg(*[F.struct(F.min(F.size(s)).alias("a"), F.max(F.size(s)).alias("b")).alias(s) for s in stacks]).first()
    if len({x for w in widths for x in w}) > 1:
        raise ValueError(f"modalities must have one width, got {dict(zip(stacks, widths, strict=True))}; select features first (top_features)")
    row = df.select(F.concat(*[F.col(s).cast("array<double>") for s in stacks]).alias("v"))
    s = moments(row, "v").outer
    m = len(stacks)
    f = s.shape[0] // m
    rng = np.random.default_rng(seed)
    a, c = rng.random((m, k)), rng.random((f, k))
    norm, last = np.trace(s), np.inf
    for _ in range(rounds):
        kr = np.einsum("mr,fr->mfr", a, c).reshape(-1, k)
        p = kr @ np.linalg.pinv((a.T @ a) * (c.T @ c))  # sample factor B = X p
        bb, xb = p.T @ s @ p, (s @ p).reshape(m, f, k)  # B'B and X'B
        a = np.einsum("mfr,fr->mr", xb, c) @ np.linalg.pinv(bb * (c.T @ c))
        c = np.einsum("mfr,mr->fr", xb, a) @ np.linalg.pinv(bb * (a.T @ a))
        scale = np.linalg.norm(c, axis=0)
        scale = np.where(scale == 0, 1.0, scale)
        a, c = a * scale, c / scale
        kr = np.einsum("mr,fr->mfr", a, c).reshape(-1, k)
        error = norm - 2 * np.sum(kr * xb.reshape(-1, k)) + np.sum((kr @ bb) * kr)
        if abs(last - error) <= tol * max(norm, 1e-300):
            break
        last = error
    return TensorFusion(a, c)


def top_features(df: DataFrame, stacks: Sequence[str], label: str, k: int = 100) -> DataFrame:
    """The ``k`` features of each modality that a straight line predicts ``label`` best from.

    One moment pass over each modality beside the label; a narrower modality than ``k`` is an error,
    since the stacked modalities need one width.
    """
    out = df
    for s in stacks:
        both = df.select(F.concat(F.col(s).cast("array<double>"), F.array(F.col(label).cast("double"))).alias("v"))
        cov = centred_moments(both, "v").covariance
        if len(cov) - 1 < k:
            raise ValueError(f"{s} has {len(cov) - 1} features, {k} are wanted")
        spread = np.diag(cov)[:-1] * cov[-1, -1]
        r2 = np.where(spread > 0, cov[:-1, -1] ** 2 / np.where(spread > 0, spread, 1.0), 0.0)
        pick = np.sort(np.lexsort((np.arange(len(r2)), -r2))[:k])
        out = out.withColumn(s, F.array(*[F.get(F.col(s), F.lit(int(i))).cast("double") for i in pick]))
    return out


# -- spectral embedding -------------------------------------------------------------------------------
def spectral_embedding(edges: DataFrame, k: int, rounds: int = 30, seed: int = 42) -> DataFrame:
    """(id, features): leading non-trivial directions of the normalised neighbour graph.

    Orthogonal iteration where the graph stays a table: one join and one sum per round, each round
    written to reliable storage; only k x k products reach the driver.
    """
    from ..functions.hashing import unit_interval
    from ..session import cut_lineage

    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count("*").cast("double").alias("deg"))
    deg_dst = degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg2"))
    graph = cut_lineage(
        both.join(degree, "src").join(deg_dst, "dst").select("src", "dst", (1.0 / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w"))
    )
    wide = k + 1
    x = degree.select(
        F.col("src").alias("id"),
        F.array(
            F.sqrt("deg"),
            *[unit_interval(F.md5(F.concat_ws("|", F.lit(f"{seed}-{j}"), F.col("src").cast("string")))) - 0.5 for j in range(k)],
        ).alias("features"),
    )
    x = _orthonormal(x)
    for _ in range(rounds):
        step = graph.join(x.withColumnRenamed("id", "dst"), "dst").select(
            F.col("src").alias("id"), array_to_vector(F.transform("features", lambda v: v * F.col("w"))).alias("v")
        )
        summed = step.groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
        # The half-step shift keeps the spectrum positive, so the largest directions win.
        x = _orthonormal(x.join(summed, "id").select("id", F.zip_with("features", "s", lambda a, b: 0.5 * a + 0.5 * b).alias("features")))
    return x.select("id", F.slice("features", 2, wide - 1).alias("features"))


def _orthonormal(x: DataFrame) -> DataFrame:
    """Gram-Schmidt over rows of a table from its k x k cross-product."""
    from ..session import cut_lineage

    x = cut_lineage(x)
    g = moments(x, "features").outer
    r = np.linalg.cholesky(g + 1e-12 * np.trace(g) * np.eye(len(g))).T
    return project(x, np.linalg.inv(r))


def fuse(df: DataFrame, modalities: Sequence[str], method: str, k: int, label: str | None = None, most: int | None = None):
    """Fit a named fusion over the modality columns of an aligned table.

    ``most`` with a ``label`` first selects that many features of each modality (tensor fusion).

    Returns (model, rows with ``features``).  The model's ``transform`` takes other rows, so nothing
    is refitted on held-out data.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    joined = df.withColumn("features", F.concat(*[F.col(m).cast("array<double>") for m in modalities]))
    if method == "ipca":
        part = F.pmod(F.xxhash64("features"), F.lit(4))
        model = incremental_pca([b for b in (joined.filter(part == i) for i in range(4)) if not b.isEmpty()], k)
    elif method in ("pca", "kpca"):
        model = pca(joined, k)
    elif method == "ica":
        model = ica(joined, k)
    elif method == "rks":
        from .linalg import width_of

        model = random_features(width_of(joined, "features"), k)
    elif method == "plsda":
        if label is None:
            raise ValueError("plsda needs a label column")
        model = pls(joined, label, k)
    elif method == "cca":
        pairs = [(a, b) for i, a in enumerate(modalities) for b in modalities[i + 1 :]]
        models = {p: cca(df, *p, k=k) for p in pairs}
        out = df
        for i, (p, mod) in enumerate(models.items()):
            out = mod.transform(out, *p, out=f"_pair{i}")
        names = [f"_pair{i}" for i in range(len(pairs))]
        return models, out.withColumn("features", F.concat(*[F.col(n) for n in names])).drop(*names)
    elif method == "integrate":
        model = integrate(df, modalities, k)
        return model, model.transform(df)
    else:
        df = top_features(df, modalities, label, most) if label and most else df
        model = tensor_fusion(df, modalities, k)
        return model, model.transform(df, modalities)
    return model, model.transform(joined)
