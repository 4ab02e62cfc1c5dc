"""Queries for the density hierarchy and the histogram trees, with SQL that recomputes them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import density, hierarchy, learners, sample, trees
from ..operators.ranking import ordered_rank
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query, r

# -- density hierarchy ------------------------------------------------------------------------------
#: Prim's walk over mutual reachability: a list holds, for every row outside, its lightest edge inwards.
_PRIM = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
apart AS MATERIALIZED (SELECT a.n AS a, b.n AS b, round(list_distance(a.x, b.x), 12) AS d FROM v a JOIN v b ON a.n <> b.n),
core AS (SELECT a AS n, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM apart) WHERE k <= {samples} GROUP BY a),
near AS MATERIALIZED (
  SELECT a, list({{'w': w, 'lo': least(a, b), 'hi': greatest(a, b)}} ORDER BY b) AS edges
  FROM (SELECT p.a, p.b, greatest(p.d, x.core, y.core) AS w FROM apart p JOIN core x ON x.n = p.a JOIN core y ON y.n = p.b
        UNION ALL SELECT n, n, 1e300 FROM v) GROUP BY a),
prim(k, edges) AS (
  SELECT CAST(0 AS BIGINT), edges FROM near WHERE a = 1
  UNION ALL
  SELECT k + 1, [CASE WHEN j = u OR old[j].w > 1e299 THEN {{'w': 1e300, 'lo': j, 'hi': j}} WHEN t.edges[j] < old[j] THEN t.edges[j] ELSE old[j] END FOR j IN range(1, len(old) + 1)]
  FROM (SELECT k, edges AS old, list_position(edges, list_min(edges)) AS u FROM prim WHERE list_min(edges).w < 1e299) s JOIN near t ON t.a = s.u),
tree AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e) AS edge, e.lo AS a, e.hi AS b, e.w AS w FROM (SELECT list_min(edges) AS e FROM prim) WHERE e.w < 1e299)"""

#: The tree's edges replayed: every row's component and cluster (0 while it is loose).
_REPLAY = """
replay(k, comp, cl, whole, x, nx, y, ny, loose, lv) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(n ORDER BY n) FROM v), (SELECT list(CAST(0 AS BIGINT) ORDER BY n) FROM v), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT edge, [CASE WHEN c = cb THEN ca ELSE c END FOR c IN comp],
    CASE WHEN whole = 0 THEN cl ELSE [CASE WHEN comp[j] IN (ca, cb) THEN whole ELSE cl[j] END FOR j IN range(1, len(cl) + 1)] END,
    whole, xa, na, xb, nb, CASE WHEN whole = 0 OR (xa > 0 AND xb > 0) THEN [] ELSE [j FOR j IN range(1, len(cl) + 1) IF cl[j] = 0 AND comp[j] IN (ca, cb)] END, 1.0 / greatest(w, 1e-12)
  FROM (
    SELECT *, CASE WHEN xa > 0 AND xb > 0 THEN edge WHEN xa > 0 THEN xa WHEN xb > 0 THEN xb WHEN na + nb >= {least} THEN edge ELSE 0 END AS whole FROM (
      SELECT t.edge, t.w, p.comp, p.cl, p.comp[t.a] AS ca, p.comp[t.b] AS cb, p.cl[t.a] AS xa, p.cl[t.b] AS xb,
        CAST(len([1 FOR c IN p.comp IF c = p.comp[t.a]]) AS BIGINT) AS na, CAST(len([1 FOR c IN p.comp IF c = p.comp[t.b]]) AS BIGINT) AS nb
      FROM replay p JOIN tree t ON t.edge = p.k + 1))),
joined AS MATERIALIZED (SELECT unnest(loose) AS n, whole AS cluster, lv FROM replay WHERE k > 0),
met AS (SELECT x AS part, whole, lv, nx AS rows FROM replay WHERE x > 0 AND y > 0 UNION ALL SELECT y, whole, lv, ny FROM replay WHERE x > 0 AND y > 0),
held AS (
  SELECT cluster, sum(n) AS size, sum(s) AS s, max(peak) AS peak FROM (
    SELECT cluster, count(*) AS n, sum(lv) AS s, max(lv) AS peak FROM joined GROUP BY cluster
    UNION ALL SELECT whole, sum(rows), sum(rows * lv), max(lv) FROM met GROUP BY whole) GROUP BY cluster),
clusters AS MATERIALIZED (
  SELECT h.cluster, m.whole AS parent, coalesce(m.lv, 0) AS birth, size, s - coalesce(m.lv, 0) * size AS own, peak, row_number() OVER (ORDER BY h.cluster) AS i
  FROM held h LEFT JOIN met m ON m.part = h.cluster)"""

#: Clusters from the leaves up, the best value below each in a list; then the topmost chosen one over each.
_CHOICE = """
settle(i, below, kept) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(CAST(0 AS DOUBLE)) FROM clusters), CAST([] AS BIGINT[])
  UNION ALL
  SELECT c.i, [CASE WHEN j = p.i THEN s.below[j] + CASE WHEN c.own >= s.below[c.i] THEN c.own ELSE s.below[c.i] END ELSE s.below[j] END FOR j IN range(1, len(s.below) + 1)],
    CASE WHEN c.parent IS NOT NULL AND c.own >= s.below[c.i] THEN list_append(s.kept, c.cluster) ELSE s.kept END
  FROM settle s JOIN clusters c ON c.i = s.i + 1 LEFT JOIN clusters p ON p.cluster = c.parent),
chosen AS (SELECT unnest(kept) AS cluster FROM (SELECT kept FROM settle ORDER BY i DESC LIMIT 1)),
over(cluster, up) AS (SELECT cluster, cluster FROM clusters UNION ALL SELECT o.cluster, c.parent FROM over o JOIN clusters c ON c.cluster = o.up WHERE c.parent IS NOT NULL),
label AS (SELECT o.cluster, max(o.up) AS label FROM over o JOIN chosen k ON k.cluster = o.up GROUP BY o.cluster),
inside AS MATERIALIZED (SELECT v.id, l.label, j.lv, c.peak, c.own FROM joined j JOIN label l ON l.cluster = j.cluster JOIN clusters c ON c.cluster = l.label JOIN v ON v.n = j.n),
named AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS cluster, max(own) / (count(*) * (SELECT max(peak) FROM clusters)) AS persistence FROM inside GROUP BY label),
points AS (SELECT v.id, coalesce(n.cluster, -1) AS cluster, coalesce(least(s.lv, s.peak) / s.peak, 0.0) AS probability FROM v LEFT JOIN inside s ON s.id = v.id LEFT JOIN named n ON n.label = s.label)"""

_SAMPLES, _LEAST = 5, 10
_TREE_SQL = "WITH RECURSIVE" + _PRIM.format(samples=_SAMPLES)
_CLUSTER_SQL = ",".join([_TREE_SQL, _REPLAY.format(least=_LEAST), _CHOICE])


def _clustered(spark, d) -> hierarchy.Clustering:
    return hierarchy.density_clusters(fx.vectors(spark, d).select("id", "features"), min_cluster=_LEAST, min_samples=_SAMPLES)


@query("spanning_tree", "K7", _TREE_SQL + f" SELECT CAST(row_number() OVER (ORDER BY w) AS BIGINT) AS rank, {r('w')} AS weight FROM tree")
def _(spark, d):
    edges = hierarchy.spanning_tree(fx.vectors(spark, d).select("id", "features"), _SAMPLES)
    return ordered_rank(edges, ["weight", "a", "b"], name="rank").select("rank", "weight")


@query("condensed_tree", "K7", ",".join([_TREE_SQL, _REPLAY.format(least=_LEAST)]) + f" SELECT cluster, parent, {r('birth')} AS birth, CAST(size AS BIGINT) AS size, {r('own')} AS own, {r('peak')} AS peak FROM clusters")
def _(spark, d):
    v = fx.vectors(spark, d).select("id", "features")
    return hierarchy.condensed(hierarchy.spanning_tree(v, _SAMPLES), v.select("id"), _LEAST).clusters


@query("density_clusters", "K7", _CLUSTER_SQL + f" SELECT id, CAST(cluster AS BIGINT) AS cluster, {r('probability')} AS probability FROM points")
def _(spark, d):
    return _clustered(spark, d).points


_PICKED = "picked AS (SELECT vec_id AS id FROM embeddings ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100)"


@query(
    "density_cluster_report",
    "K9",
    _CLUSTER_SQL
    + f", {_PICKED} SELECT CAST(p.cluster AS BIGINT) AS cluster, CASE WHEN p.cluster = -1 THEN 'noise' ELSE 'cluster' END AS cluster_type, count(*) AS size, count(k.id) AS n_sampled, {r('CAST(count(k.id) AS DOUBLE) / count(*)', 4)} AS sample_rate, {r('avg(probability)', 4)} AS mean_membership_prob, {r('max(persistence)')} AS persistence FROM points p LEFT JOIN picked k ON k.id = p.id LEFT JOIN named n ON n.cluster = p.cluster GROUP BY p.cluster",
)
def _(spark, d):
    out = _clustered(spark, d)
    return density.cluster_report(out.points, sample.fixed_size(fx.vectors(spark, d).select("id"), 100), persistence=out.clusters)


# -- histogram trees --------------------------------------------------------------------------------
_BINS = 16
_SHARES = ", ".join(str(k / _BINS) for k in range(1, _BINS))
_LEVEL = f"""
WITH {fx.VECTORS}, cell AS (SELECT id, label, unnest(features) AS v, unnest(range(64)) AS feature FROM vectors),
cuts AS (SELECT feature, list_sort(list_distinct(quantile_disc(v, [{_SHARES}]))) AS cuts FROM cell GROUP BY feature),
base AS (SELECT avg(label) AS p FROM vectors),
grad AS (SELECT c.feature, len([x FOR x IN k.cuts IF x < c.v]) AS bin, len(k.cuts) AS n_cuts, k.cuts, sum(p - label) AS g, sum(p * (1 - p)) AS h FROM cell c JOIN cuts k USING (feature), base GROUP BY ALL),
runs AS (
  SELECT feature, bin, n_cuts, cuts[bin + 1] AS value, sum(g) OVER (PARTITION BY feature ORDER BY bin) AS gl, sum(h) OVER (PARTITION BY feature ORDER BY bin) AS hl,
    sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM grad),
gains AS (SELECT feature, bin, value, gl, hl, 0.5 * (gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)) AS gain FROM runs WHERE bin < n_cuts AND hl >= 1 AND ht - hl >= 1)"""


def _level(spark, d):
    df = cut_lineage(fx.vectors(spark, d).select("id", "features", "label"))
    cuts = trees.quantile_cuts(df, _BINS)
    share = df.agg(F.avg("label").alias("p")).first()["p"]
    level = trees.Histograms(cuts, logistic=True)
    return level, trees.table_of_bins(df, cuts, float(np.log(share / (1 - share)))), cuts


@query("boosting_level", "L11", _LEVEL + f" SELECT CAST(feature AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, {r('value')} AS value, {r('gl')} AS g_left, {r('hl')} AS h_left, {r('gain')} AS gain FROM gains")
def _(spark, d):
    """Every cut of the root in the first round, from the sums of one pass."""
    level, rows, cuts = _level(spark, d)
    every = np.arange(len(cuts))
    grown = trees.Growth([trees.Tree.empty(1)], [(0, 0)], {(0, 0): every})
    sums = level.sums(rows, grown, [], grown.open, grown.features)
    schema = "feature long, bin long, value double, g_left double, h_left double, gain double"

    def gains(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for f, s in zip(pdf["feature"], pdf["s"], strict=True):
                c = cuts[f]
                s = np.asarray(s).reshape(2, -1)
                g, h = np.concatenate([s[:, : len(c) + 1], s[:, -1:]], axis=1)
                gain = trees.best_cuts(g, h, 1.0, 0.0, 1.0)[:, 1]
                out += [(int(f), k, float(c[k]), g[: k + 1].sum(), h[: k + 1].sum(), gain[k]) for k in np.flatnonzero(np.isfinite(gain))]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return sums.mapInPandas(gains, schema)


@query("boosting_first_cut", "L11", _LEVEL + f" SELECT CAST(feature AS BIGINT) AS feature, {r('value')} AS value, {r('gain')} AS gain FROM gains ORDER BY round(gains.gain, 9) DESC, gains.feature, bin LIMIT 1")
def _(spark, d):
    """The root of the first tree that boosting grows."""
    level, rows, cuts = _level(spark, d)
    every = np.arange(len(cuts))
    best = level.level(rows, trees.Growth([trees.Tree.empty(1)], [(0, 0)], {(0, 0): every}), [])[0]
    f, k = -best["feature"], -best["bin"]
    return spark.createDataFrame([(f, float(cuts[f][k]), best["gain"])], "feature long, value double, gain double")


# -- linear classifiers -----------------------------------------------------------------------------
@query("logistic_gradient", "L1", "SELECT CAST(unnest(range(64)) AS BIGINT) AS feature, CAST(0.0 AS DOUBLE) AS gradient")
def _(spark, d):
    """Gradient of the summed loss plus the penalty at the fit, for each feature: zero."""
    df = cut_lineage(fx.vectors(spark, d).select("id", "features", "label"))
    model = learners.make("Logistic Regression", C_=1.0).fit(df)
    weights = [float(w) for w in model.inner.coefficients]
    parts = model.transform(df).select(F.posexplode("features").alias("feature", "x"), (F.col("p") - F.col("label")).alias("e"))
    own = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("feature") + 1)
    slope = parts.groupBy("feature").agg(F.sum(F.col("e") * F.col("x")).alias("s"))
    return slope.select("feature", (F.round(F.col("s") + own, 2) + 0.0).alias("gradient"))
