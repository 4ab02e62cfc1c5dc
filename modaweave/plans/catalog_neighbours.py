"""Queries for similarity, neighbours, dense regions, diversity and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import density, entropy, infer, neighbours, sample, tokens
from ..session import cut_lineage, scratch_path
from . import fixtures as fx
from .registry import query, r, with_

# -- nearest neighbours ---------------------------------------------------------------------------------------
_NEAR = """unit AS (SELECT id, label, features, sqrt(list_dot_product(features, features)) AS n FROM vectors),
pairs AS (SELECT a.id AS query, b.id AS neighbour, a.label AS truth, b.label AS label,
  1.0 - list_dot_product(a.features, b.features) / (a.n * b.n) AS distance FROM unit a JOIN unit b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), neighbour) AS rank FROM pairs QUALIFY rank <= 20)"""


def _near(spark, d, k=20):
    v = fx.vectors(spark, d)
    return neighbours.with_labels(neighbours.knn(v, k), v)


@query("nearest_neighbours", "K1", with_(fx.VECTORS, _NEAR) + f"SELECT query, neighbour, rank, {r('distance')} AS distance FROM near")
def _(spark, d):
    return neighbours.knn(fx.vectors(spark, d), 20)


@query("nearest_neighbours_partitioned", "K1", with_(fx.VECTORS, _NEAR) + f"SELECT query, neighbour, rank, {r('distance')} AS distance FROM near WHERE rank <= 5")
def _(spark, d):
    return neighbours.knn(fx.vectors(spark, d), 5, broadcast_bytes=0)


@query("neighbour_report", "K2", with_(fx.VECTORS, _NEAR) + "SELECT query, " + r("truth") + " AS truth, " + ", ".join(f"{r(f'max(CASE WHEN rank = {i} THEN distance END)')} AS dist_{i}, max(CASE WHEN rank = {i} THEN neighbour END) AS key_{i}, {r(f'max(CASE WHEN rank = {i} THEN label END)')} AS label_{i}" for i in range(1, 21)) + " FROM near GROUP BY query, truth")
def _(spark, d):
    return neighbours.report(_near(spark, d), 20)


_VOTE = "votes AS (SELECT query, truth, avg(label) AS share FROM near WHERE rank <= 5 GROUP BY query, truth)"


@query("majority_vote", "K3", with_(fx.VECTORS, _NEAR, _VOTE) + f"SELECT query, {r('truth')} AS truth, {r('share')} AS positive_share, {r('CASE WHEN share > 0.5 THEN 1 ELSE 0 END')} AS predicted, (CASE WHEN share > 0.5 THEN 1 ELSE 0 END) = truth AS correct FROM votes")
def _(spark, d):
    return neighbours.majority_vote(_near(spark, d, 5), 5)


_WEIGHTED = "votes AS (SELECT query, truth, rank AS k, sum(label / (distance + 1e-8)) OVER w / sum(1 / (distance + 1e-8)) OVER w AS score FROM near WINDOW w AS (PARTITION BY query ORDER BY rank))"


@query("weighted_votes", "K4", with_(fx.VECTORS, _NEAR, _WEIGHTED) + f"SELECT query, {r('truth')} AS truth, k, {r('score')} AS score, {r('CASE WHEN score >= 0.5 THEN 1 ELSE 0 END')} AS predicted FROM votes")
def _(spark, d):
    return neighbours.weighted_votes(_near(spark, d))


@query(
    "similarity_study_votes",
    "V10",
    with_(fx.VECTORS, _NEAR, _VOTE, "c AS (SELECT count(*) FILTER (truth = 1 AND share > 0.5) AS tp, count(*) FILTER (truth = 0 AND share <= 0.5) AS tn, count(*) FILTER (truth = 0 AND share > 0.5) AS fp, count(*) FILTER (truth = 1 AND share <= 0.5) AS fn FROM votes)")
    + f"SELECT tp, tn, fp, fn, {r('(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)')} AS accuracy, {r('2.0 * tp / (2.0 * tp + fp + fn)')} AS f1 FROM c",
)
def _(spark, d):
    from .studies import similarity_study

    return similarity_study(fx.vectors(spark, d))["votes"].select("tp", "tn", "fp", "fn", "accuracy", "f1")


@query(
    "similarity_study_weighted",
    "V10",
    with_(fx.VECTORS, _NEAR, _WEIGHTED, "cnt AS (SELECT k, score, sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN truth = 1 THEN 0 ELSE 1 END) AS neg FROM votes GROUP BY k, score)", "cum AS (SELECT *, sum(neg) OVER (PARTITION BY k ORDER BY score) - neg AS below FROM cnt)")
    + f"SELECT k, {r('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))', 4)} AS roc_auc FROM cum GROUP BY k",
    digits=4,
)
def _(spark, d):
    from .studies import similarity_study

    return similarity_study(fx.vectors(spark, d))["weighted"].select("k", "roc_auc")


TANIMOTO_SQL = (
    with_(
        "fp AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS b FROM embeddings)",
        "w AS (SELECT id, b, list_sum(b) AS n FROM fp)",
        "p AS (SELECT x.id AS query, y.id AS neighbour, 1.0 - list_dot_product(x.b, y.b) / greatest(x.n + y.n - list_dot_product(x.b, y.b), 1e-8) AS distance FROM w x JOIN w y ON x.id <> y.id)",
    )
    + f"SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), neighbour) AS rank, {r('distance')} AS distance FROM p QUALIFY rank <= 3"
)


@query("tanimoto_nearest", "K5", TANIMOTO_SQL)
def _(spark, d):
    return neighbours.knn(fx.fingerprints(spark, d), 3, vec="bits", metric="tanimoto")


@query("tanimoto_to_centroid", "K5", with_(fx.BITS_SQL, "m AS (SELECT pos, CASE WHEN avg(bit) > 0.5 THEN 1 ELSE 0 END AS c FROM bits GROUP BY pos)") + f"SELECT id, {r('sum(bit * c) / greatest(CAST(sum(bit) + sum(c) - sum(bit * c) AS DOUBLE), 1e-8)')} AS similarity FROM bits JOIN m USING (pos) GROUP BY id")
def _(spark, d):
    fp = fx.fingerprints(spark, d)
    center = entropy.bit_shares(fp).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: (s["p"] > 0.5).cast("tinyint")).alias("c"))  # one row per bit
    return fp.withColumn("c", center.scalar()).select("id", vx.tanimoto("bits", "c").alias("similarity"))


_PICKS = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS b, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
apart AS MATERIALIZED (
  SELECT x.n AS a, list(1.0 - list_dot_product(x.b, y.b) / greatest(list_sum(x.b) + list_sum(y.b) - list_dot_product(x.b, y.b), 1e-8) ORDER BY y.n) AS d FROM v x, v y GROUP BY x.n),
step(pick, place, gap) AS (
  SELECT CAST(1 AS BIGINT), n, [CAST('inf' AS DOUBLE) FOR i IN range((SELECT count(*) FROM v))] FROM (SELECT n FROM v ORDER BY md5('42|' || CAST(id AS VARCHAR)), id LIMIT 1)
  UNION ALL
  SELECT pick + 1, list_position(now, list_max(now)), now
  FROM (SELECT pick, [CASE WHEN j = s.place OR s.gap[j] < 0 THEN -1.0 ELSE least(s.gap[j], t.d[j]) END FOR j IN range(1, len(s.gap) + 1)] AS now FROM step s JOIN apart t ON t.a = s.place WHERE pick < 50))
SELECT v.id, step.pick FROM step JOIN v ON v.n = step.place"""


@query("diverse_pick", "K6", _PICKS)
def _(spark, d):
    return density.maxmin(fx.fingerprints(spark, d), 50)


def _regions_sql(min_cluster: int, min_samples: int) -> str:
    """Components over all pairs within the median core distance."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pair AS (SELECT a.id AS a, b.id AS b, round(list_distance(a.x, b.x), 12) AS d FROM v a JOIN v b ON a.id <> b.id),
core AS (SELECT a AS id, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM pair) WHERE k <= {min_samples} GROUP BY a),
eps AS (SELECT quantile_cont(core, 0.5) AS e FROM core),
link AS (SELECT p.a, p.b FROM pair p JOIN core x ON x.id = p.a JOIN core y ON y.id = p.b CROSS JOIN eps WHERE greatest(p.d, x.core, y.core) <= e),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
big AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS cluster FROM comp GROUP BY c HAVING count(*) >= {min_cluster})
SELECT id, CAST(coalesce(cluster, -1) AS BIGINT) AS cluster, {r("CASE WHEN cluster IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - core / e)) END")} AS probability
FROM comp JOIN core USING (id) LEFT JOIN big USING (c) CROSS JOIN eps"""


@query("dense_regions", "K7", _regions_sql(10, 5))
def _(spark, d):
    v = fx.vectors(spark, d).select("id", "features")
    return density.dense_regions(v, min_cluster=10, min_samples=5)


@query("reduced_before_clustering", "K8")
def _(spark, d):
    from ..operators.fuse import pca

    v = fx.vectors(spark, d).select("id", "features")
    out = pca(v, 10).transform(v)
    return out.select("id", *[F.col("features")[i].alias(f"c{i}") for i in range(10)])


_CLUSTERS = """clusters AS (SELECT vec_id AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, CASE WHEN label = 9 THEN 0.0 ELSE (label + 1) / 10.0 END::DOUBLE AS probability FROM embeddings),
picked AS (SELECT vec_id AS id FROM embeddings ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100)"""


def _clusters(spark, d):
    c = F.when(F.col("cls") == 9, -1).otherwise(F.col("cls"))
    p = F.when(F.col("cls") == 9, 0.0).otherwise((F.col("cls") + 1) / 10.0)
    return fx.fingerprints(spark, d).select("id", c.alias("cluster"), p.alias("probability"), "bits")


@query(
    "cluster_report",
    "K9",
    with_(_CLUSTERS)
    + f"SELECT CAST(cluster AS BIGINT) AS cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster' END AS cluster_type, count(*) AS size, count(p.id) AS n_sampled, {r('CAST(count(p.id) AS DOUBLE) / count(*)', 4)} AS sample_rate, {r('avg(probability)', 4)} AS mean_membership_prob FROM clusters c LEFT JOIN picked p ON c.id = p.id GROUP BY cluster",
)
def _(spark, d):
    c = _clusters(spark, d)
    return density.cluster_report(c.drop("bits"), sample.fixed_size(c.select("id"), 100))


@query("cluster_profile", "K10", with_(_CLUSTERS, "s AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster)") + f"SELECT count(*) FILTER (cluster >= 0) AS clusters, min(n) FILTER (cluster >= 0) AS min_size, {r('median(n) FILTER (cluster >= 0)')} AS median_size, max(n) FILTER (cluster >= 0) AS max_size, {r('CAST(sum(n) FILTER (cluster < 0) AS DOUBLE) / sum(n)')} AS noise_share FROM s")
def _(spark, d):
    return density.cluster_profile(_clusters(spark, d))


@query("density_sample_surest", "S25")
def _(spark, d):
    c = _clusters(spark, d)
    n = c.count()
    return density.density_sample(c.drop("bits"), c.select("id", "bits"), density.target_size(n, 0.2))


@query("representative_subset", "K11 S25")
def _(spark, d):
    fp = fx.fingerprints(spark, d)
    _, subset, rep = density.representative_subset(fp, fraction=0.1, components=10, min_cluster=10, min_samples=5)
    total = subset.agg(F.count("*").alias("n"))
    return rep.withColumn("subset_rows", total.scalar())


@query("mean_cosine", "K12", with_(fx.CELLS) + f"SELECT {r('avg(c)')} AS cosine FROM (SELECT id, sum(v * (v + 0.1 * (pos % 3))) / (sqrt(sum(v * v)) * sqrt(sum((v + 0.1 * (pos % 3)) ** 2))) AS c FROM cells GROUP BY id)")
def _(spark, d):
    moved = F.transform("features", lambda x, i: x + 0.1 * (i % 3))
    return fx.vectors(spark, d).agg(F.avg(vx.cosine("features", moved)).alias("cosine"))


# -- entropy ----------------------------------------------------------------------------------------------------------
def _entropy_sql(counts):
    return f"SELECT {r('-sum(n / t * log2(n / t))')} AS entropy, count(*) AS bins FROM (SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER () AS t FROM ({counts}) WHERE n > 0)"


@query("count_entropy", "E1", _entropy_sql("SELECT event_type, count(*) AS n FROM events GROUP BY event_type"))
def _(spark, d):
    return entropy.of_column(fx.table(spark, d, "events"), "event_type")


@query("maximum_entropy", "E2", f"SELECT {r('log2(count(DISTINCT source))')} AS maximum, {r('log2(count(DISTINCT lang))')} AS languages FROM documents")
def _(spark, d):
    h = lambda c: F.log2(F.count_distinct(c).cast("double"))
    return fx.table(spark, d, "documents").agg(h("source").alias("maximum"), h("lang").alias("languages"))


_SHARES = "shares AS (SELECT pos, avg(bit) AS p FROM bits GROUP BY pos), h AS (SELECT pos, p, CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END AS h FROM shares)"


@query("per_bit_entropy", "E3", with_(fx.BITS_SQL, _SHARES) + f"SELECT pos, {r('p')} AS p, {r('h')} AS entropy FROM h")
def _(spark, d):
    return entropy.per_bit(fx.fingerprints(spark, d))


@query("per_bit_summary", "E3", with_(fx.BITS_SQL, _SHARES) + f"SELECT {r('avg(h)')} AS mean_entropy, {r('avg(CASE WHEN h > 0.05 THEN 1.0 ELSE 0.0 END)')} AS informative_share FROM h")
def _(spark, d):
    return entropy.per_bit_summary(fx.fingerprints(spark, d))


_TOTALS = "totals AS (SELECT id, CAST(sum(bit) AS DOUBLE) AS x FROM bits GROUP BY id), edge AS (SELECT min(x) AS lo, max(x) AS hi FROM totals)"


@query("bit_count_entropy", "E4", with_(fx.BITS_SQL, _TOTALS) + _entropy_sql("SELECT least(floor(round((x - lo) * 20 / (hi - lo), 9)), 19) AS b, count(*) AS n FROM totals CROSS JOIN edge GROUP BY 1"))
def _(spark, d):
    return entropy.bit_count(fx.fingerprints(spark, d))


@query(
    "distance_entropy",
    "E5 J11",
    with_(
        "fp AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS b FROM embeddings ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 5000)",
        "w AS (SELECT id, b, list_sum(b) AS n FROM fp)",
        "p AS (SELECT 1.0 - list_dot_product(x.b, y.b) / greatest(x.n + y.n - list_dot_product(x.b, y.b), 1e-8) AS dist FROM w x JOIN w y ON x.id < y.id)",
    )
    + _entropy_sql("SELECT least(floor(round(dist * 50, 9)), 49) AS b, count(*) AS n FROM p GROUP BY 1"),
)
def _(spark, d):
    return entropy.distance(fx.fingerprints(spark, d), sample=5000)


@query("bit_frequency_entropy", "E6", with_(fx.BITS_SQL, _SHARES) + _entropy_sql("SELECT least(floor(round(p * 50, 9)), 49) AS b, count(*) AS n FROM shares GROUP BY 1"))
def _(spark, d):
    return entropy.bit_frequency(fx.fingerprints(spark, d))


@query("entropy_retention", "E7")
def _(spark, d):
    fp = cut_lineage(fx.fingerprints(spark, d))
    return entropy.retention_report(fp, sample.fixed_size(fp, density.target_size(fp.count(), 0.4)), sample=5000)


@query("group_entropy", "E8", _entropy_sql("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand"))
def _(spark, d):
    return entropy.of_column(fx.table(spark, d, "part"), "p_brand")


# -- tokens ---------------------------------------------------------------------------------------------------------------
_TOK = f"{fx.WORDS}, tok AS (SELECT id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM words)"
_VOCAB = "cnt AS (SELECT token, count(*) AS n FROM tok WHERE token NOT IN ('<pad>', '<other>') GROUP BY token), vocab AS (SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS token_id, n FROM cnt WHERE n >= 5)"


def _vocab(spark, d, min_freq=5):
    return tokens.build_vocab(tokens.token_counts(fx.texts(spark, d), "tokens"), min_freq)


@query("vocabulary", "W1 W2", with_(_TOK, _VOCAB) + "SELECT token, token_id, n FROM vocab UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<other>', 1, 0")
def _(spark, d):
    return _vocab(spark, d)


@query("token_counts", "W2", with_(_TOK) + "SELECT token, count(*) AS n FROM tok GROUP BY token")
def _(spark, d):
    return tokens.token_counts(fx.texts(spark, d), "tokens")


@query(
    "vocabulary_merge",
    "W3",
    with_(
        "tok AS (SELECT unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> '')) AS token, 'd' AS side FROM documents UNION ALL SELECT unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> '')), 'c' FROM conversations)",
        "cnt AS (SELECT side, token, count(*) AS n FROM tok WHERE token NOT IN ('<pad>', '<other>') GROUP BY side, token HAVING count(*) >= 3)",
        "v AS (SELECT side, token, 1 + row_number() OVER (PARTITION BY side ORDER BY n DESC, token) AS token_id, n FROM cnt)",
        "a AS (SELECT * FROM v WHERE side = 'd'), b AS (SELECT * FROM v WHERE side = 'c')",
    )
    + "SELECT a.token, a.token_id, a.n + coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.token = b.token UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<other>', 1, 0 UNION ALL "
    + "SELECT token, (SELECT max(token_id) FROM a) + row_number() OVER (ORDER BY token_id, token), n FROM b WHERE token NOT IN (SELECT token FROM a)",
)
def _(spark, d):
    talk = fx.table(spark, d, "conversations").select(tokens.words("text").alias("tokens"))
    return tokens.extend_vocab(cut_lineage(_vocab(spark, d, 3)), cut_lineage(tokens.build_vocab(tokens.token_counts(talk, "tokens"), 3)))


def _encoded(spark, d):
    return tokens.encode(fx.texts(spark, d), "tokens", cut_lineage(_vocab(spark, d)))


_CODES = "codes AS (SELECT t.id, t.pos, coalesce(v.token_id, 1) AS code FROM tok t LEFT JOIN vocab v ON t.token = v.token)"


@query("encoded_sequences", "W4", with_(_TOK, _VOCAB, _CODES) + "SELECT id, count(*) AS length, CAST(sum(code * (pos + 1)) AS BIGINT) AS checksum FROM codes GROUP BY id")
def _(spark, d):
    total = F.aggregate(F.transform("token_ids", lambda t, i: t * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _encoded(spark, d).filter("length > 0").select("id", "length", total.alias("checksum"))


@query(
    "masked_labels",
    "W5",
    with_(_TOK, _VOCAB, _CODES, "m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || CAST(id AS VARCHAR) || '#' || CAST(pos AS VARCHAR))) AS rk, count(*) OVER (PARTITION BY id) AS n FROM codes)")
    + "SELECT id, CAST(ceil(round(max(n) * 0.15, 9)) AS BIGINT) AS masked, CAST(sum(CASE WHEN rk <= ceil(round(n * 0.15, 9)) THEN code * (pos + 1) ELSE 0 END) AS BIGINT) AS checksum FROM m GROUP BY id",
)
def _(spark, d):
    total = F.aggregate(F.transform("labels", lambda t, i: t * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return tokens.mask_labels(_encoded(spark, d)).select("id", "masked", total.alias("checksum"))


@query(
    "context_tokens",
    "W6",
    with_(
        _TOK,
        "nb AS (SELECT id, pos, token, lag(token) OVER w AS l, lead(token) OVER w AS rt FROM tok WINDOW w AS (PARTITION BY id ORDER BY pos))",
        "ctx AS (SELECT id, pos, token || CASE WHEN l IS NULL AND rt IS NULL THEN '' WHEN l IS NULL THEN '_' || rt || '1' WHEN rt IS NULL THEN '_' || l || '1' WHEN l = rt THEN '_' || l || '2' ELSE '_' || least(l, rt) || '1_' || greatest(l, rt) || '1' END AS context FROM nb)",
    )
    + "SELECT context, count(*) AS n FROM ctx GROUP BY context",
)
def _(spark, d):
    return tokens.count_rare(tokens.context_tokens(fx.texts(spark, d), "tokens"), "context")


# Named text patterns used as multi-hot flags (fixed values).
PATTERNS = {"has_email": "[a-z0-9.]+@[a-z0-9.]+", "has_url": "https?://", "has_digits": "[0-9]{3,}", "has_license": "(?i)license", "has_question": "[?]"}


@query("pattern_flags", "W7", "SELECT doc_id AS id, " + ", ".join(f"CAST(regexp_matches(text, '{rx}') AS BIGINT) AS {n}" for n, rx in PATTERNS.items()) + " FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return tokens.pattern_flags(docs, "text", PATTERNS).drop("text")


@query(
    "hashed_fingerprints",
    "W8",
    with_(
        fx.WORDS,
        "sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(tokens) < 2 THEN [array_to_string(tokens, ' ')] ELSE list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) END) AS s FROM words))",
        "sl AS (SELECT id, CAST(('0x' || substr(md5(s), 1, 8))::BIGINT % 2048 AS BIGINT) AS slot FROM sh)",
    )
    + "SELECT id, slot, count(*) AS n FROM sl GROUP BY id, slot",
)
def _(spark, d):
    return tokens.fingerprint_slots(fx.texts(spark, d), "tokens")


@query("generated_features", "W9", f"SELECT doc_id AS id, {r('length(text)')} AS n_chars, {r('len(list_filter(string_split(lower(text), {q} {q}), lambda t: t <> {q}{q}))'.format(q=chr(39)))} AS n_words FROM documents")
def _(spark, d):
    g = tokens.generator("length")(F.col("text"))
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), g[0].alias("n_chars"), g[1].alias("n_words"))


_F0 = r("(CAST(('0x' || substr(sha256(text), 1, 2)) AS BIGINT) + 256 * CAST(('0x' || substr(sha256(text), 3, 2)) AS BIGINT)) / 65536.0")


@query("batch_inference", "W10", f"SELECT doc_id AS id, {_F0} AS f0, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    good, bad = infer.good_and_rejects(infer.embed(docs, "text", infer.hash_model(4)))
    rows = [good.select("id", F.col("features")[0].alias("f0"), F.lit(None).cast("string").alias("error")), bad.select("id", F.lit(None).cast("double").alias("f0"), "error")]
    return reduce(DataFrame.unionByName, rows)


@query("masked_mean_pool", "W11", with_(fx.CELLS) + f"SELECT CAST(cls AS BIGINT) AS cls, pos, {r('avg(v)')} AS value FROM cells WHERE label = 1 GROUP BY cls, pos")
def _(spark, d):
    return tokens.masked_mean_pool(fx.vectors(spark, d), "cls", "features", "label")


@query("inference_over_distinct", "W12", f"SELECT doc_id AS id, {_F0} AS f0 FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return infer.embed_distinct(docs, "text", infer.hash_model(4)).select("id", F.col("features")[0].alias("f0"))


@query("descriptor_job", "W13", "SELECT 'length' AS descriptor, 'done' AS status, count(*) AS rows FROM documents UNION ALL SELECT 'character_share', 'done', count(*) FROM documents UNION ALL SELECT 'never_registered', 'failed: ValueError', 0")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return infer.describe_all(docs, "text", ["length", "character_share", "never_registered"], scratch_path(spark, "descriptors"))


# -- streams ----------------------------------------------------------------------------------------------------------------
@query("stream_ingest", "ST1", "SELECT event_type, count(*) AS n, " + r("sum(value)", 2) + " AS total FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AND value >= 1 GROUP BY event_type", digits=2)
def _(spark, d):
    from ..streaming import ingest

    schema = fx.table(spark, d, "events").schema
    stream = ingest.file_stream(spark, d, schema, "events.parquet")
    ids = fx.table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "rejects")
    ingest.ingest(stream, ids, "user_id", F.col("value") >= 1, good, bad)
    return spark.read.parquet(good).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("stream_rejects", "ST1", "SELECT CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'unknown id' ELSE 'invalid value' END AS reason, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) OR value < 1 GROUP BY 1")
def _(spark, d):
    from ..streaming import ingest

    stream = ingest.file_stream(spark, d, fx.table(spark, d, "events").schema, "events.parquet")
    ids = fx.table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "rejects")
    ingest.ingest(stream, ids, "user_id", F.col("value") >= 1, good, bad)
    return spark.read.parquet(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("stream_moments", "ST2 F2", "SELECT count(*) AS n, " + ", ".join(f"{r(f'sum(embedding[{i + 1}])', 3)} AS s{i}" for i in range(4)) + f", {r('sum(CAST(embedding[1] AS DOUBLE) * embedding[2])', 3)} AS x01 FROM embeddings", digits=3)
def _(spark, d):
    from ..streaming import ingest

    schema = fx.table(spark, d, "embeddings").schema
    m = ingest.accumulate_moments(ingest.file_stream(spark, d, schema, "embeddings.parquet"), "embedding", scratch_path(spark, "moments"))
    return spark.createDataFrame([(m.n, *[float(x) for x in m.total[:4]], float(m.raw[0, 1]))], "n bigint, s0 double, s1 double, s2 double, s3 double, x01 double")


@query("stream_running_counts", "ST3", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def _(spark, d):
    from ..streaming import ingest

    out = scratch_path(spark, "counts")
    ingest.running_counts(ingest.file_stream(spark, d, fx.table(spark, d, "events").schema, "events.parquet"), ["event_type", "user_id"], out)
    return spark.read.parquet(out)


@query("stream_scoring", "ST4", f"SELECT doc_id, {_F0} AS f0 FROM documents")
def _(spark, d):
    from ..streaming import ingest

    out = scratch_path(spark, "scored")
    stream = ingest.file_stream(spark, d, fx.table(spark, d, "documents").schema, "documents.parquet")
    ingest.score_stream(stream, "text", infer.hash_model(4), "doc_id", out)
    return spark.read.parquet(out).select("doc_id", F.col("features")[0].alias("f0"))
