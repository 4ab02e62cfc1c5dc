"""Queries for folds, hold-outs, group splits, sampling and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groupsplit, profile, sample, split
from . import fixtures as fx
from .registry import query, r, with_

H = lambda c, s=42: f"md5('{s}|' || CAST({c} AS VARCHAR))"


def _docs(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")


def _lab(spark, d):
    return fx.table(spark, d, "labels").withColumnRenamed("doc_id", "id")


@query("kfold_shuffled", "S1", f"SELECT doc_id AS id, ntile(5) OVER (ORDER BY {H('doc_id')}, doc_id) - 1 AS fold FROM documents")
def _(spark, d):
    return split.kfold(_docs(spark, d).select("id"), 5)


@query("kfold_contiguous", "S2", "SELECT doc_id AS id, ntile(7) OVER (ORDER BY n_chars, doc_id) - 1 AS fold FROM documents")
def _(spark, d):
    return split.contiguous_kfold(_docs(spark, d).select("id", "n_chars"), 7, ["n_chars", "id"]).select("id", "fold")


@query(
    "kfold_stratified_seeds",
    "S3",
    with_("s AS (SELECT unnest([42, 123, 456]) AS seed)") + "SELECT doc_id AS id, CAST(seed AS BIGINT) AS seed, ntile(5) OVER (PARTITION BY seed, toxic ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS fold FROM labels CROSS JOIN s",
)
def _(spark, d):
    return split.stratified_kfold(_lab(spark, d).select("id", "toxic"), 5, "toxic").select("id", "seed", "fold")


def _cut(key, share, by=""):
    over = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({over}ORDER BY {H(key)}, {key}) <= floor(round({share} * count(*) OVER ({over.strip()}), 6))"


@query("holdout_random", "S4", "SELECT doc_id AS id, CASE WHEN " + _cut("doc_id", "0.75") + " THEN 'train' ELSE 'test' END AS split FROM documents")
def _(spark, d):
    return split.holdout(_docs(spark, d).select("id"), 0.25)


@query("holdout_stratified", "S5", "SELECT doc_id AS id, CASE WHEN " + _cut("doc_id", "0.8", "toxic") + " THEN 'train' ELSE 'test' END AS split FROM labels")
def _(spark, d):
    return split.holdout(_lab(spark, d), 0.2, stratify="toxic").select("id", "split")


@query("train_valid_test", "S6", "SELECT doc_id AS id, CASE WHEN " + _cut("doc_id", "0.8") + " THEN 'train' WHEN " + _cut("doc_id", "0.9") + " THEN 'valid' ELSE 'test' END AS split FROM documents")
def _(spark, d):
    return split.train_valid_test(_docs(spark, d).select("id"))


@query("split_invariants", "S6", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, CAST(0 AS BIGINT) AS overlap FROM documents")
def _(spark, d):
    return split.invariants(split.train_valid_test(_docs(spark, d).select("id")))


@query("train_valid_test_stratified", "S7", "SELECT doc_id AS id, CASE WHEN " + _cut("doc_id", "0.8", "lang") + " THEN 'train' WHEN " + _cut("doc_id", "0.9", "lang") + " THEN 'valid' ELSE 'test' END AS split FROM documents")
def _(spark, d):
    return split.train_valid_test(_docs(spark, d), stratify="lang").select("id", "split")


# -- groups: events by user -------------------------------------------------------------------------------------
_GROUPS = "g AS (SELECT user_id AS grp, count(*) AS size, min(event_id) AS first_id FROM events GROUP BY user_id), n AS (SELECT count(*) AS n FROM events)"


def _events(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("grp"))


def _per_group(df):
    return df.groupBy("grp").agg(F.min("split").alias("split"), F.count("*").alias("size"), F.countDistinct("split").alias("splits"))


def _greedy(order, rules):
    """Sequential fill as a recursive query: ``rules`` are (split, condition) over counters a, b, c."""
    names = [s for s, _ in rules]
    pick = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, c in rules[:-1]) + f" ELSE '{names[-1]}' END"
    return f"""WITH RECURSIVE {_GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM g CROSS JOIN n),
f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS grp, CAST(0 AS BIGINT) AS size, CAST('' AS VARCHAR) AS split, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b
  UNION ALL SELECT rn, grp, size, split, a + CASE WHEN split = '{names[0]}' THEN size ELSE 0 END, b + CASE WHEN split = '{names[1]}' THEN size ELSE 0 END
  FROM (SELECT o.rn, o.grp, o.size, {pick} AS split, f.a, f.b FROM f JOIN o ON o.rn = f.rn + 1))
SELECT grp, split, size, CAST(1 AS BIGINT) AS splits FROM f WHERE rn > 0"""


@query("group_split_two_way", "S8 S13", _greedy("size DESC, first_id", [("train", "f.a + o.size <= 0.8 * o.n"), ("test", "true")]))
def _(spark, d):
    return _per_group(groupsplit.two_way(_events(spark, d), "grp"))


@query("group_split_three_way", "S9", _greedy("size DESC, first_id DESC", [("train", "f.a + o.size <= 0.8 * o.n"), ("valid", "f.a + f.b + o.size <= 0.9 * o.n"), ("test", "true")]))
def _(spark, d):
    return _per_group(groupsplit.three_way(_events(spark, d), "grp"))


@query("group_split_random", "S10", _greedy(f"{H('grp')} || '|' || CAST(grp AS VARCHAR)", [("valid", "f.a + o.size <= floor(0.1 * o.n)"), ("test", "f.b + o.size <= floor(0.1 * o.n)"), ("train", "true")]))
def _(spark, d):
    return _per_group(groupsplit.random_groups(_events(spark, d), "grp"))


@query("group_split_balanced", "S11", _greedy(f"(CASE WHEN size > 0.1 * n.n / 2 THEN '0' ELSE '1' END) || {H('grp', 0)} || '|' || CAST(grp AS VARCHAR)", [("train", "f.a + o.size <= 0.8 * o.n"), ("valid", "f.b + o.size <= 0.1 * o.n"), ("test", "true")]))
def _(spark, d):
    return _per_group(groupsplit.balanced_groups(_events(spark, d), "grp"))


@query("group_split_size_ordered", "S11", _greedy("size DESC, first_id", [("train", "f.a + o.size <= 0.8 * o.n"), ("valid", "f.b + o.size <= 0.1 * o.n"), ("test", "true")]))
def _(spark, d):
    return _per_group(groupsplit.size_ordered(_events(spark, d), "grp"))


@query("group_members", "S12", "SELECT DISTINCT source, doc_id AS member FROM documents")
def _(spark, d):
    return groupsplit.members(_docs(spark, d), "source", "id")


@query("predetermined_folds", "S14", with_("f AS (SELECT doc_id AS id, ntile(5) OVER (ORDER BY " + H("doc_id") + ", doc_id) - 1 AS fold FROM labels)") + "SELECT d.doc_id AS id, CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'valid' ELSE 'train' END AS split FROM documents d LEFT JOIN f ON d.doc_id = f.id")
def _(spark, d):
    return split.predetermined(_docs(spark, d).select("id"), split.kfold(_lab(spark, d).select("id"), 5), 0, 1)


@query(
    "split_over_modalities",
    "S15",
    with_(fx.COMMON, "s AS (SELECT id, CASE WHEN " + _cut("id", "0.8") + " THEN 'train' ELSE 'test' END AS split FROM common)")
    + " UNION ALL ".join(f"SELECT '{m}' AS modality, split, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM {m} JOIN s USING (id) GROUP BY split" for m in ("account", "ordering", "activity")),
)
def _(spark, d):
    from functools import reduce

    ms = fx.modalities(spark, d)
    parts = split.apply_split(ms.tables, split.holdout(ms.common_ids()))
    rows = [t.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum")).withColumn("modality", F.lit(n)) for n, t in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "learning_fractions",
    "S16",
    with_("rk AS (SELECT doc_id AS id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY " + H("doc_id") + ", doc_id) AS rk, count(*) OVER (PARTITION BY toxic) AS n FROM labels)", "f AS (SELECT unnest([0.1, 0.25, 0.5, 0.75]) AS fraction)")
    + f"SELECT id, CAST(toxic AS BIGINT) AS toxic, {r('fraction')} AS fraction FROM rk CROSS JOIN f WHERE rk <= floor(round(fraction * n, 6))",
)
def _(spark, d):
    return split.learning_fractions(_lab(spark, d).select("id", "toxic"), "toxic")


@query("undersampled", "S17", with_("rk AS (SELECT doc_id AS id, quality, row_number() OVER (PARTITION BY quality ORDER BY " + H("doc_id") + ", doc_id) AS rk FROM labels)") + "SELECT id, CAST(quality AS BIGINT) AS quality FROM rk WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))")
def _(spark, d):
    return sample.undersample(_lab(spark, d).select("id", "quality"), "quality")


def _rare(spark, d):
    """Two classes of vectors, about one to nine."""
    return fx.vectors(spark, d).select("id", (F.col("cls") == 0).cast("int").alias("label"), "features")


_RARE = "c AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM embeddings GROUP BY 1)"


@query("smote", "S18", with_(_RARE) + "SELECT label, false AS synthetic, n FROM c UNION ALL SELECT arg_min(label, n), true, max(n) - min(n) FROM c HAVING max(n) > min(n)")
def _(spark, d):
    return sample.smote(_rare(spark, d)).groupBy("label", "synthetic").agg(F.count("*").alias("n"))


@query("borderline_smote", "S19")
def _(spark, d):
    return sample.borderline_smote(_rare(spark, d), m=20).groupBy("label", "synthetic").agg(F.count("*").alias("n"))


@query("smote_enn", "S20")
def _(spark, d):
    return sample.smote_enn(_rare(spark, d)).groupBy("label", "synthetic").agg(F.count("*").alias("n"))


_DECISION = "CASE WHEN classes < 2 THEN 'single class' WHEN ir <= 2 AND minority > 200 THEN 'class weights' WHEN ir > 2 AND ir <= 5 AND minority > 200 THEN 'smote' WHEN ir > 5 AND ir <= 10 AND minority > 200 THEN 'borderline smote' WHEN ir > 10 AND ir <= 50 AND minority BETWEEN 100 AND 500 THEN 'smote-enn' WHEN ir > 50 AND ir <= 200 AND minority < 500 THEN 'balanced ensemble' WHEN ir > 200 AND minority < 500 THEN 'cost weight' ELSE 'class weights' END"


@query(
    "resampling_decision",
    "S21",
    with_("c AS (SELECT 'event ' || a.event_type AS task, CASE WHEN e.event_type = a.event_type AND e.value > 50 THEN 1 ELSE 0 END AS y, count(*) AS n FROM events e CROSS JOIN (SELECT DISTINCT event_type FROM events) a GROUP BY 1, 2)", "b AS (SELECT task, count(*) AS classes, min(n) AS minority, CAST(max(n) AS DOUBLE) / min(n) AS ir FROM c GROUP BY task)")
    + f"SELECT task, minority, {_DECISION} AS strategy FROM b",
)
def _(spark, d):
    e = fx.table(spark, d, "events")
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("k"))  # the five event types
    rows = e.select("event_type", "value", F.explode(kinds.scalar()).alias("k"))
    y = ((F.col("event_type") == F.col("k")) & (F.col("value") > 50)).cast("int")
    bal = profile.class_balance(rows.select(F.concat(F.lit("event "), "k").alias("task"), y.alias("y")), "y", ["task"])
    return profile.resampling_decision(bal).select("task", "minority", "strategy")


@query("fixed_size_sample", "S22", f"SELECT o_orderkey AS id FROM orders ORDER BY {H('o_orderkey')}, o_orderkey LIMIT 1000")
def _(spark, d):
    return sample.fixed_size(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 1000)


def _strata_sql(budget, n):
    edges = ", ".join(f"quantile_cont(size, {i / n})" + (" + 1" if i == n else "") + f" AS e{i}" for i in range(n + 1))
    stratum = "CASE " + " ".join(f"WHEN size >= e{i} AND size < e{i + 1} THEN {i}" for i in range(n)) + " END"
    return (
        with_(
            fx.PARTS,
            f"e AS (SELECT {edges} FROM parts)",
            f"t AS (SELECT id, {stratum} AS stratum FROM parts CROSS JOIN e)",
            f"k AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {H('id')}, id) AS rk, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM t)",
            f"q AS (SELECT *, least(greatest(CAST(round_even(n / total * {budget}, 0) AS BIGINT), 1), n) AS quota FROM k)",
            "p AS (SELECT id, stratum, row_number() OVER (ORDER BY stratum, rk) AS pos FROM q WHERE rk <= quota)",
        )
        + f"SELECT id, CAST(stratum AS BIGINT) AS stratum FROM p WHERE pos <= {budget}"
    )


@query("stratified_by_quantile", "S23", _strata_sql(300, 20))
def _(spark, d):
    return sample.stratified_by_quantile(fx.parts(spark, d).select("id", "size"), "size", 300).select("id", "stratum")


@query(
    "log_weighted_quotas",
    "S24",
    with_("g AS (SELECT user_id AS cluster, count(*) AS size FROM events GROUP BY user_id)", "q AS (SELECT *, CAST(round_even(ln(1 + size) / sum(ln(1 + size)) OVER () * 2000, 0) AS BIGINT) AS quota, row_number() OVER (ORDER BY size DESC, cluster) AS rn FROM g)")
    + "SELECT cluster, size, quota + CASE WHEN rn = 1 THEN 2000 - CAST((SELECT sum(quota) FROM q) AS BIGINT) ELSE 0 END AS quota FROM q",
)
def _(spark, d):
    sizes = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("cluster")).agg(F.count("*").alias("size"))
    return sample.log_quotas(sizes, 2000)


@query("seeded_shuffle", "S26", f"SELECT c_custkey AS id, row_number() OVER (ORDER BY {H('c_custkey', 7)}, c_custkey) AS position FROM customer")
def _(spark, d):
    from ..operators.ranking import hash_rank

    return hash_rank(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", seed=7, name="position")


@query("cost_weights", "S27", f"SELECT doc_id AS id, {r('CASE WHEN toxic = 1 THEN round((SELECT CAST(max(c) AS DOUBLE) / min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))) ELSE 1 END')} AS weight FROM labels")
def _(spark, d):
    return sample.cost_weights(_lab(spark, d), "toxic").select("id", "weight")
