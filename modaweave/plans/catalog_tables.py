"""Queries for joins, profiling, imputation, scaling and transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.vectors import vsum
from ..operators import impute, joins, profile, scale, wide
from . import fixtures as fx
from .registry import query, r, with_

FEATS = {"account": ["balance", "nation"], "ordering": ["n_orders", "mean_price", "top_urgent"], "activity": ["n_events", "mean_value", "big_purchase"]}


# -- joins ------------------------------------------------------------------------------------------------
@query("keep_common_samples", "J1", with_(fx.COMMON) + " UNION ALL ".join(f"SELECT '{m}' AS modality, id, {r(f[0])} AS first FROM {m} WHERE id IN (SELECT id FROM common)" for m, f in FEATS.items()))
def _(spark, d):
    kept = fx.modalities(spark, d).keep_common()
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("modality"), "id", F.col(FEATS[n][0]).alias("first")) for n, t in kept.tables.items()])


@query("sorted_common_ids", "J2", with_(fx.COMMON) + "SELECT id, row_number() OVER (ORDER BY id) AS position FROM common")
def _(spark, d):
    from ..operators.ranking import ordered_rank

    ids = joins.common_ids(list(fx.modalities(spark, d).tables.values()))
    return ordered_rank(ids, ["id"], name="position").orderBy("id")


@query("labels_to_embeddings", "J3", f"SELECT l.doc_id AS id, CAST(quality AS BIGINT) AS quality, {r('embedding[1]')} AS first FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id")
def _(spark, d):
    lab = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return joins.align(lab, fx.vectors(spark, d), "id").select("id", "quality", F.col("features")[0].alias("first"))


@query("rows_with_known_ids", "J4", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def _(spark, d):
    users = fx.table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return joins.keep_ids(fx.table(spark, d, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


@query("missing_ids", "J5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return joins.missing_ids(fx.table(spark, d, "documents").select("doc_id"), fx.table(spark, d, "labels"), "doc_id")


_WIDE = "wide AS (SELECT a.id, balance, nation, n_orders, mean_price, top_urgent, n_events, mean_value, big_purchase FROM account a JOIN ordering o ON a.id = o.id JOIN activity e ON a.id = e.id)"
_ALL = [f for fs in FEATS.values() for f in fs]


@query("wide_concat", "J6", with_(fx.MODALITIES, _WIDE) + "SELECT id, " + ", ".join(f"{r(c)} AS {c}" for c in _ALL) + " FROM wide")
def _(spark, d):
    out = fx.modalities(spark, d).assemble()
    return out.select("id", *[F.col("features")[i].alias(c) for i, c in enumerate(_ALL)])


@query("merge_on_entity", "J7", "SELECT a.source AS entity, count(*) AS n FROM documents a JOIN (SELECT source, lang FROM documents GROUP BY source, lang) b ON a.source = b.source GROUP BY 1")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    # Counting each side before the join keeps the many-to-many result from being built.
    left = docs.groupBy("source").agg(F.count("*").alias("a"))
    right = docs.select("source", "lang").distinct().groupBy("source").agg(F.count("*").alias("b"))
    return left.join(right, "source").select(F.col("source").alias("entity"), (F.col("a") * F.col("b")).alias("n"))


@query("entity_to_id_lookup", "J8", with_("m AS (SELECT text, max(doc_id) AS last_id FROM documents GROUP BY text)") + "SELECT d.doc_id, m.last_id FROM documents d JOIN m ON d.text = m.text")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    mapping = docs.select("key", F.col("doc_id").alias("last_id"))
    return joins.lookup_last(docs, mapping, "key", "last_id", "last_id").select("doc_id", "last_id")


@query("scattered_predictions", "J9", with_(fx.SCORED) + f"SELECT d.doc_id AS id, {r('p')} AS p FROM documents d LEFT JOIN scored s ON d.doc_id = s.id")
def _(spark, d):
    inputs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return joins.scatter(inputs, fx.scored(spark, d).select("id", "p"), "id")


@query(
    "modality_pairs",
    "J10",
    with_(fx.MODALITIES)
    + "SELECT 'account' AS a, 'ordering' AS b, count(*) AS common FROM account JOIN ordering USING (id) UNION ALL "
    + "SELECT 'account', 'activity', count(*) FROM account JOIN activity USING (id) UNION ALL SELECT 'ordering', 'activity', count(*) FROM ordering JOIN activity USING (id)",
)
def _(spark, d):
    ms = fx.modalities(spark, d)
    rows = [joins.common_ids([ms.tables[a], ms.tables[b]]).agg(F.count("*").alias("common")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "common") for a, b in ms.pairs()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "leave_one_modality_out",
    "J12",
    with_(fx.MODALITIES, _WIDE)
    + " UNION ALL ".join(
        f"SELECT '{m}' AS held_out, id, CAST({len(_ALL) - len(f)} AS BIGINT) AS width, {r(' + '.join(f'coalesce({c}, 0)' for c in _ALL if c not in f), 4)} AS total FROM wide"
        for m, f in FEATS.items()
    ).replace("FROM wide", "FROM wide", 1),
    digits=4,
)
def _(spark, d):
    # Inner alignment over all modalities first, as every pairing shares the same rows.
    out = []
    for name, rest in fx.modalities(spark, d).keep_common().leave_one_out().items():
        out.append(rest.select(F.lit(name).alias("held_out"), "id", F.size("rest").alias("width"), vx.vsum(vx.nan_to("rest")).alias("total")))
    return reduce(DataFrame.unionByName, out)


@query("stacked_results", "J13", "SELECT 'customer' AS source, c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, CAST(s_nationkey AS BIGINT) FROM supplier")
def _(spark, d):
    a = fx.table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = fx.table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return joins.stack([a, b])


@query(
    "ablation_sets",
    "J14",
    with_(fx.MODALITIES)
    + "SELECT 'first 1' AS variant, count(*) AS rows, CAST(2 AS BIGINT) AS width FROM account UNION ALL "
    + "SELECT 'first 2', count(*), 5 FROM account JOIN ordering USING (id) UNION ALL SELECT 'without account', count(*), 6 FROM ordering JOIN activity USING (id) UNION ALL "
    + "SELECT 'account replaced', count(*), 7 FROM (SELECT c_custkey AS id FROM customer) c JOIN ordering USING (id) JOIN activity USING (id)",
)
def _(spark, d):
    ms = fx.modalities(spark, d)
    swap = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.length("c_name").alias("name_length"))
    sets = {"first 1": ms.first(1), "first 2": ms.first(2), "without account": ms.without("account"), "account replaced": ms.subsets_replacing({"account": swap})["account"]}
    rows = [s.assemble().agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width")).select(F.lit(n).alias("variant"), "rows", "width") for n, s in sets.items()]
    return reduce(DataFrame.unionByName, rows)


@query("merged_chunks", "J15", "SELECT doc_id AS id, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def _(spark, d):
    from ..session import scratch_path

    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    path = scratch_path(spark, "chunks")
    docs.write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).select("id", "lang", "n_chars")


@query("multi_task_rows", "P6", "SELECT doc_id AS id, 'quality' AS task, CAST(quality AS BIGINT) AS label FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS BIGINT) FROM labels")
def _(spark, d):
    wide = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "id")
    return joins.task_rows(wide, ["id"], ["quality", "toxic"])


# -- profiling ---------------------------------------------------------------------------------------------
def _missing(m):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FEATS[m])


@query("missing_totals", "Q1", with_(fx.MODALITIES) + " UNION ALL ".join(f"SELECT '{m}' AS modality, {_missing(m)} AS missing FROM {m}" for m in FEATS))
def _(spark, d):
    return fx.modalities(spark, d).missing_totals()


@query("modality_info", "Q2", with_(fx.COMMON) + " UNION ALL ".join(f"SELECT '{m}' AS modality, count(*) AS samples, CAST({len(f)} AS BIGINT) AS features, {_missing(m)} AS missing, (SELECT count(*) FROM common) AS common_samples FROM {m}" for m, f in FEATS.items()))
def _(spark, d):
    return fx.modalities(spark, d).info()


@query(
    "missing_by_column",
    "Q3 Q4",
    with_(fx.MODALITIES)
    + " UNION ALL ".join(
        f"SELECT '{m}' AS modality, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count({c}) AS present, {r(f'100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS percent_missing FROM {m}"
        for m, f in FEATS.items()
        for c in f
    ),
)
def _(spark, d):
    return fx.modalities(spark, d).missing_by_column()


_K2 = """m AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mu FROM long GROUP BY feature),
c AS (SELECT l.feature, m.n, avg((v - mu) * (v - mu)) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM long l JOIN m ON l.feature = m.feature GROUP BY 1, 2),
g AS (SELECT feature, n, m3 / (m2 ** 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM g),
w AS (SELECT *, -1.0 + sqrt(2.0 * (beta - 1.0)) AS w2 FROM s),
z AS (SELECT *, (1.0 / sqrt(0.5 * ln(w2))) * asinh(y / sqrt(2.0 / (w2 - 1.0))) AS zs,
  3.0 * (n - 1) / (n + 1) AS e, 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS vb,
  6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM w),
k AS (SELECT *, (b2 - e) / sqrt(vb) AS x, 6.0 + 8.0 / sb * (2.0 / sb + sqrt(1.0 + 4.0 / (sb * sb))) AS a FROM z),
t AS (SELECT *, 1.0 + x * sqrt(2.0 / (a - 4.0)) AS den FROM k),
q AS (SELECT feature, n, zs, (1.0 - 2.0 / (9.0 * a) - sign(den) * cbrt((1.0 - 2.0 / a) / abs(den))) / sqrt(2.0 / (9.0 * a)) AS zk FROM t)
SELECT feature, n, """ + r("zs * zs + zk * zk", 4) + " AS k2, " + r("exp(-(zs * zs + zk * zk) / 2.0)", 4) + " AS p_value, exp(-(zs * zs + zk * zk) / 2.0) > 0.05 AS is_normal FROM q"


@query("normality_test", "Q5", with_(fx.PARTS, "long AS (SELECT 'size' AS feature, size AS v FROM parts UNION ALL SELECT 'quantity', quantity FROM parts WHERE quantity IS NOT NULL UNION ALL SELECT 'deep_discount', deep_discount FROM parts WHERE deep_discount IS NOT NULL)", _K2), digits=4)
def _(spark, d):
    return profile.normality(fx.parts(spark, d), ["size", "quantity", "deep_discount"])


@query("task_type", "Q6", "SELECT 'toxic' AS label, 'binary' AS task UNION ALL SELECT 'n_chars', 'multiclass' UNION ALL SELECT 'price', CASE WHEN (SELECT bool_and(p_retailprice = floor(p_retailprice)) FROM part) THEN 'multiclass' ELSE 'regression' END")
def _(spark, d):
    lab = fx.labelled(spark, d)
    parts = fx.table(spark, d, "part")
    rows = [("toxic", profile.infer_task(lab, "toxic")), ("n_chars", profile.infer_task(lab, "n_chars")), ("price", profile.infer_task(parts, "p_retailprice"))]
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("label"), "task") for n, t in rows])


_BAL = "counts AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), bal AS (SELECT min(n) AS minority, max(n) AS majority, CAST(sum(n) AS BIGINT) AS total, count(*) AS classes, CAST(max(n) AS DOUBLE) / min(n) AS ir, 100.0 * min(n) / sum(n) AS share FROM counts)"


@query("class_balance", "Q7", with_(_BAL) + f"SELECT minority, majority, total, classes, {r('ir')} AS imbalance_ratio, {r('share')} AS minority_percent FROM bal")
def _(spark, d):
    return profile.class_balance(fx.table(spark, d, "labels"), "toxic")


@query("class_sizes", "Q8", "SELECT 'quality' AS task, CAST(quality AS BIGINT) AS label, count(*) AS n, " + r("CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels)") + " AS share FROM labels GROUP BY quality UNION ALL SELECT 'toxic', CAST(toxic AS BIGINT), count(*), " + r("CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels)") + " FROM labels GROUP BY toxic")
def _(spark, d):
    wide = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left")
    return profile.class_sizes(wide, ["quality", "toxic"])


@query("group_statistics", "Q9", with_(fx.LABELLED) + f"SELECT source, count(*) AS size, {r('avg(quality)')} AS mean_quality, {r('avg(toxic)')} AS mean_toxic, count(quality) AS known_quality, count(toxic) AS known_toxic FROM labelled GROUP BY source ORDER BY size DESC, source LIMIT 10")
def _(spark, d):
    return profile.group_statistics(fx.labelled(spark, d), "source", ["quality", "toxic"])


@query("sparse_features_dropped", "Q10", with_(fx.MODALITIES) + f"SELECT id, {r('n_events')} AS n_events, {r('mean_value')} AS mean_value FROM activity WHERE (SELECT count(CASE WHEN big_purchase > 1e9 THEN 1 END) < floor(0.2 * count(*) + 1) AND count(n_events) >= floor(0.2 * count(*) + 1) AND count(mean_value) >= floor(0.2 * count(*) + 1) FROM activity)")
def _(spark, d):
    # A copy of the sparse column, emptied further, falls below the limit; the others stay.
    t = fx.activity(spark, d).withColumn("big_purchase", F.when(F.col("big_purchase") > 1e9, F.col("big_purchase")))
    return profile.drop_sparse(t, ["n_events", "mean_value", "big_purchase"], 80)


@query("sparse_positions", "Q10", with_(fx.PARTS, "n AS (SELECT count(*) AS n FROM parts)") + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS pos, count({c}) AS present, count({c}) >= floor(0.5 * max(n.n) + 1) AS keep FROM parts CROSS JOIN n" for i, c in enumerate(fx.PART_FEATURES)))
def _(spark, d):
    return profile.present_by_position(fx.parts(spark, d).select(F.array(*fx.PART_FEATURES).alias("v")), "v", 50)


@query("recommended_metrics", "Q11 A12", with_(_BAL) + "SELECT CASE WHEN ir > 10 THEN 'pr_auc,f1,recall' ELSE 'roc_auc,balanced_accuracy,f1' END AS metrics, " + r("ir", 3) + " AS imbalance_ratio FROM bal", digits=3)
def _(spark, d):
    return profile.recommended_metrics(profile.class_balance(fx.table(spark, d, "labels"), "toxic")).select("metrics", "imbalance_ratio")


# -- imputation ------------------------------------------------------------------------------------------------
def _filled(stat):
    cols = ["deep_discount", "quantity"]
    return with_(fx.PARTS, "s AS (SELECT " + ", ".join(stat(c) + f" AS f_{c}" for c in cols) + " FROM parts)") + "SELECT id, " + ", ".join(f"{r(f'coalesce({c}, f_{c})')} AS {c}" for c in cols) + " FROM parts CROSS JOIN s"


def _impute(spark, d, method, **kw):
    return impute.impute(fx.parts(spark, d).select("id", "deep_discount", "quantity"), ["deep_discount", "quantity"], method, **kw)


@query("mean_imputed", "I1", _filled(lambda c: f"avg({c})"))
def _(spark, d):
    return _impute(spark, d, "mean")


@query("median_imputed", "I2", _filled(lambda c: f"median({c})"))
def _(spark, d):
    return _impute(spark, d, "median")


@query("mode_imputed", "I3", _filled(lambda c: f"max((SELECT {c} FROM parts WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))"))
def _(spark, d):
    return _impute(spark, d, "most_frequent")


def _interp_sql():
    parts = []
    for c in ("deep_discount", "quantity"):
        parts.append(f"""last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p_{c},
  first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c},
  last_value({c} IGNORE NULLS) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pv_{c},
  first_value({c} IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv_{c}""")
    outs = [
        f"{r(f'CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN NULL WHEN n_{c} IS NULL THEN pv_{c} ELSE pv_{c} + (nv_{c} - pv_{c}) * (rn - p_{c}) / (n_{c} - p_{c}) END')} AS {c}"
        for c in ("deep_discount", "quantity")
    ]
    return with_(fx.PARTS, "o AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM parts)", "w AS (SELECT *, " + ",\n".join(parts) + " FROM o)") + "SELECT id, " + ", ".join(outs) + " FROM w"


@query("interpolated", "I4", _interp_sql())
def _(spark, d):
    return _impute(spark, d, "interpolate")


def _knn_sql(k, by):
    same = " AND q.brand = t.brand" if by else ""
    mean = "(SELECT avg(deep_discount) FROM parts m WHERE m.brand = p.brand)" if by else "(SELECT avg(deep_discount) FROM parts)"
    return (
        with_(
            fx.PARTS,
            f"""pairs AS (SELECT q.id, t.id AS did, t.deep_discount AS v,
  sqrt(4.0 / (2 + CASE WHEN q.quantity IS NOT NULL AND t.quantity IS NOT NULL THEN 1 ELSE 0 END) *
   ((q.size - t.size) ** 2 + (q.price - t.price) ** 2 + coalesce((q.quantity - t.quantity) ** 2, 0))) AS dist
  FROM parts q JOIN parts t ON q.id <> t.id{same} WHERE q.deep_discount IS NULL AND t.deep_discount IS NOT NULL)""",
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, did) AS rn FROM pairs)",
            f"fills AS (SELECT id, avg(v) AS fill FROM ranked WHERE rn <= {k} GROUP BY id)",
        )
        + f"SELECT p.id, {r(f'coalesce(deep_discount, fill, {mean})')} AS deep_discount FROM parts p LEFT JOIN fills f ON p.id = f.id"
    )


@query("knn_imputed", "I5", _knn_sql(5, False))
def _(spark, d):
    return impute.impute(fx.parts(spark, d), fx.PART_FEATURES, "knn", k=5).select("id", "deep_discount")


@query("class_knn_imputed", "I6", _knn_sql(3, True))
def _(spark, d):
    return impute.impute(fx.parts(spark, d), fx.PART_FEATURES, "knn", k=3, by="brand").select("id", "deep_discount")


@query("scaler_fills_gaps", "I7 N9", with_(fx.PARTS, "s AS (SELECT avg(deep_discount) AS m, stddev_pop(deep_discount) AS sd FROM parts)") + f"SELECT id, {r('coalesce((deep_discount - m) / sd, -9.0)')} AS deep_discount FROM parts CROSS JOIN s")
def _(spark, d):
    p = fx.parts(spark, d).select("id", "deep_discount")
    return scale.fit(p, ["deep_discount"], fill=-9.0).transform(p)


# -- scaling -----------------------------------------------------------------------------------------------------
def _scaled(name, rows, method, center, divisor):
    cols = ["size", "price", "quantity"]
    stats = ", ".join(f"{center.format(c=c)} AS a_{c}, {divisor.format(c=c)} AS b_{c}" for c in cols)
    sql = with_(fx.PARTS, f"s AS (SELECT {stats} FROM parts)") + "SELECT id, " + ", ".join(f"{r(f'({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END')} AS {c}" for c in cols) + " FROM parts CROSS JOIN s"

    @query(name, rows, sql)
    def run(spark, d):
        p = fx.parts(spark, d).select("id", *cols)
        return scale.fit(p, cols, method).transform(p)


_scaled("standardized", "N1", "standardize", "avg({c})", "stddev_pop({c})")
_scaled("minmax_scaled", "N2", "minmax", "min({c})", "max({c}) - min({c})")
_scaled("robust_scaled", "N3", "robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")
_scaled("pareto_scaled", "N4", "pareto", "0.0", "sqrt(stddev_samp({c}))")


def _rows(name, rows, method, den, total=1.0):
    cols = ["balance", "nation"]
    sql = with_(fx.ACCOUNT, f"z AS (SELECT id, coalesce(balance, 0) AS balance, nation FROM account), n AS (SELECT *, {den} AS den FROM z)") + "SELECT id, " + ", ".join(f"{r(f'CASE WHEN den = 0 THEN {c} ELSE {c} / den * {total} END')} AS {c}" for c in cols) + " FROM n"

    @query(name, rows, sql)
    def run(spark, d):
        z = fx.account(spark, d).na.fill(0.0)
        return scale.normalize_rows(z, cols, method, **({"total": total} if method == "constant_sum" else {}))


_rows("constant_sum_rows", "N5", "constant_sum", "balance + nation", 100.0)
_rows("l1_rows", "N6", "L1", "abs(balance) + abs(nation)")
_rows("l2_rows", "N7", "L2", "sqrt(balance * balance + nation * nation)")
_rows("max_rows", "N8", "max", "greatest(abs(balance), abs(nation))")


@query("constant_sum_columns", "N5", with_(fx.ACCOUNT) + f"SELECT id, {r('nation / (SELECT sum(nation) FROM account) * 1000')} AS nation FROM account")
def _(spark, d):
    return scale.normalize_rows(fx.account(spark, d).select("id", "nation"), ["nation"], "constant_sum", total=1000.0, axis=0)


@query(
    "vector_norms",
    "N5 N6 N7 N8",
    with_(fx.VECTORS, "n AS (SELECT id, features, list_sum(list_transform(features, lambda x: abs(x))) AS n1, sqrt(list_dot_product(features, features)) AS n2, list_max(list_transform(features, lambda x: abs(x))) AS nm FROM vectors)")
    + f"SELECT id, {r('features[1] / n1')} AS l1, {r('features[1] / n2')} AS l2, {r('features[1] / nm')} AS mx FROM n",
)
def _(spark, d):
    v = fx.vectors(spark, d)
    first = lambda den: vx.divide_unless_zero("features", den)[0]
    return v.select("id", first(vx.norm1("features")).alias("l1"), first(vx.norm2("features")).alias("l2"), first(vx.norm_max("features")).alias("mx"))


@query("scaler_round_trip", "N9", with_(fx.PARTS) + f"SELECT id, {r('size')} AS size, {r('quantity')} AS quantity FROM parts")
def _(spark, d):
    from ..session import scratch_path

    p = fx.parts(spark, d).select("id", "size", "quantity")
    path = scratch_path(spark, "scaler")
    scale.fit(p, ["size", "quantity"]).save(spark, path)
    held = scale.Scaler.load(spark, path)
    return held.inverse(held.transform(p))


@query(
    "elementwise_transforms",
    "N10",
    "SELECT c_custkey AS id, " + ", ".join(f"{r(e)} AS {n}" for n, e in {
        "cbrt": "cbrt(c_acctbal)", "log10": "CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END", "ln": "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END",
        "log2": "CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END", "sqrt": "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END"}.items()) + " FROM customer",
)
def _(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), *[scale.ELEMENTWISE[m](F.col("c_acctbal")).alias(m) for m in ("cbrt", "log10", "ln", "log2", "sqrt")])


@query("log1p_target_round_trip", "N11", f"SELECT o_orderkey AS id, {r('ln(1 + o_totalprice)')} AS forward, {r('o_totalprice', 4)} AS back FROM orders")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    f = scale.ELEMENTWISE["log1p"](F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("id"), f.alias("forward"), F.round(scale.ELEMENTWISE["expm1"](f), 4).alias("back"))


def _yj(x, lam):
    return f"CASE WHEN {x} >= 0 THEN (({x} + 1) ** {lam} - 1) / {lam} ELSE -((1 - {x}) ** (2 - {lam}) - 1) / (2 - {lam}) END"


@query("yeo_johnson_fixed", "N12", f"SELECT c_custkey AS id, {r(_yj('c_acctbal / 1000', '0.5'))} AS shaped, {r('c_acctbal / 1000')} AS back FROM customer")
def _(spark, d):
    x = F.col("c_acctbal") / 1000
    y = scale.yeo_johnson(x, 0.5)
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), y.alias("shaped"), scale.yeo_johnson_inverse(y, 0.5).alias("back"))


@query("yeo_johnson_fitted", "N12")
def _(spark, d):
    p = fx.parts(spark, d).select("id", "size", "quantity")
    return scale.transform(p, ["size", "quantity"], "powertransformer")


@query("box_cox_fixed", "N13", f"SELECT o_orderkey AS id, {r('((o_totalprice / 1000) ** 0.25 - 1) / 0.25')} AS shaped FROM orders")
def _(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scale.box_cox(F.col("o_totalprice") / 1000, 0.25).alias("shaped"))


@query("box_cox_fitted", "N13")
def _(spark, d):
    return scale.transform(fx.parts(spark, d).select("id", "price"), ["price"], "box-cox")


@query("quantile_uniform", "N14")
def _(spark, d):
    return scale.transform(fx.parts(spark, d).select("id", "price", "size"), ["price", "size"], "quantiletransformer")


@query("quantile_normal", "N14")
def _(spark, d):
    return scale.transform(fx.parts(spark, d).select("id", "price", "size"), ["price", "size"], "quantiletransformer", output="normal")


@query(
    "train_fitted_scaling",
    "N15",
    with_(fx.PARTS, "t AS (SELECT id, size, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) <= floor(round(0.8 * count(*) OVER (), 6)) THEN 'train' ELSE 'test' END AS split FROM parts)", "s AS (SELECT avg(size) AS m, stddev_pop(size) AS sd FROM t WHERE split = 'train')")
    + f"SELECT id, split, {r('(size - m) / sd')} AS size FROM t CROSS JOIN s",
)
def _(spark, d):
    from ..operators.split import holdout

    p = holdout(fx.parts(spark, d).select("id", "size"))
    return scale.fit(p.filter("split = 'train'"), ["size"]).transform(p)


@query("weighted_dimensions", "N16", with_(fx.CELLS) + f"SELECT id, {r('sum(v * (pos + 1) / 64.0)')} AS total FROM cells GROUP BY id")
def _(spark, d):
    w = F.array(*[F.lit((i + 1) / 64.0) for i in range(64)])
    return fx.vectors(spark, d).select("id", vx.vsum(vx.weighted("features", w)).alias("total"))


# -- the whole preparation path ------------------------------------------------------------------------------------
def _prepared_sql():
    fills = ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _ALL)
    outs = ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END', 5)} AS {c}" for c in _ALL)
    return with_(fx.MODALITIES, _WIDE, f"filled AS (SELECT id, {fills} FROM wide)") + f"SELECT id, {outs} FROM filled"


@query("prepared_modalities", "V13", _prepared_sql(), digits=5)
def _(spark, d):
    out, names = wide.WideSet.from_columns(fx.modalities(spark, d).tables).prepare()
    return out.select("id", *[F.col("features")[names.index(c)].alias(c) for c in _ALL])


# -- the same on arrays ------------------------------------------------------------------------------
_HOLES = "CAST(CASE WHEN (vec_id + pos) % 7 = 3 THEN NULL ELSE embedding[pos + 1] END AS DOUBLE)"
_WIDE = f"cells AS (SELECT vec_id AS id, pos, {_HOLES} AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"


def _wide_rows(spark, d):
    """Embeddings with holes."""
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return v.withColumn("features", F.transform("features", lambda x, i: F.when((F.col("id") + i) % 7 != 3, x)))


def _wide_sums(name, rows, sql, run):
    """A row per vector: its number of values, their sum and the sum weighted by position."""
    query(name, rows, with_(_WIDE, "m AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM cells GROUP BY pos)", f"z AS (SELECT id, pos, {sql} AS z FROM cells JOIN m USING (pos))") + f"SELECT id, count(z) AS present, {r('sum(z)', 4)} AS total, {r('sum(z * (pos + 1))', 4)} AS weighted FROM z GROUP BY id", digits=4)(
        lambda spark, d: run(_wide_rows(spark, d)).select(
            "id", F.size(F.filter("features", lambda x: x.isNotNull() & ~F.isnan(x))).alias("present"), vsum(_held()).alias("total"), vsum(F.transform(_held(), lambda x, i: x * (i + 1))).alias("weighted")
        )
    )


def _held():
    return F.transform("features", lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))


@query("wide_missing_totals", "Q1", with_(_WIDE) + "SELECT 'embeddings' AS modality, count(*) FILTER (v IS NULL) AS missing FROM cells")
def _(spark, d):
    return wide.WideSet({"embeddings": _wide_rows(spark, d)}).missing_totals()


_wide_sums("wide_mean_imputed", "I1", "coalesce(v, mean)", lambda v: wide.mean_filler(wide.position_stats(v)).transform(v))
_wide_sums("wide_standardized", "N1", "(v - mean) / sd", lambda v: wide.fit(wide.position_stats(v), "standardize").transform(v))
_wide_sums("wide_minmax_scaled", "N2", "(v - lo) / (hi - lo)", lambda v: wide.fit(wide.position_stats(v), "minmax").transform(v))
_wide_sums("wide_l1_rows", "N6", "coalesce(v, 0) / sum(abs(v)) OVER (PARTITION BY id)", lambda v: wide.normalize_rows(v.withColumn("features", _held()), "L1"))
_wide_sums("wide_l2_rows", "N7", "coalesce(v, 0) / sqrt(sum(v * v) OVER (PARTITION BY id))", lambda v: wide.normalize_rows(v.withColumn("features", _held()), "L2"))
