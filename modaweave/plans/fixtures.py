"""Feature tables derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import bits_above
from ..operators.modality import ModalitySet
from ..session import spread_small

BITS = 64
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- three modalities keyed by customer ---------------------------------------------------------
ACCOUNT = """account AS (
  SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
         CAST(c_nationkey AS DOUBLE) AS nation FROM customer)"""
ORDERING = """ordering AS (
  SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS mean_price,
         max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice END) AS top_urgent
  FROM orders GROUP BY o_custkey)"""
ACTIVITY = """activity AS (
  SELECT user_id AS id, CAST(count(*) AS DOUBLE) AS n_events, avg(value) AS mean_value,
         avg(CASE WHEN event_type = 'purchase' AND value > 100 THEN value END) AS big_purchase
  FROM events GROUP BY user_id)"""
MODALITIES = f"{ACCOUNT},\n{ORDERING},\n{ACTIVITY}"
COMMON = f"""{MODALITIES},
common AS (SELECT id FROM account INTERSECT SELECT id FROM ordering INTERSECT SELECT id FROM activity)"""


def account(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def ordering(spark, d):
    o = table(spark, d, "orders")
    urgent = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("mean_price"),
        F.max(F.when(urgent, F.col("o_totalprice"))).alias("top_urgent"),
    )


def activity(spark, d):
    e = table(spark, d, "events")
    big = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return e.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").cast("double").alias("n_events"),
        F.avg("value").alias("mean_value"),
        F.avg(F.when(big, F.col("value"))).alias("big_purchase"),
    )


def modalities(spark, d) -> ModalitySet:
    return ModalitySet({"account": account(spark, d), "ordering": ordering(spark, d), "activity": activity(spark, d)})


# -- parts: a modality with many rows and gaps -----------------------------------------------------
PARTS = """parts AS (
  SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price,
         max(CASE WHEN l_discount >= 0.09 AND l_returnflag = 'R' THEN l_quantity END) AS deep_discount,
         avg(l_quantity) AS quantity, max(p_brand) AS brand
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size, p_retailprice)"""
PART_FEATURES = ["size", "price", "deep_discount", "quantity"]


def parts(spark, d) -> DataFrame:
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")  # noqa: E741
    deep = (F.col("l_discount") >= 0.09) & (F.col("l_returnflag") == "R")
    # Aggregate first, then join one row per part.
    per = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max(F.when(deep, F.col("l_quantity"))).alias("deep_discount"), F.avg("l_quantity").alias("quantity")
    )
    return p.join(per, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "deep_discount", "quantity", F.col("p_brand").alias("brand")
    )


# -- labelled documents and predictions ---------------------------------------------------------------
LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SCORED = f"""{LABELLED},
scored AS (SELECT id, lang, source, quality AS y, CAST(n_chars % 100 AS DOUBLE) / 100 AS p FROM labelled)"""
# Five stand-in models, as rules over columns of the document.
MODEL_RULES = {
    "pca_10 Logistic Regression": "n_chars % 100",
    "pca_20 Decision Tree": "(n_chars * 3 + 7) % 100",
    "ica_10 Naive Bayes": "(n_chars * 7 + doc_id) % 100",
    "kpca_10 Random Forest": "(quality * 20 + n_chars % 80) % 100",
    "plsda_5 KNN": "(quality * 35 + doc_id % 65) % 100",
}
_RULE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id AS id, '{m}' AS model, CAST({e} AS DOUBLE) / 100 AS p, l.quality AS y, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id)"
    for m, e in MODEL_RULES.items()
)
FOLDS = """folds AS (SELECT doc_id AS id, ntile(5) OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS fold FROM labels)"""
MODELS = f"""raw AS ({_RULE_ROWS}), {FOLDS},
predictions AS (SELECT raw.*, fold, CASE WHEN fold <= 3 THEN 'train' WHEN fold = 4 THEN 'valid' ELSE 'test' END AS data
  FROM raw JOIN folds ON raw.id = folds.id)"""


def labelled(spark, d) -> DataFrame:
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", "quality", "toxic")


def scored(spark, d) -> DataFrame:
    return labelled(spark, d).select("id", "lang", "source", F.col("quality").alias("y"), ((F.col("n_chars") % 100).cast("double") / 100).alias("p"))


def predictions(spark, d) -> DataFrame:
    from ..operators.split import kfold

    lab = kfold(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "doc_id", "quality", "toxic"), 5)
    base = lab.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = [F.struct(F.lit(m).alias("model"), (F.expr(e).cast("double") / 100).alias("p")) for m, e in MODEL_RULES.items()]
    fold = F.col("fold") + 1
    return base.withColumn("_m", F.explode(F.array(*rows))).select(
        "id", "_m.model", "_m.p", F.col("quality").alias("y"), "toxic", "n_chars", fold.alias("fold"),
        F.when(fold <= 3, "train").when(fold == 4, "valid").otherwise("test").alias("data"),
    )


# -- embeddings ------------------------------------------------------------------------------------------
VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, label AS cls FROM embeddings)"
CELLS = f"{VECTORS}, cells AS (SELECT id, label, cls, unnest(features) AS v, unnest(range(64)) AS pos FROM vectors)"
BITS_SQL = f"{CELLS}, bits AS (SELECT id, pos, CASE WHEN v > 0 THEN 1 ELSE 0 END AS bit FROM cells)"


def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") < 5).cast("int").alias("label"), F.col("label").alias("cls"),
    )


def fingerprints(spark, d) -> DataFrame:
    return vectors(spark, d).withColumn("bits", bits_above("features")).select("id", "bits", "label", "cls")


def grouped_vectors(spark, d) -> DataFrame:
    """Vectors with the source of the document of the same id as their group."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    return vectors(spark, d).join(docs, "id")


# -- texts --------------------------------------------------------------------------------------------------
WORDS = "words AS (SELECT doc_id AS id, list_filter(string_split(lower(text), ' '), lambda t: t <> '') AS tokens FROM documents)"


def texts(spark, d) -> DataFrame:
    from ..operators.tokens import words

    docs = spread_small(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), words("text").alias("tokens"))


def vector_modalities(spark, d) -> DataFrame:
    """Three vector modalities of one entity, cut from the embedding, with its label."""
    v = vectors(spark, d)
    return v.select("id", "label", F.slice("features", 1, 24).alias("a"), F.slice("features", 25, 20).alias("b"), F.slice("features", 45, 20).alias("c"))
