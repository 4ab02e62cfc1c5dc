"""Queries for sources, sinks, projection, validation and duplicate handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..sources import readers, writers
from ..session import scratch_path
from . import fixtures as fx
from .registry import query, r, with_


def _csv(df, spark, label, sep=","):
    path = scratch_path(spark, label)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("csv_modality_load", "IO1", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size, " + r("p_retailprice") + " AS price FROM part")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("SMILES"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    path = _csv(p, spark, "imagemol", "\t")
    schema = {"imagemol": "key bigint, SMILES string, size int, price double"}
    return readers.modality_tables(spark, {"imagemol": path}, "key", schemas=schema)["imagemol"]


@query("label_file_load", "IO2", "SELECT l.doc_id AS id, CAST(quality AS BIGINT) AS label, source AS entity FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def _(spark, d):
    rows = fx.labelled(spark, d).select(F.col("id").alias("doc"), F.col("source"), "quality", "toxic")
    return readers.labels(spark, _csv(rows, spark, "labels"), "doc", "quality", "source")


@query("benchmark_tab_load", "IO3 P15", f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS entity, {r('c_acctbal')} AS y, c_mktsegment AS species FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("Drug_ID"), F.col("c_name").alias("Drug"), F.col("c_acctbal").alias("Y"), F.col("c_mktsegment").alias("Species"))
    schema = "Drug_ID string, Drug string, Y double, Species string"
    return readers.benchmark_file(spark, _csv(c, spark, "tab", "\t"), schema).filter("species = 'BUILDING'")


@query("descriptor_discovery", "IO4", f"SELECT vec_id AS id, CAST(label AS BIGINT) AS label, {r('list_sum(CAST(embedding AS DOUBLE[]))', 4)} AS total FROM embeddings", digits=4)
def _(spark, d):
    from ..functions.vectors import vsum

    return readers.embeddings(spark, d, "embeddings").select("id", "label", vsum("embedding").alias("total"))


@query("embedding_file_names", "IO5", " UNION ALL ".join(f"SELECT '{t}' AS descriptor, count(*) AS n FROM {t}" for t in fx.TABLES))
def _(spark, d):
    return readers.all_embeddings(spark, d).groupBy("descriptor").agg(F.count("*").alias("n"))


@query("keyed_rows", "IO6 P5", "SELECT DISTINCT lang, CAST(source AS VARCHAR) AS source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return readers.keyed(fx.table(spark, d, "documents").select("lang", "source"), ["lang", "source"])


@query(
    "task_file_targets",
    "IO7",
    f"SELECT CAST(c_custkey AS VARCHAR) AS entity, {r('CASE WHEN c_acctbal >= 0 THEN c_acctbal END')} AS target_0, {r('c_nationkey')} AS target_1, CAST(2 AS BIGINT) AS n_tasks FROM customer",
)
def _(spark, d):
    path = _csv(fx.account(spark, d), spark, "tasks")
    df, tasks = readers.task_file(spark, path)
    return df.select("entity", F.col("targets")[0].alias("target_0"), F.col("targets")[1].alias("target_1"), F.lit(len(tasks)).alias("n_tasks"))


@query("task_file_row_limit", "IO7", "SELECT CAST(least(count(*), 1000) AS BIGINT) AS n FROM customer")
def _(spark, d):
    return readers.task_file(spark, _csv(fx.account(spark, d), spark, "tasks"), max_rows=1000)[0].agg(F.count("*").alias("n"))


@query("id_set_scan", "IO9 J4", "SELECT DISTINCT o_custkey AS id FROM orders")
def _(spark, d):
    return readers.id_set(fx.table(spark, d, "orders").withColumnRenamed("o_custkey", "id"))


@query("matrix_store", "IO10 J4", with_(fx.COMMON) + f"SELECT o.id, {r('n_orders')} AS f0, {r('mean_price')} AS f1 FROM ordering o JOIN common c ON o.id = c.id")
def _(spark, d):
    ms = fx.modalities(spark, d)
    out = writers.to_matrix_store(ms.tables["ordering"], ["n_orders", "mean_price"], ms.common_ids(), scratch_path(spark, "matrix"))
    return out.select("id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("embedding_sink", "IO11", f"SELECT vec_id AS id, {r('embedding[1]')} AS first, {r('embedding[64]')} AS last, CAST(len(embedding) AS BIGINT) AS width FROM embeddings")
def _(spark, d):
    path = scratch_path(spark, "embeddings")
    writers.save_embeddings(fx.vectors(spark, d), path)
    return spark.read.parquet(path).select("id", F.col("features")[0].alias("first"), F.col("features")[63].alias("last"), F.size("features").alias("width"))


@query("result_append", "IO12", "SELECT lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT source AS lang, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    path, docs = scratch_path(spark, "results"), fx.table(spark, d, "documents")
    for key in ("lang", "source"):
        writers.append_results(docs.groupBy(F.col(key).alias("lang")).agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("lang string, n bigint").csv(path)


@query(
    "resume_pending",
    "IO13",
    "SELECT DISTINCT d.source, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l ON x.doc_id = l.doc_id WHERE l.toxic = 1 AND x.source = d.source AND x.lang = d.lang)",
)
def _(spark, d):
    wanted = fx.table(spark, d, "documents").select("source", "lang").distinct()
    return writers.pending(wanted, fx.labelled(spark, d).filter("toxic = 1"), ["source", "lang"])


_SHARDS = "shards AS (SELECT CAST(floor((row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) / 1000) AS BIGINT) AS shard, o_orderkey FROM orders)"


@query("shard_writer", "IO14", with_(_SHARDS) + "SELECT shard, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM shards GROUP BY shard")
def _(spark, d):
    path = scratch_path(spark, "shards")
    manifest = writers.save_shards(fx.table(spark, d, "orders"), path, 1000, "o_orderkey")
    sums = readers.shards(spark, path).groupBy("shard").agg(F.sum("o_orderkey").alias("key_sum"))
    return manifest.join(sums, "shard")


@query("shard_summary", "IO14", with_(_SHARDS, "m AS (SELECT shard, count(*) AS n FROM shards GROUP BY shard)") + "SELECT count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_samples, max(n) AS sample_per_file FROM m")
def _(spark, d):
    rows = writers.shard_rows(fx.table(spark, d, "orders"), 1000, "o_orderkey")
    return writers.shard_summary(rows.groupBy("shard").agg(F.count("*").alias("n_rows")))


@query(
    "split_sink",
    "IO15",
    with_("t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS rk, count(*) OVER () AS n FROM documents)")
    + "SELECT CASE WHEN rk <= floor(round(0.8 * n, 6)) THEN 'train' WHEN rk <= floor(round(0.9 * n, 6)) THEN 'valid' ELSE 'test' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS key_sum FROM t GROUP BY 1",
)
def _(spark, d):
    from ..operators.split import train_valid_test

    path = scratch_path(spark, "splits")
    writers.save_splits(train_valid_test(fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("key_sum"))


@query("feature_resume", "IO16", "SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    path = scratch_path(spark, "features")
    compute = lambda df: df.select("id", F.length("text").alias("n"))
    writers.resume(docs.filter("lang = 'en'"), path, ["id"], compute)
    return writers.resume(docs, path, ["id"], compute)


@query("blob_decode", "IO17", with_("b AS (SELECT vec_id // 100 AS batch, vec_id, embedding FROM embeddings)") + f"SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY vec_id) - 1 AS BIGINT) AS row, {r('embedding[1]')} AS f0, {r('embedding[64]')} AS f63 FROM b")
def _(spark, d):
    import numpy as np
    import pandas as pd

    e = fx.table(spark, d, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 100).cast("bigint"))

    # Write the byte batches a service would send: 100 rows each plus padding rows.
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        mat = np.stack(pdf.sort_values("vec_id")["embedding"].to_list()).astype("<f4")
        padded = np.vstack([mat, np.zeros((3, mat.shape[1]), dtype="<f4")])
        return pd.DataFrame({"batch": [pdf["batch"].iat[0]], "rows": [len(mat)], "blob": [padded.tobytes()]})

    blobs = e.groupBy("batch").applyInPandas(pack, "batch bigint, rows int, blob binary")
    out = readers.decode_vectors(blobs, "blob", 64, "batch", "rows")
    return out.select("batch", "row", F.col("features")[0].alias("f0"), F.col("features")[63].alias("f63"))


@query(
    "log_extraction",
    "IO18",
    f"SELECT o_orderkey AS id, {r('o_totalprice', 4)} AS heat, {r('o_custkey', 4)} AS homo, {r('-o_custkey - 1', 4)} AS lumo FROM orders",
    digits=4,
)
def _(spark, d):
    o = fx.table(spark, d, "orders")
    text = F.concat(
        F.lit("  RUN OF "), F.col("o_orderkey"), F.lit("\n HEAT OF FORMATION = 1 KCAL = "), F.format_string("%.2f", "o_totalprice"),
        F.lit(" KJ\n HOMO LUMO ENERGIES (EV) = "), F.format_string("%.1f", F.col("o_custkey").cast("double")), F.lit("  "),
        F.format_string("%.1f", (-F.col("o_custkey") - 1).cast("double")), F.lit("\nEND 7"),
    )
    wanted = {"heat": readers.RUN_LOG["Hf"], "homo": readers.RUN_LOG["EHomo"], "lumo": readers.RUN_LOG["ELumo"]}
    return readers.log_values(o.select(F.col("o_orderkey").alias("id"), text.alias("log")), "log", wanted).drop("log")


@query("prefixed_columns", "IO19", "SELECT vec_id AS id, " + ", ".join(f"{r(f'embedding[{i + 1}]')} AS \"Sign_{i}\"" for i in range(64)) + " FROM embeddings")
def _(spark, d):
    return writers.prefixed(fx.vectors(spark, d), "features", "Sign_", 64)


# -- projection and validation -----------------------------------------------------------------------------
_URL_RULE = r"^https?://[^ /?]+/[a-z]+/[0-9]+$"


@query("validated_rows", "P1", f"SELECT CASE WHEN regexp_matches(url, '{_URL_RULE}') THEN 'good' ELSE 'reject' END AS part, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS key_sum FROM pages GROUP BY 1")
def _(spark, d):
    good, bad = clean.validate(fx.table(spark, d, "pages"), F.col("url").rlike(_URL_RULE))
    both = good.select(F.lit("good").alias("part"), "page_id").unionByName(bad.select(F.lit("reject").alias("part"), "page_id"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("page_id").alias("key_sum"))


@query("empty_entities_dropped", "P2", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND len(regexp_extract_all(text, '[a-zA-Z]+')) > 0")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return clean.drop_empty(docs, "text", lambda t: F.regexp_extract_all(t, F.lit("[a-zA-Z]+"), 0)).select("doc_id")


@query("canonical_keys", "P3", with_("k AS (SELECT page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS c FROM pages)") + "SELECT page_id, CASE WHEN c = '' THEN url ELSE c END AS canonical FROM k")
def _(spark, d):
    return clean.canonicalize(fx.table(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "canonical")


@query("generated_ids", "P4", "SELECT 'C' || CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS VARCHAR) AS id, page_id FROM pages")
def _(spark, d):
    from ..operators.ranking import ordered_rank

    ranked = ordered_rank(fx.table(spark, d, "pages").select("url", "page_id"), ["url", "page_id"], name="_r")
    return ranked.select(F.concat(F.lit("C"), (F.col("_r") - 1).cast("string")).alias("id"), "page_id")


@query("key_cleaning", "P5", "SELECT trim(CAST(c_custkey AS VARCHAR) || ' ') AS key, trim(c_name) AS name FROM customer")
def _(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(clean.clean_key(F.concat(F.col("c_custkey"), F.lit(" "))).alias("key"), clean.clean_key("c_name").alias("name"))


@query("labelled_rows", "P6", "SELECT d.doc_id AS id, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def _(spark, d):
    wide = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left")
    return clean.labelled(wide, "quality").select(F.col("doc_id").alias("id"), "quality")


@query("keep_first_duplicate", "P7", with_("k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)") + "SELECT doc_id, lang, source FROM k WHERE rn = 1")
def _(spark, d):
    return clean.keep_first(fx.table(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query("conflicting_keys_dropped", "P8", "SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) = 1)")
def _(spark, d):
    docs = fx.table(spark, d, "documents").withColumn("key", F.sha2("text", 256))
    return clean.drop_conflicts(docs, "key", "source").select("doc_id", "source")


@query("numeric_coercion", "P9", f"SELECT o_orderkey, {r('TRY_CAST(substr(o_orderpriority, 1, 2) AS DOUBLE)')} AS level, {r('TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)')} AS digit FROM orders")
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 2).alias("level"), F.substring("o_orderpriority", 1, 1).alias("digit"))
    return clean.coerce_numeric(o, ["level", "digit"])


@query("whitelisted_columns", "P10", with_(fx.PARTS) + f"SELECT id, {r('size')} AS size, {r('quantity')} AS quantity FROM parts")
def _(spark, d):
    return clean.present_columns(fx.parts(spark, d), ["quantity", "size", "never_there"]).select("id", "size", "quantity")


def _frontier_sql():
    h, l = "c_acctbal", "CAST(c_nationkey AS DOUBLE)"  # noqa: E741
    pot, hard = f"(({l} + {h}) / 2.0)", f"(({l} - {h}) / 2.0)"
    exprs = {
        "chemical_potential": pot, "chemical_hardness": hard, "chemical_softness": f"1.0 - {hard}",
        "electrophilicity": f"({pot} * {pot}) / nullif(2.0 * {hard}, 0)", "f_hl": f"{h} / nullif({l}, 0)", "ea": f"-{l}",
        "xmu": f"(-{l} - {h}) / 2.0", "s": f"2.0 / nullif({l} - {h}, 0)", "gap": f"{l} - {h}",
    }
    return "SELECT c_custkey AS id, " + ", ".join(f"{r(e)} AS {n}" for n, e in exprs.items()) + " FROM customer"


@query("derived_properties", "P11", _frontier_sql())
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("h"), F.col("c_nationkey").cast("double").alias("l"))
    return c.withColumns(clean.frontier_properties("h", "l")).drop("h", "l")


@query("unclean_vectors_dropped", "P12", with_(fx.PARTS) + "SELECT id FROM parts WHERE deep_discount IS NOT NULL AND quantity IS NOT NULL")
def _(spark, d):
    v = fx.parts(spark, d).select("id", F.array(*fx.PART_FEATURES).alias("v"))
    return clean.drop_unclean(v, "v").select("id")


@query(
    "unclean_vectors_filled",
    "P13",
    with_(fx.PARTS, "m AS (SELECT avg(size) AS a, avg(price) AS b, avg(deep_discount) AS c, avg(quantity) AS e FROM parts)")
    + "SELECT id, " + ", ".join(r(f"CASE WHEN deep_discount IS NULL OR quantity IS NULL THEN {m} ELSE {c} END") + f" AS {c}" for c, m in zip(fx.PART_FEATURES, "abce")) + " FROM parts CROSS JOIN m",
)
def _(spark, d):
    v = fx.parts(spark, d).select("id", F.array(*fx.PART_FEATURES).alias("v"))
    out = clean.fill_unclean_with_means(v, "v")
    return out.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(fx.PART_FEATURES)])


@query("unclean_entries_zeroed", "P13", with_(fx.PARTS) + f"SELECT id, {r('coalesce(deep_discount, 0)')} AS one, {r('CASE WHEN deep_discount IS NULL OR quantity IS NULL THEN 0 ELSE price END')} AS whole FROM parts")
def _(spark, d):
    from ..functions.vectors import nan_to, zero_if_unclean

    v = fx.parts(spark, d).select("id", F.array(*fx.PART_FEATURES).alias("v"))
    return v.select("id", nan_to("v")[2].alias("one"), zero_if_unclean("v")[1].alias("whole"))


@query(
    "population_gate",
    "P14",
    with_("c AS (SELECT d.source, l.toxic, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2)")
    + "SELECT source, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS minority FROM c GROUP BY source HAVING sum(n) >= 20 AND count(*) > 1 AND min(n) >= 0.1 * sum(n)",
)
def _(spark, d):
    return clean.population_gate(fx.labelled(spark, d), "source", "toxic", 20, 0.1)


@query("named_files_only", "P16", "SELECT c_custkey, c_name FROM customer WHERE c_name <> '' AND lower(c_name) <> 'nan'")
def _(spark, d):
    return clean.named_files(fx.table(spark, d, "customer"), "c_name").select("c_custkey", "c_name")


@query("label_string_split", "P17", "SELECT doc_id AS id, CAST(quality AS BIGINT) AS first, CAST(toxic AS BIGINT) AS second FROM labels")
def _(spark, d):
    lab = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id"), clean.label_array(F.concat_ws(" ", F.col("quality").cast("string"), F.col("toxic").cast("string"))).alias("t"))
    return lab.select("id", F.col("t")[0].alias("first"), F.col("t")[1].alias("second"))
