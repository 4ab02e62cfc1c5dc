"""Secret scans with a random forest that removes false positives.

Candidates are values assigned to a name with a credential word at its end, and long runs of token
characters: 16 or more with a digit, 20 or more without.  A run ends where such an assignment begins.
Each gets features: length, transitions between character classes, share covered by
the corpus's frequent words, path and neighbouring words.  A forest trained on labelled findings
keeps the likely secrets.  Every step is a DataFrame or SQL function or a Spark ML stage.

Null and empty texts have no candidates; texts are scanned whole, whatever their length.  Repeated
rows are scanned one by one; equal values in a text are found at each place.  Empty tables give
empty results.  Without labelled findings of both kinds every candidate is kept as a secret.
Columns of other names are ignored; ``path_col`` may be missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stored

# Credential words, words that speak against a secret, and published token prefixes.
CREDENTIAL = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "bearer", "private_key")
HARMLESS = ("example", "sample", "dummy", "test", "placeholder", "changeme", "uuid", "sha1", "sha256", "md5", "checksum", "commit", "digest", "http", "https", "www", "iban", "phone", "call")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "SG.", "eyJ")

_KEY = "|".join(CREDENTIAL)
_NAME = "[A-Za-z0-9_\\-]"
_RUN = "[A-Za-z0-9+/_=\\-]"
_ASSIGN = f"{_NAME}*?(?i:{_KEY})[\"']?[ \\t]{{0,3}}[=:][ \\t]{{0,3}}[\"']?"
#: An assignment with its value, or a run of 16 token characters.  A name is read from its first
#: character only and runs are possessive, so the search is linear in the text.
CANDIDATE = (
    f"(?:(?<!{_NAME}){_ASSIGN}[^\\s\"']{{6,}}+)"
    f"|(?:(?={_RUN}{{16}})(?:{_NAME}++|(?<![+/=])[+/=]++(?!{_ASSIGN}[^\\s\"']{{6}}))++)"
)
ASSIGNED = f"^{_ASSIGN}(?=[^\\s\"']{{6}})"
SIDE = 48
MARK = "[SECRET]"

FEATURES = ("length", "runs", "digit_share", "upper_share", "lower_share", "hex_share", "distinct_share", "coverage", "assigned", "prefix", "credential_near", "harmless_near", "path_test", "path_config")


def frequent_words(docs: DataFrame, most: int = 500, least_chars: int = 4) -> list[str]:
    """The ``most`` frequent words over all documents, letters only and lower case."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("w")).filter(F.length("w") >= least_chars)
    counts = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in counts.collect()]


def pieces(docs: DataFrame, *carried: str) -> DataFrame:
    """_r, the columns ``carried``, _k, _piece, _match: what stands before the k-th match in a text, and the match; after the last
    match a piece with a null match.  Texts without a match give no rows."""
    rows = docs.select("_r", *carried, "text").filter(F.col("text").rlike(CANDIDATE))
    parts = F.arrays_zip(F.split("text", CANDIDATE).alias("p"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("m"))
    return rows.select("_r", *carried, F.posexplode(parts).alias("_k", "_z")).select("_r", *carried, "_k", F.col("_z")["p"].alias("_piece"), F.col("_z")["m"].alias("_match"))


def candidates(docs: DataFrame, path_col: str | None = "source") -> DataFrame:
    """doc_id, _r, start (0-based), length, value, before, after, path of every candidate, with ``_k`` (the
    match's number in its text) and ``_head`` (characters of the match before the value).

    A text is cut at its matches once; running lengths give the places and the next few pieces the
    neighbourhood, so the work is linear in the text.  Windows pass over short rows in order.
    """
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    match = F.coalesce("_match", F.lit(""))
    head = F.length(F.regexp_extract(match, ASSIGNED, 0))
    value = F.regexp_replace(F.substring(match, head + 1, F.length(match)), "[.,;:!?)]+$", "")
    short = pieces(docs.select("_r", "doc_id", "text", path.alias("path")), "doc_id", "path").select(
        "_r", "doc_id", "path", "_k", match.alias("_match"), head.alias("_head"), value.alias("value"),
        F.length("_piece").alias("_gap"), (F.length("_piece") + F.length(match)).alias("_step"),
        F.right("_piece", F.lit(SIDE)).alias("_end"), F.right(F.concat(F.right("_piece", F.lit(SIDE)), match), F.lit(SIDE)).alias("_unit_end"),
        F.left(F.concat(F.left("_piece", F.lit(SIDE)), F.when(F.length("_piece") <= SIDE, match).otherwise("")), F.lit(SIDE)).alias("_unit"),
    )
    order = Window.partitionBy("_r", "doc_id").orderBy("_k")
    # A match has six characters or more, so this many neighbours fill a side.
    reach = range(1, SIDE // 6 + 2)
    before = F.right(F.concat(*[F.coalesce(F.lag("_unit_end", j).over(order), F.lit("")) for j in reversed(reach)], "_end"), F.lit(SIDE))
    rest = F.substring("_match", F.col("_head") + F.length("value") + 1, F.lit(SIDE))
    after = F.left(F.concat(rest, *[F.coalesce(F.lead("_unit", j).over(order), F.lit("")) for j in reach]), F.lit(SIDE))
    start = F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_gap") + F.col("_head")
    placed = short.select("_r", "doc_id", "path", "_k", "_head", "value", "_match", start.cast("int").alias("start"), before.alias("_left"), after.alias("after")).filter("_match <> ''")
    out = placed.select(
        "doc_id", "_r", "path", "_k", "_head", "start", "value", (F.col("_head") > 0).alias("assigned"),
        F.right(F.concat("_left", F.left("_match", F.col("_head"))), F.lit(SIDE)).alias("before"), "after",
    ).withColumn("length", F.length("value"))
    return out.filter((F.col("assigned") & (F.col("length") >= 6)) | (F.col("value").rlike("[A-Za-z]") & (F.col("length") >= F.when(F.col("value").rlike("[0-9]"), 16).otherwise(20))))


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with the columns named in FEATURES, as doubles."""
    v = F.col("value")
    share = lambda cls: F.length(F.regexp_replace(v, f"[^{cls}]", "")) / F.col("length")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "."), "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d")
    runs = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1"))
    covered = F.lit(0.0) if not words else 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) / F.col("length")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    has = lambda names: near.rlike("\\b(?:" + "|".join(names) + ")\\b")
    start = reduce(lambda a, b: a | b, [v.startswith(p) for p in PREFIXES])
    path = F.lower(F.coalesce("path", F.lit("")))
    named = {
        "runs": runs,
        "digit_share": share("0-9"),
        "upper_share": share("A-Z"),
        "lower_share": share("a-z"),
        "hex_share": share("0-9a-f"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / F.col("length"),
        "coverage": covered,
        "assigned": F.col("assigned"),
        "prefix": start,
        "credential_near": has(CREDENTIAL),
        "harmless_near": has(HARMLESS),
        "path_test": path.rlike("test|example|fixture|mock|doc"),
        "path_config": path.rlike("env|conf|secret|deploy|settings"),
    }
    return found.select(*[c for c in found.columns if c not in named and c != "length"], F.col("length").cast("double").alias("length"), *[c.cast("double").alias(k) for k, c in named.items()])


def confirmed_findings(found: DataFrame) -> DataFrame:
    """Labelled findings where none are given: what a rule is sure of.

    label 1: a published prefix with a mixed tail, or an assigned value of digits and letters that
    no frequent word covers; label 0: harmless neighbours, and values that are not assigned and have
    no digit or do not mix classes often.  The rest stays unlabelled.
    """
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 0.9)
    sure = ((F.col("prefix") == 1) & (F.col("upper_share") > 0.3) & mixed) | ((F.col("assigned") == 1) & mixed & (F.col("coverage") < 0.3) & (F.col("length") >= 12))
    harmless = (F.col("harmless_near") == 1) | ((F.col("assigned") == 0) & (F.col("digit_share") == 0)) | ((F.col("assigned") == 0) & (F.col("prefix") == 0) & ((F.col("runs") <= 4) | (F.col("coverage") >= 0.3)))
    return found.withColumn("label", F.when(sure & ~(F.col("harmless_near") == 1), 1.0).when(harmless & ~sure, 0.0)).filter("label is not null")


def train(labelled: DataFrame, most: int = 5000, trees: int = 20, depth: int = 6, seed: int = 1) -> PipelineModel | None:
    """A forest over about ``most`` labelled findings of each kind (FEATURES and label 0 or 1)."""
    keys = [c for c in ("doc_id", "start") if c in labelled.columns]
    rows = labelled.withColumn("_k", F.xxhash64(*[F.col(c) for c in keys], *[F.col(c) for c in FEATURES]))
    chosen = bounded_sample(rows, "_k", most, "label", seed).select("_k", "label", *FEATURES)
    # A forest depends on the order of its rows: settle it.
    sample = stored(chosen.repartition(4, "_k").sortWithinPartitions("_k", "label").drop("_k"), "secret-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_x"), forest]).fit(sample)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, path_col: str | None = "source", **settings) -> DataFrame:
    """Findings in stored rows (_r, doc_id, text): candidate columns, score, is_secret."""
    found = stored(with_features(candidates(docs, path_col), frequent_words(docs)), "secret-candidates")
    model = train(labelled if labelled is not None else confirmed_findings(found), **settings)
    if model is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    out = model.transform(found).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_raw", "_p", "_pred")
    return out.withColumn("is_secret", F.col("score") >= threshold)


def op1(docs: DataFrame, **settings) -> DataFrame:
    """One row per finding; the value itself only as a digest."""
    found = scan(docs.withColumn("_r", F.monotonically_increasing_id()), **settings)
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def redacted(docs: DataFrame, mark: str = MARK, **settings) -> DataFrame:
    """All documents with each secret replaced by ``mark``, n_chars kept true; columns as they came."""
    keyed = stored(docs.withColumn("_secret_row", F.monotonically_increasing_id()), "secret-rows")
    path = settings.get("path_col", "source")
    given = [c for c in ("doc_id", path) if c in keyed.columns]
    found = scan(keyed.select(*given, "text", F.col("_secret_row").alias("_r")), **settings).filter("is_secret")
    marked = found.select("_r", "_k", "_head", F.col("length").cast("int").alias("_length"))
    held = keyed.select(F.col("_secret_row").alias("_r"), "text").join(marked.select("_r").distinct(), "_r", "left_semi")
    match = F.coalesce("_match", F.lit(""))
    hidden = F.concat(F.left(match, F.col("_head")), F.lit(mark), F.substring(match, F.col("_head") + F.col("_length") + 1, F.length(match)))
    parts = pieces(held).join(marked, ["_r", "_k"], "left").select("_r", "_k", F.concat("_piece", F.when(F.col("_head").isNull(), match).otherwise(hidden)).alias("_part"))
    # A group is one text cut at its matches.
    whole = parts.groupBy(F.col("_r").alias("_secret_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_part"))), lambda x: x["_part"]), "").alias("_clean"))
    out = keyed.join(whole, F.col("_secret_row") == F.col("_secret_key"), "left")
    cols = {"text": F.coalesce("_clean", keyed["text"]).alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("_clean").isNull(), keyed["n_chars"]).otherwise(F.length("_clean")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[cols.get(c, keyed[c]) for c in docs.columns])
