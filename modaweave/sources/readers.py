"""Readers for modality tables, labels, task files, embeddings and vector blobs."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names accepted for each role (fixed values).
ID_ALIASES = ("id", "drug_id", "compound_id", "mol_id", "vec_id")
ENTITY_ALIASES = ("smiles", "drug", "x", "entity")
LABEL_ALIASES = ("y", "label", "labels")


def _delimited(spark: SparkSession, path: str, sep: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def modality_tables(spark: SparkSession, files: Mapping[str, str], id_column: str, tab_separated: Sequence[str] = ("imagemol",), schemas: Mapping[str, StructType | str] | None = None) -> dict[str, DataFrame]:
    """One table per modality, id first, the entity string dropped."""
    out = {}
    for name, path in files.items():
        sep = "\t" if name.lower() in tab_separated else ","
        df = _delimited(spark, path, sep, (schemas or {}).get(name))
        if id_column not in df.columns:
            raise ValueError(f"{path}: no column {id_column!r} among {df.columns}")
        drop = [c for c in df.columns if c.lower() == "smiles" and c != id_column]
        rest = [c for c in df.columns if c != id_column and c not in drop]
        out[name] = df.select(F.col(id_column).alias("id"), *rest)
    return out


def labels(spark: SparkSession, path: str, id_column: str, label_column: str, entity_column: str | None = None, sep: str = ",") -> DataFrame:
    df = _delimited(spark, path, sep, None)
    cols = [F.col(id_column).alias("id"), F.col(label_column).alias("label")]
    return df.select(*cols, *([F.col(entity_column).alias("entity")] if entity_column else []))


def _first_match(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[a] for a in aliases if a in lower), None)


def benchmark_file(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated benchmark table in any of the known headers, as (id, entity, y[, species])."""
    df = _delimited(spark, path, "\t", schema)
    found = {role: _first_match(df.columns, al) for role, al in (("id", ID_ALIASES), ("entity", ENTITY_ALIASES), ("y", LABEL_ALIASES))}
    missing = [role for role, c in found.items() if c is None]
    if missing:
        raise ValueError(f"{path}: no column for {missing} among {df.columns}")
    species = _first_match(df.columns, ("species",))
    cols = [F.col(found["id"]).cast("string").alias("id"), F.col(found["entity"]).cast("string").alias("entity"), F.col(found["y"]).cast("double").alias("y")]
    return df.select(*cols, *([F.col(species).alias("species")] if species else []))


def normalise_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rename whichever known id column is present, case-insensitively."""
    found = _first_match(df.columns, (id_col.lower(), *ID_ALIASES))
    if found is None:
        raise ValueError(f"no id column among {df.columns}")
    return df.withColumnRenamed(found, id_col)


def _below(base_dir: str) -> str:
    """The folder as it appears in the full paths of its files: without scheme and host."""
    return "/" + posixpath.normpath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", base_dir)).strip("/") + "/"


def _named(spark: SparkSession, base_dir: str, descriptor: str, fmt: str) -> list[str]:
    """Files below ``base_dir`` whose name contains ``descriptor``, and folders named like such a file, as
    glob-safe paths.  A table written by Spark is a folder of part files; the folder carries the name then."""
    found = set()
    base = _below(base_dir)
    # Only the listing is used; nothing is read.
    for file in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base_dir).inputFiles():
        path = unquote(file)
        at = path.find(base)
        start = at + len(base) if at >= 0 else path.rfind("/") + 1
        parts = path[start:].split("/")
        names = [fnmatchcase(part, f"*{descriptor}*") and (part is parts[-1] or part.endswith(f".{fmt}")) for part in parts]
        hit = next((i for i, named in enumerate(names) if named), None)
        if hit is not None:
            found.add(path[:start] + "/".join(parts[: hit + 1]))
    if not found:
        raise FileNotFoundError(f"no {fmt} files named {descriptor!r} below {base_dir}")
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in sorted(found)]


def embeddings(spark: SparkSession, base_dir: str, descriptor: str, fmt: str = "parquet") -> DataFrame:
    """The files whose name contains ``descriptor``, or folders named like such a file, one row per id."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return normalise_id(reader.load(_named(spark, base_dir, descriptor, fmt))).dropDuplicates(["id"])


def all_embeddings(spark: SparkSession, base_dir: str, fmt: str = "parquet") -> DataFrame:
    """Every embedding file below a folder, tagged with the descriptor its name starts with; files in a
    folder named like a file (``x.parquet``) belong to that name."""
    df = spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").load(base_dir)
    inside = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(quote(_below(base_dir))), "/")
    name = F.regexp_extract(inside, rf"([^/]+\.{fmt})(/[^/]*)*$", 1)
    return df.withColumn("descriptor", descriptor_of(name))


def descriptor_of(file_name):
    """File name up to the first underscore or dot."""
    return F.regexp_extract(file_name, r"^([^_.]*)", 1)


def keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all key columns, as strings, without repeats; names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df.dropna(subset=list(columns)).withColumns({c: F.col(c).cast("string") for c in columns}).dropDuplicates(list(columns))


def task_file(spark: SparkSession, path: str, max_rows: int | None = None, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """First column is the entity, all others are task targets; blanks are null."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    entity, *tasks = df.columns
    targets = F.array(*[F.nullif(F.trim(F.col(f"`{t}`")), F.lit("")).try_cast("double") for t in tasks])
    out = df.select(F.col(f"`{entity}`").alias("entity"), targets.alias("targets"))
    return (out if max_rows is None else out.limit(max_rows)), tasks


def from_list(spark: SparkSession, entities: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, e) for i, e in enumerate(entities)], "id bigint, entity string")


def id_set(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Only the id column is scanned."""
    return df.select(id_col).distinct()


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decode_vectors(df: DataFrame, blob: str, width: int, key: str, rows: str | None = None) -> DataFrame:
    """Little-endian float32 batches to (key, row, features); ``rows`` trims padding at the end."""
    kind = dict(df.dtypes)[key]
    cols = [key, blob] + ([rows] if rows else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                mat = np.frombuffer(rec[blob], dtype="<f4").reshape(-1, width)
                n = len(mat) if rows is None else min(int(rec[rows]), len(mat))
                yield pd.DataFrame({key: [rec[key]] * n, "row": np.arange(n, dtype="int32"), "features": list(mat[:n].astype("float64"))})

    return df.select(*cols).mapInPandas(run, f"{key} {kind}, row int, features array<double>")


def log_values(df: DataFrame, text: str, labels: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Pull numbers out of log text: for each output name the given number of the first line that
    starts with the label."""
    out = {}
    for name, (label, position) in labels.items():
        line = F.regexp_extract(F.col(text), r"(?m)^\s*(" + _quote(label) + r"[^\n]*)", 1)
        numbers = F.regexp_extract_all(line, F.lit(r"([-+]?\d*\.*\d+)"), 1)
        out[name] = F.get(numbers, F.lit(position)).try_cast("double")
    return df.withColumns(out)


def _quote(text: str) -> str:
    return re.escape(text)


# Label and number position of each value in a semi-empirical run log (fixed values).
RUN_LOG = {
    "Hf": ("HEAT OF FORMATION", 1),
    "GN": ("GRADIENT NORM", 0),
    "GNPA": ("GRADIENT NORM", 1),
    "mu": ("DIPOLE", 0),
    "NFL": ("NO. OF FILLED LEVELS", 0),
    "IP": ("IONIZATION POTENTIAL", 0),
    "EHomo": ("HOMO LUMO ENERGIES (EV)", 0),
    "ELumo": ("HOMO LUMO ENERGIES (EV)", 1),
    "Mw": ("MOLECULAR WEIGHT", 0),
    "CoArea": ("COSMO AREA", 0),
    "CoVolume": ("COSMO VOLUME", 0),
}
