"""Batch inference with a pluggable model function: good rows, reject rows, resumable outputs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_small

ModelFn = Callable[[list[str]], np.ndarray]


def hash_model(width: int = 8) -> ModelFn:
    """A deterministic stand-in model: digits of a digest, scaled to [0, 1)."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), width))
        for i, t in enumerate(texts):
            if t is None or not t.strip():
                raise ValueError("empty input")
            digest = hashlib.sha256(t.encode()).digest()
            out[i] = np.frombuffer(digest[: 2 * width], dtype="<u2")[:width] / 65536.0
        return out

    return run


def embed(df: DataFrame, text: str, model: ModelFn, id_col: str = "id", batch: int = 256) -> DataFrame:
    """(id, features, error).  A batch that fails is retried row by row; a row that fails or gives
    a non-finite vector keeps a null vector and its reason."""
    kind = dict(df.dtypes)[id_col]

    def one(t: str) -> tuple[list | None, str | None]:
        try:
            v = np.asarray(model([t])[0], dtype=np.float64)
        except Exception as e:  # noqa: BLE001 - the reason is returned with the row
            return None, f"{type(e).__name__}: {e}"
        return (v.tolist(), None) if np.isfinite(v).all() else (None, "non-finite output")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                texts = part[text].tolist()
                try:
                    got = np.asarray(model(texts), dtype=np.float64)
                    ok = np.isfinite(got).all(axis=1)
                    res = [(v.tolist(), None) if o else (None, "non-finite output") for v, o in zip(got, ok, strict=True)]
                except Exception:  # noqa: BLE001
                    res = [one(t) for t in texts]
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "features": [r[0] for r in res], "error": [r[1] for r in res]})

    rows = df.select(id_col, text)
    return (rows if rows.isStreaming else spread_small(rows)).mapInPandas(run, f"{id_col} {kind}, features array<double>, error string")


def good_and_rejects(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = embedded.filter("error is null").drop("error")
    return good, embedded.filter("error is not null").drop("features")


def embed_distinct(df: DataFrame, text: str, model: ModelFn, id_col: str = "id", batch: int = 20_000) -> DataFrame:
    """Run the model once per distinct text and attach the result to every id that has it."""
    unique = df.select(F.col(text)).distinct().withColumn("_tid", F.col(text))
    made = embed(unique.select("_tid", text), text, model, "_tid", batch)
    return df.select(id_col, text).join(made, F.col(text) == F.col("_tid")).select(id_col, "features", "error")


def describe_all(df: DataFrame, text: str, names: Sequence[str], out_dir: str, id_col: str = "id") -> DataFrame:
    """One Parquet table per named generator; a failing one does not stop the others.

    Returns (descriptor, status, rows).
    """
    from .tokens import generator

    spark = df.sparkSession
    status = []
    for name in names:
        try:
            path = f"{out_dir}/{name}"
            df.select(id_col, generator(name)(F.col(text)).alias("features")).write.mode("overwrite").parquet(path)
            status.append((name, "done", spark.read.parquet(path).count()))
        except Exception as e:  # noqa: BLE001 - reported per descriptor
            status.append((name, f"failed: {type(e).__name__}", 0))
    return spark.createDataFrame(status, "descriptor string, status string, rows bigint")
