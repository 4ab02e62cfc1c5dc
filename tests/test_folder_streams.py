"""Tables kept as folders of part files, as Spark writes them, beside tables in one file."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modaweave.operators import infer
from modaweave.session import scratch_path
from modaweave.streaming import ingest


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A folder table of 60 vectors in three files, a one-file table, and a nested file by name."""
    root = tmp_path_factory.mktemp("tables 1")
    x = np.random.default_rng(3).normal(size=(60, 4))
    rows = [(i, r.tolist(), f"text {i}") for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, text string").repartition(3).write.parquet(f"{root}/embeddings.parquet")
    pd.DataFrame({"doc_id": [1, 2]}).to_parquet(f"{root}/documents.parquet")
    (root / "more_embeddings").mkdir()
    pd.DataFrame({"vec_id": [7]}).to_parquet(f"{root}/more_embeddings/other.parquet")
    (root / "sub").mkdir()
    pd.DataFrame({"id": [1, 2, 3]}).to_parquet(f"{root}/sub/bert_x.parquet")
    return str(root), x


def test_stream_moments_of_folder_table(spark, base):
    schema = spark.read.parquet(f"{base[0]}/embeddings.parquet").schema
    m = ingest.accumulate_moments(ingest.file_stream(spark, base[0], schema, "embeddings.parquet"), "embedding", scratch_path(spark, "state"))
    assert m.n == 60 and np.allclose(m.total, base[1].sum(0)) and np.allclose(m.covariance, np.cov(base[1].T))


def test_stream_scoring_of_folder_table(spark, base):
    schema = spark.read.parquet(f"{base[0]}/embeddings.parquet").schema
    out = scratch_path(spark, "scored")
    ingest.score_stream(ingest.file_stream(spark, base[0], schema, "embeddings.parquet"), "text", infer.hash_model(4), "vec_id", out)
    assert spark.read.parquet(out).agg(F.count_distinct("vec_id")).first()[0] == 60


def test_stream_of_one_file(spark, base):
    stream = ingest.file_stream(spark, f"{base[0]}/sub", "id bigint", "bert_x.parquet")
    ingest.running_counts(stream, ["id"], out := scratch_path(spark, "counts"))
    assert spark.read.parquet(out).count() == 3
