"""Tables kept as folders of part files, as Spark writes them, beside tables in one file."""

import numpy as np
import pandas as pd
import pytest

from modaweave.sources import readers


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


def test_embeddings_by_folder_name(spark, base):
    got = readers.embeddings(spark, base[0], "embeddings")
    assert got.count() == 60 and "embedding" in got.columns
    assert readers.embeddings(spark, f"file:{base[0]}/", "bert").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.embeddings(spark, base[0], "absent")


def test_descriptor_of_folder_tables(spark, base):
    got = {r["descriptor"]: r["count"] for r in readers.all_embeddings(spark, base[0]).groupBy("descriptor").count().collect()}
    assert got == {"embeddings": 60, "documents": 2, "other": 1, "bert": 3}
