"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modaweave.plans import CATALOG  # noqa: E402
from modaweave.session import get_session  # noqa: E402

QUERIES = (
    "prepared_modalities",
    "keep_common_samples",
    "median_imputed",
    "knn_imputed",
    "robust_scaled",
    "kfold_stratified_seeds",
    "undersampled",
    "group_split_three_way",
    "threshold_scores",
    "roc_auc",
    "average_precision",
    "regression_scores",
    "nearest_neighbours",
    "weighted_votes",
    "distance_entropy",
    "per_bit_entropy",
    "vocabulary",
    "encoded_sequences",
    "context_tokens",
    "hashed_fingerprints",
    "pca",
    "cross_modal_integration",
    "stream_ingest",
    "diverse_pick",
    "dense_regions",
    "spectral_embedding",
    "group_split_random",
    "group_split_balanced",
    "learner_logistic_regression",
    "study_classification",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's and the Python workers' code paths before the clock runs.
    CATALOG["generated_features"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    CATALOG["pca"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in QUERIES:
        began = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
