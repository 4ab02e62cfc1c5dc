"""The pipeline stage by stage against what each stage was given."""

import os

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import WORDS, near_groups, targets

from modaweave.llm import op4_packing
from modaweave.llm.queries import tokenizer


@pytest.fixture(scope="module")
def stages(spark, folder, docs, tmp_path_factory):
    root, out, now = tmp_path_factory.mktemp("stages"), [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{root}/{k}")
        now = spark.read.parquet(f"{root}/{k}")
        out.append(now)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_keeps_good_and_drops_bad(stages, labels):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    truth = [(r.doc_id in kept, r.quality) for r in labels.collect()]
    assert np.mean([k for k, q in truth if q == 1]) > 0.97 and np.mean([k for k, q in truth if q == 0]) < 0.05


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    groups = near_groups(before, 5, 4, 5)
    kept = [r.doc_id for r in stages[2].collect()]
    assert len(kept) == len({groups[i][1] for i in kept}) == len({g for _, g in groups.values()})


def test_secrets_go_documents_stay(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert not any("token = \"" in r.text and "[SECRET]" not in r.text for r in after.values())
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)


def test_mix(stages):
    size, taken = {}, {}
    for part, into in ((stages[3], size), (stages[4], taken)):
        for r in part.collect():
            into[r.source] = into.get(r.source, 0) + len(WORDS(r.text or ""))
    for s, t in targets(size).items():
        assert abs(taken.get(s, 0) - t) <= 0.002 * t + 5


def test_packed(stages):
    pieces = stages[5].collect()
    ids = op4_packing.token_bytes([r.text or "" for r in stages[4].collect()], tokenizer())
    assert sum(p.length for p in pieces) == sum(len(b) // 4 + 1 for b in ids)


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == stages[5].columns and got.count() == stages[5].count()


def test_two_runs_stay_readable(spark, folder):
    small = "/root/testdata/sf0.001"
    first, second = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    assert first.count() == second.count() > 0


def test_a_held_result_stays_readable(spark, docs, folder, tmp_path):
    part = docs.limit(60)
    stage = dict(corpus_pipeline.STAGES)
    held, other = stage["near_duplicates"](spark, part, folder), stage["near_duplicates"](spark, part, folder)
    other.write.parquet(f"{tmp_path}/other")
    stage["secrets"](spark, spark.read.parquet(f"{tmp_path}/other"), folder).count()
    assert held.count() == other.count() > 0
