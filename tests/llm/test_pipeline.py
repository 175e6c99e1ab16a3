"""The pipeline's stages against brute force on a small folder of tables."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_operators import components, removed

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the shared tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier", "simhash near-dedup", "substring dedup", "benchmark decontamination", "packing"
    ]
    for name, stage in stages.items():
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, TABLES).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before}
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r for r in after.collect()}
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
        elif name == "simhash near-dedup":
            assert {str(i) for i in kept} == {str(c) for _, _, c in components(before)}
        elif name == "substring dedup":
            want = {i: (n, gone) for i, n, gone, _ in removed(before)}
            for i, r in kept.items():
                assert len((r["text"] or "").encode().split()) == want[str(i)][0] - want[str(i)][1]
                assert r["n_chars"] == len(r["text"])
        docs = after
