"""Stages drop the documents they chose, however a later scan is cut into partitions."""

import random

import corpus_pipeline
from tests.llm.test_operators import letters, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PACKED = "spark.sql.files.maxPartitionBytes"


def scanned_anew(spark, stage, docs, folder):
    """Ids left when the files are one partition at first and one each in the final plan."""
    rows = [(i, t, "en", "x", len(t)) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(12, "doc_id").write.parquet(f"{folder}/documents.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = stage(spark, frame, str(folder))
        spark.conf.set(PACKED, "64")
        return sorted(r["doc_id"] for r in out.select("doc_id").collect())
    finally:
        for key in (PACKED, "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


def test_near_duplicates(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, prose(60, rng)) for i in range(40)]
    docs += [(100 + i, t) for i, t in docs[::4]]
    assert scanned_anew(spark, corpus_pipeline.drop_near_duplicates, docs, tmp_path) == list(range(40))


def test_leaks(spark, tmp_path):
    rng = random.Random(2)
    item = letters(20, rng)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, letters(30, rng) + (" " + item if i % 5 == 3 else "")) for i in range(40)]
    left = scanned_anew(spark, corpus_pipeline.drop_leaks, docs, tmp_path)
    assert left == [i for i in range(40) if i % 5 != 3]
