"""Clashing column names, odd rows in every stage, few or very long labelled texts, two rounds of edits."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sojourn.llm import decontaminate, language, passages, quality, tokens

TABLES = "/root/testdata/sf0.001"
CLASHES = ["__row", "__ROW_", "__id", "__cuts", "__cleaned", "__score", "row", "root", "key", "id", "doc", "fp", "_metadata"]


def prose(n, rng):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


def test_names_are_never_overwritten(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, Taken string")
    counted = tokens.redactions(tokens.counted(docs))
    for call in (
        lambda: quality.scored(docs, quality.train(docs.selectExpr("doc_id", "1 AS quality"), docs), into="taken"),
        lambda: language.predicted(docs, language.Profiles.of([]), into="taken"),
        lambda: passages.cleaned(docs, into="taken"),
        lambda: tokens.counted(docs, into="taken"),
        lambda: tokens.redactions(docs, into="taken"),
        lambda: tokens.recounted(counted, into="taken"),
    ):
        with pytest.raises(ValueError, match="already"):
            call()


def test_one_long_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 60_000)
    monkeypatch.setattr(quality, "SAMPLE_ROW_BYTES", 3_000)
    rng = random.Random(3)
    # A quarter of both classes is too long for the sample.
    rows = [(i, prose(100 if i % 4 else 20_000, rng)) for i in range(120)]
    rows = [(i, t if i < 60 else t.upper().replace(" ", "!! ")) for i, t in rows]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int")
    model = quality.train(labels, docs)
    assert model.fitted
    scores = quality.score_texts(model, [t for _, t in rows])
    assert [s >= 0.3 for s in scores] == [i < 60 for i in range(120)]


def test_few_labels(spark):
    rng = random.Random(4)
    rows = [(i, prose(80, rng) if i < 3 else prose(80, rng).upper().replace(" ", "## ")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i, _ in rows], "doc_id long, quality int")
    model = quality.train(labels, docs)
    assert model.fitted
    assert [s >= 0.3 for s in quality.score_texts(model, [t for _, t in rows])] == [i < 3 for i in range(30)]
    assert not quality.train(labels.where("doc_id < 1 OR doc_id > 3"), docs).fitted


def test_two_rounds_of_edits(spark):
    rng = random.Random(5)
    texts = [prose(n, rng) for n in (0, 1, 700, 2500)] + [None, "x" * 3000, " " * 40, prose(400, rng)]
    count = tokens._count(tokens.default_vocabulary())
    docs = tokens.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for _ in range(3):
        now = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        edits = []
        for i, t in now.items():
            cuts = sorted(rng.sample(range(len(t) + 1), min(len(t), 8) // 2 * 2))
            pairs = zip(cuts[::2], cuts[1::2], strict=True)
            edits.append((i, [(a, min(b, a + 700), rng.choice(["", " ", "new words ", "y"])) for a, b in pairs]))
        edits[-1] = (edits[-1][0], None)
        changes = spark.createDataFrame(edits, f"doc_id long, edits {tokens.EDITS}")
        out = tokens.recounted(docs.join(changes, "doc_id"), state=True).cache()
        for r in out.collect():
            c = r["counts"]
            todo = [tuple(e) for e in r["edits"] or []]
            assert c["text"] == tokens.edited(now[r["doc_id"]], todo)
            assert c["n_after"] == count(c["text"]) == c["tree"]["sums"][1]
            starts = c["tree"]["starts"]
            assert starts == sorted(set(starts)) and starts[0] == 0
        docs = out.select("doc_id", F.col("counts.text").alias("text"), F.col("counts.tree").alias("tree"))


def test_templates_of_texts_together(spark):
    """Texts are cut to windows alike whether they are alone or between others."""
    rng = random.Random(6)
    words = ["Anna", "Bob", "3", "5", "km", "%", ".", "the", "cat", "ran", "$", "\n", "Mary", "home"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, "", "."]
    canon = decontaminate.Canon()

    def windows(group):
        out = []
        for f in canon.forms(group):
            for length in (1, 4, 8):
                if len(f.codes) < length:
                    continue
                h, some = f.windows(length)
                for i in [i for i, s in enumerate(some) if s]:
                    t = int(f.text[i])
                    place, word = i - int(f.first[t]), int(f.words([i])[0])
                    out.append((t, f.form, length, int(h[i]), place, word, f.plain(i, length), f.values(i, length)))
        return out

    alone = [(i, *w[1:]) for i, t in enumerate(texts) for w in windows([t])]
    assert sorted(map(repr, windows(texts))) == sorted(map(repr, alone))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the shared tables")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("files", [False, True])
def test_stages_keep_odd_rows(spark, tmp_path, name, files):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(60)
    odd = docs.limit(4).withColumn("doc_id", F.expr("IF(doc_id % 2 = 0, NULL, doc_id)"))
    odd = odd.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    odd = odd.unionByName(docs.limit(2).withColumn("text", F.lit("")))
    rows = docs.unionByName(odd)
    names = rows.columns
    for c in CLASHES:
        rows = rows.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    if files:
        rows.write.parquet(f"{tmp_path}/rows")
        rows = spark.read.parquet(f"{tmp_path}/rows")
    out = stage(spark, rows, TABLES)
    if name == "packing":
        assert out.where("offset = 0").count() > 0
        assert stage(spark, rows.limit(0), TABLES).count() == 0
        return
    assert out.columns == rows.columns
    kept = out.collect()
    assert kept and all(r[c] == f"{c}{'' if r['doc_id'] is None else r['doc_id']}" for r in kept for c in CLASHES)
    plain = stage(spark, rows.select(names), TABLES)
    assert sorted(repr(tuple(r[c] for c in names)) for r in kept) == sorted(repr(tuple(r)) for r in plain.collect())
    assert stage(spark, rows.limit(0), TABLES).count() == 0
