"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; ``run`` writes each
result as Parquet to the shared folder and reads it back. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import decontaminate, packing, passages, quality, simhash
from sojourn.llm.common import forget, fresh, load, small_batches, stored
from sojourn.session import ship

def _prepare(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key, and its name: file and row of Parquet files, which no later scan changes.

    Other rows are numbered and stored, so that a second scan has the same numbers.
    """
    row = fresh(docs, "__row")
    try:
        place = docs.metadataColumn("_metadata")
        keyed = docs.withColumn(row, F.concat_ws(":", place.row_index.cast("string"), place.file_path))
        keyed.schema  # raises where the rows do not come straight from Parquet files  # noqa: B018
    except AnalysisException:
        keyed = stored(docs.withColumn(row, F.monotonically_increasing_id().cast("string")), "numbered")
    return keyed, row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the column ``key`` of ``gone``."""
    return rows.join(gone, rows[row] == gone["key"], "left_anti").drop(row)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 5) accepts; learnt from all labels.

    Null and empty texts are scored as empty; repeated rows are kept or go together; an empty table
    stays empty. Where the labels are too few to fit a model nothing is rejected. Columns of any
    other name stay as they are.
    """
    _prepare(spark)
    model = quality.train(load(spark, sf_dir, "labels"), docs)
    if not model.fitted:
        return docs
    score = fresh(docs, "__score")
    return quality.scored(docs, model, into=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links (op 2, three words and three bits).

    The smallest doc_id stays, rows without one last; of rows that share it the first in their file.
    Null and blank texts have fingerprint zero and are one group. An empty table stays empty.
    Columns of any other name stay as they are.
    """
    _prepare(spark)
    rows, row = _placed(docs)
    found = simhash.near_duplicates(rows, row=row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("o")
    linked = stored(found.select("root", order), "near-copies")
    first = linked.groupBy("root").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    extra = linked.join(first, "root").where(F.col("o.row") != F.col("first.row"))
    gone = stored(extra.select(F.col("o.row").alias("key")), "near-copies-gone")
    forget(linked)
    return _without(rows, row, gone)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents (op 8); emptied documents go.

    A text that loses words is its kept words joined by one space, and n_chars follows it. Null, empty
    and short texts stay, also such that were empty before; rows with a null doc_id lose nothing and
    are nobody's source; repeated rows lose the same words; an empty table stays empty. Columns of
    any other name stay as they are.
    """
    _prepare(spark)
    into = fresh(docs, "__cleaned")
    found = passages.cleaned(docs, into=into)
    c = F.col(into)
    kept = found.where((c["n_removed"] == 0) | (c["n_removed"] < c["n_words"]))
    changed = c["kept_text"].isNotNull()
    return (
        kept.withColumn("n_chars", F.when(changed, F.char_length(c["kept_text"])).otherwise(F.col("n_chars")).cast("long"))
        .withColumn("text", F.when(changed, c["kept_text"]).otherwise(F.col("text")))
        .drop(into)
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (op 4), changed parameters included.

    Rows are judged each by itself, so null or repeated ids do not matter. Null and empty texts stay,
    an empty table or benchmark changes nothing. Columns of any other name stay as they are.
    """
    _prepare(spark)
    rows, row = _placed(docs)
    found = decontaminate.leaks(rows, load(spark, sf_dir, "benchmark"), doc_id=row)
    return _without(rows, row, stored(found.select(F.col("doc_id").alias("key")).distinct(), "leaked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left (op 10).

    Null and empty texts have one piece, their end; repeated rows are packed again; a null doc_id stays
    null; an empty table gives no pieces.
    """
    _prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL has neither the compression nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return docs
