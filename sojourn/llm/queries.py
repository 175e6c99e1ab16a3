"""The registered queries of the operators: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import bytepairs, decontaminate, language, negatives, packing, passages, quality, simhash, tokens, tries, urls, vectors, warc
from sojourn.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(quality.crc_remainder("doc_id", 3) == 1, F.lit(False))
    found = language.predicted(docs.select("doc_id", "text"), language.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(load(spark, sf_dir, "embeddings"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.crc_remainder("doc_id", 5) == 0, F.lit(False))
    labels = load(spark, sf_dir, "labels").where(~held_out)
    found = quality.scored(docs, quality.train(labels, docs))
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokens.recounted(tokens.redactions(tokens.counted(docs)))
    return found.select(
        "doc_id",
        F.col("counts.n_before").alias("n_tokens"),
        F.size("edits").cast("long").alias("n_edits"),
        F.col("counts.n_after").alias("n_tokens_edited"),
        "counts.n_leaves",
        "counts.n_reencoded",
    )


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(load(spark, sf_dir, "pages"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.cleaned(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "cleaned.n_words", "cleaned.n_removed", "cleaned.kept_sha256")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.archive(load(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(tries.rebuilt(load(spark, sf_dir, "conversations")))


#: CRC-32 of the decimal digits of c, bit by bit; the polynomial is a fixed value.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(
        list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295)"""

ORACLES["op11_conversation_trie"] = f"""
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(text, ''))) AS t,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
    SELECT heads.c, own.t, own.role, own.text FROM heads JOIN own ON own.c = heads.c - heads.c % 100 AND own.t <= heads.h
    UNION ALL SELECT heads.c, own.t, own.role, own.text FROM heads JOIN own ON own.c = heads.c AND own.t > heads.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY t) AS d, role, text FROM rebuilt),
chained AS (
    SELECT c, d, length(text) AS chars,
        md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS name
    FROM numbered),
paths AS (SELECT c, d, chars, name FROM chained UNION ALL SELECT c, 0, 0, '' FROM heads),
nodes AS (SELECT name, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM paths GROUP BY name, d),
sizes AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (
    SELECT paths.name, string_agg(sizes.c::VARCHAR, ',' ORDER BY sizes.c) AS ids
    FROM sizes JOIN paths ON paths.c = sizes.c AND paths.d = sizes.d GROUP BY paths.name),
parents AS (
    SELECT nodes.name, up.name AS parent FROM nodes JOIN paths up ON up.c = nodes.c AND up.d = nodes.d - 1),
children AS (SELECT parent AS name, count(*) AS n FROM parents GROUP BY parent),
sums AS (
    SELECT up.name, sum((nodes.n - 1) * nodes.chars) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
    FROM nodes JOIN paths up ON up.c = nodes.c AND up.d <= nodes.d LEFT JOIN children ON children.name = nodes.name
    GROUP BY up.name)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, p.c AS parent_conv_id, nodes.n AS n_convs,
    coalesce(children.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens,
    sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.name = nodes.name LEFT JOIN parents ON parents.name = nodes.name
    LEFT JOIN nodes p ON p.name = parents.parent LEFT JOIN children ON children.name = nodes.name
    LEFT JOIN ends ON ends.name = nodes.name
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings"))


ORACLES["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, vec_id AS negative_id, p.positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
    AND 50 * p.positive_score <= 100 * score AND 100 * score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    short, long = (bytepairs.decoded(x(docs)) for x in (bytepairs.encoded_short, bytepairs.encoded_long))
    return bytepairs.digests(short, short=True).unionByName(bytepairs.digests(long))
