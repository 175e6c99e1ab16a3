"""Hard negatives by segment summaries.

A vector is cut into segments. Of each, the mean and the deviation (the length of what is left when
the mean is taken off) are stored: the inner product of two vectors lies within the products of the
means, plus or minus the products of the deviations. So few wide segments bound a score cheaply;
pairs that the bound leaves in are bounded again with narrower segments, and only what remains is
scored exactly. Scores are whole numbers.

Anchors and rows meet in pairs of blocks. Positives need the blocks of the anchor's own label,
negatives those of all labels; a crowded label has more blocks, no larger ones. Only the best rows of
a pair of blocks leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import batch, stored, whole_runs

POSITIVES = 5
NEGATIVES = 3
#: Rows and anchors of one block.
ROW_BLOCK = 8192
ANCHOR_BLOCK = 2048
#: Rows that are bounded at once, so that the best rows so far can rule out later ones.
TILE = 1024
#: Segments a vector, from coarse to fine.
LEVELS = (4, 16)
#: A negative's score is from half to 95 hundredths of its positive's.
LOW, HIGH = 50, 95
#: Squared length of the longest vectors that take part: no score of two of them can leave a long.
LONGEST = 2.0**62

_BEST = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_BEST_SQL = "anchor long, positive long, row long, score long"


def quantised(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shifted: int = 7
) -> DataFrame:
    """(row, vec_id, label, dim, q) of the vectors that take part, numbered and stored.

    A component x becomes floor(256 * x). A vec_id divisible by ``shifted`` has its label moved to
    (label + 1) % 10.
    """
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * 256))
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    length = F.aggregate(
        embedding, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v.cast("double")) * 256 + 1, F.lit(2.0))
    )
    moved = F.when(F.col(vec_id) % shifted == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    rows = vectors.where(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    ).where(length < LONGEST)
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(vec_id).cast("long").alias("vec_id"),
            moved.cast("long").alias("label"),
            F.size(embedding).alias("dim"),
            x.alias("q"),
        ),
        "quantised",
    )


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the root of the segment's width) and deviations of every segment of every row."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    means, deviations = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = x[:, a:b]
        mean = part.sum(axis=1) / max(1, b - a)
        means.append(mean * np.sqrt(b - a))
        deviations.append(np.sqrt(np.square(part - mean[:, None]).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


class Side:
    """Vectors of one block with their summaries on every level."""

    def __init__(self, q: np.ndarray) -> None:
        self.q = q
        x = q.astype(np.float64)
        self.length = np.sqrt(np.square(x).sum(axis=1))
        # Sums of products stay whole numbers in double precision while they are below 2 ** 53.
        self.x = x
        self.levels = [summaries(x, s) for s in LEVELS if s < q.shape[1]]


def _bounded(a: Side, b: Side, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of pairs (i, j); floats are widened by their own error."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    if len(i) * 4 > len(a.q) * len(b.q):
        mid, off = (ma @ mb.T)[i, j], (da @ db.T)[i, j]
    else:
        mid, off = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", da[i], db[j])
    slack = 1e-9 * a.length[i] * b.length[j] + 1e-6
    return mid - off - slack, mid + off + slack


def _scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    exact = a.length.max(initial=0) * b.length.max(initial=0) < 2.0**52
    x, y = (a.x, b.x) if exact else (a.q, b.q)
    if len(i) * 4 > len(x) * len(y):
        return (x @ y.T)[i, j].astype(np.int64)
    return np.einsum("ij,ij->i", x[i], y[j]).astype(np.int64)


def _kept(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first rows of every group: higher scores first, ties by smaller vec_id."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < most]


def _mine(negatives: bool):
    """Best rows of every anchor (or of every anchor and positive) in one pair of blocks."""
    most = NEGATIVES if negatives else POSITIVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["pair", "dim", "anchors", "rows"]):
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(at, end - at)
                side = part.column("anchor").to_numpy(zero_copy_only=False)
                if side.any() and not side.all():
                    anchors, rows = part.filter(pa.array(side)), part.filter(pa.array(~side))
                    best = _pair(anchors, rows)
                    if len(best[0]):
                        yield batch(_BEST, list(best))

    def _pair(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, ...]:
        a, n = Side(_matrix(anchors.column("q"))), rows.num_rows
        a_row, a_label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        row, vec_id, label = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        q = _matrix(rows.column("q"))
        if negatives:  # every (anchor, positive) is a group, with the band its negatives lie in
            many = np.array([len(s) for s in anchors.column("positives")], np.int64)
            of = np.repeat(np.arange(len(a_row)), many)
            first = np.cumsum(many) - many
            pos = anchors.column("positives").combine_chunks().flatten()
            p_row, p_score = (pos.field(k).to_numpy() for k in ("row", "score"))
            low, high = -(-LOW * p_score.astype(object) // 100), HIGH * p_score.astype(object) // 100
            low, high = low.astype(np.int64), high.astype(np.int64)
            ceiling = np.full(len(a_row), np.iinfo(np.int64).min)
            np.maximum.at(ceiling, of, high)
        else:
            of, many, first = np.arange(len(a_row)), np.ones(len(a_row), np.int64), np.arange(len(a_row))
            p_row = np.full(len(a_row), -1)
            low, high = np.full(len(a_row), np.iinfo(np.int64).min), np.full(len(a_row), np.iinfo(np.int64).max)
            ceiling = high
        held = [np.zeros(0, np.int64)] * 3  # group, row index, score
        need = low.copy()  # what a row must reach to be among the best of a group
        for t in range(0, n, TILE):
            b = Side(q[t : t + TILE])
            wanted = a_label[:, None] != label[None, t : t + TILE] if negatives else a_row[:, None] != row[None, t : t + TILE]
            i, j = np.nonzero(wanted)
            floor = np.full(len(a_row), np.iinfo(np.int64).max)
            np.minimum.at(floor, of, need)
            for level in range(len(b.levels)):
                lower, upper = _bounded(a, b, i, j, level)
                stays = (upper >= floor[i]) & (lower <= ceiling[i])
                i, j = i[stays], j[stays]
            score = _scores(a, b, i, j)
            stays = (score >= floor[i]) & (score <= ceiling[i])
            i, j, score = i[stays], j[stays], score[stays]
            group = np.repeat(first[i], many[i]) + np.arange(many[i].sum()) - np.repeat(np.cumsum(many[i]) - many[i], many[i])
            j, score = np.repeat(j, many[i]) + t, np.repeat(score, many[i])
            fits = (score >= need[group]) & (score <= high[group])
            new = [np.concatenate([h, v[fits]]) for h, v in zip(held, (group, j, score), strict=True)]
            best = _kept(new[0], new[2], vec_id[new[1]], row[new[1]], most)
            held = [v[best] for v in new]
            full = np.bincount(held[0], minlength=len(need)) == most
            worst = np.full(len(need), np.iinfo(np.int64).max)
            np.minimum.at(worst, held[0], held[2])
            need = np.where(full, np.maximum(need, worst), need)
        group, j, score = held
        return a_row[of[group]], p_row[group], row[j], score

    return run


def _met(anchors: DataFrame, rows: DataFrame, negatives: bool) -> DataFrame:
    """Anchors and rows dealt to pairs of blocks; anchors carry ``positives``."""
    pair = F.lit(0).cast("long") if negatives else F.col("label")

    def counted(df: DataFrame, name: str, block: int) -> DataFrame:
        return df.groupBy(pair.alias("pair"), "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))

    blocks = counted(anchors, "n_anchors", ANCHOR_BLOCK).join(counted(rows, "n_rows", ROW_BLOCK), ["pair", "dim"])

    def dealt(df: DataFrame, anchor: bool) -> DataFrame:
        own, other = ("anchors", "rows") if anchor else ("rows", "anchors")
        return (
            df.withColumn("pair", pair)
            .join(blocks, ["pair", "dim"])
            .withColumn(own, F.pmod(F.xxhash64("row"), F.col(f"n_{own}")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
            .withColumn("anchor", F.lit(anchor))
        )

    nothing = F.lit(None).cast("array<struct<row:bigint,score:bigint>>")
    columns = ["pair", "dim", "anchors", "rows", "anchor", "row", "vec_id", "label", "q", "positives"]
    left = dealt(anchors, True)
    left = left if "positives" in left.columns else left.withColumn("positives", nothing)
    both = left.select(columns).unionByName(dealt(rows.withColumn("positives", nothing), False).select(columns))
    together = both.repartition("pair", "dim", "anchors", "rows").sortWithinPartitions("pair", "dim", "anchors", "rows")
    return together.mapInArrow(_mine(negatives), _BEST_SQL)


def _first(best: DataFrame, ids: DataFrame, most: int, *group: str) -> DataFrame:
    """The first rows of every group over all blocks, with their ids and rank."""
    order: list[Column] = [F.col("score").desc(), F.col("vec_id"), F.col("row")]
    ranked = best.join(ids, "row").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 50
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``. Their positives are the first
    POSITIVES other rows of their label, and for each of them the first NEGATIVES rows of another label
    come out whose score is from 50 to 95 hundredths of the positive's. Higher scores come first, ties
    by smaller vec_id.

    Rows with a null label, vector, component or vec_id take no part, nor do those with a component
    that is not finite or whose whole-number length is over 2 ** 31 (scores would leave a long).
    Vectors meet others of their own length only. A repeated vec_id is another row, as anchor too. An
    empty table gives no rows. Other columns are not looked at.
    """
    rows = quantised(vectors, vec_id, embedding, label)
    ids = rows.select("row", "vec_id")
    anchors = rows.where(F.col("vec_id") % every == 0)
    best = _first(_met(anchors, rows, negatives=False).drop("positive"), ids, POSITIVES, "anchor")
    positives = stored(best.select("anchor", "row", "vec_id", "score"), "positives")
    listed = positives.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct("row", "score")).alias("positives")  # POSITIVES at most
    )
    mined = _met(anchors.join(listed, "row"), rows, negatives=True)
    found = _first(mined, ids, NEGATIVES, "anchor", "positive").select(
        "anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = positives.select(
        "anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    anchor_ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        found.join(named, ["anchor", "positive"])
        .join(anchor_ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
