"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are folded first. Each table deals the vectors to buckets by the signs of their
products with some random planes; within a bucket every pair is verified in double precision. A
pair that an earlier table has brought together is not counted again, so counts add up over tables.
Crowded buckets are split into pairs of blocks. Only counts and spanning edges leave a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import batch, forest, stored, whole_runs
from sojourn.operators.graph import connected_components

COSINE = 0.9
#: Chance that a pair right at the threshold meets in some table; closer pairs meet more often.
RECALL = 0.97
PER_BUCKET = 48
BLOCK = 2048
_SEED = 20240229

_OUT = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n", pa.int64())])


def tables_and_bits(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): buckets of about PER_BUCKET of n vectors, and enough tables for the recall."""
    bits = min(40, max(6, math.ceil(math.log2(max(1, n) / PER_BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet)), bits


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim]).standard_normal((dim, tables * bits))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of length one in double precision, scaled first so that no square over- or underflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket of every vector in every table."""
    on = (x @ planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return on @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _buckets(tables: int, bits: int):
    @F.arrow_udf("array<bigint>")
    def run(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), tables), dtype=np.int64)
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            out[at] = _signs(_unit(vectors.take(pa.array(at))), tables, bits)
        # The table is part of the bucket's number.
        out += np.arange(tables, dtype=np.int64) << bits
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return run


def _verify(tables: int, bits: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["dim", "bucket", "slot"]):
            sizes = np.diff(np.append(starts, table.num_rows))
            src, dst, n = [], [], []
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                if size > 1:
                    part = table.slice(at, size)
                    for a, b, c in _run(part, tables, bits, cosine):
                        src.append(a)
                        dst.append(b)
                        n.append(c)
            if src:
                yield batch(_OUT, [np.concatenate(src), pa.concat_arrays(dst), np.concatenate(n)])

    return run


def _run(part: pa.Table, tables: int, bits: int, cosine: float):
    """Of one bucket (or pair of blocks): (node, null, links) and (node, node, 0) of spanning edges."""
    node = part.column("node").to_numpy()
    many = part.column("many").to_numpy()
    block = part.column("block").to_numpy()
    x = _unit(part.column("embedding").combine_chunks())
    own = int(part.column("bucket")[0].as_py()) >> bits
    across = bool((block != block[0]).any())  # two blocks: pairs inside one are met elsewhere
    linked: list[np.ndarray] = []
    for i in range(0, len(x), 512):
        hit = x[i : i + 512] @ x.T >= cosine
        hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
        if across:
            hit &= block[i : i + 512, None] != block[None, :]
        linked.append(hit)
    if not any(h.any() for h in linked):
        return
    hit = np.concatenate(linked)
    some = np.flatnonzero(hit.any(axis=1))
    hit = hit[np.ix_(some, some)]
    if own:
        signs = _signs(x[some], tables, bits)
        for t in range(own):
            hit &= signs[:, None, t] != signs[None, :, t]
    count = hit @ many[some]
    if not count.any():
        return
    got = np.flatnonzero(count)
    yield node[some[got]], pa.nulls(len(got), pa.int64()), count[got]
    for i, found in forest(len(some), lambda i, others: hit[i, others]):
        zero = np.zeros(len(found), np.int64)
        yield np.full(len(found), node[some[i]]), pa.array(node[some[found]]), zero


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite values, link with nothing, and
    neither do vectors of different length. Equal vectors, repeated rows too, link with each other.
    A null vec_id stays null and is a component_id only where the component has no other; kept is
    then true. An empty table gives no rows. Other columns are not looked at.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    folded = stored(
        good.groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding")),
        "vectors",
    )
    tables, bits = tables_and_bits(folded.count(), cosine, recall)
    dealt = folded.withColumn("buckets", _buckets(tables, bits)("embedding")).select(
        "node", "many", "dim", "embedding", F.explode("buckets").alias("bucket")
    )
    crowded = (
        folded.select("dim", F.explode(_buckets(tables, bits)("embedding")).alias("bucket"))
        .groupBy("dim", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > BLOCK)
        .select("dim", "bucket", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    )
    slots = """
        CASE WHEN blocks IS NULL THEN array(0L)
        ELSE transform(sequence(0L, blocks - 1), j -> 1 + least(j, block) * blocks + greatest(j, block)) END
    """
    together = (
        dealt.join(crowded, ["dim", "bucket"], "left")
        .withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0).cast("long")))
        .withColumn("slot", F.explode(F.expr(slots)))
        .select("dim", "bucket", "slot", "block", "node", "many", "embedding")
        .repartition("dim", "bucket", "slot")
        .sortWithinPartitions("dim", "bucket", "slot")
    )
    found = stored(
        together.mapInArrow(_verify(tables, bits, cosine), "src long, dst long, n long"), "vector-links"
    )
    links = found.where("dst IS NULL").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("links"))
    edges = found.where("dst IS NOT NULL").select("src", "dst").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    comps = stored(
        connected_components(ends, edges).join(folded.select("node", "first"), "node"), "vector-components"
    )
    roots = comps.groupBy("component").agg(F.min("first").alias("root"))
    named = comps.join(roots, "component").select("node", "root")
    classes = stored(
        folded.select("node", "embedding", "first", "many")
        .join(links, "node", "left")
        .join(named, "node", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("root", "first").alias("component_id"),
        ),
        "vector-classes",
    )
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        good.join(classes, "embedding")
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
