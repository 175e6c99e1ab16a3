"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the popcounts of 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. If three bits
differ at most, then the distance is one at most in one half of the segments. So each half is a
grid: a fingerprint stays in its own cell and visits those cells where one segment counts one less.
Two fingerprints that share a cell of either grid are verified exactly.

Equal fingerprints are folded first. A crowded cell is split into pairs of blocks, and gives only
spanning edges, so its output stays linear while every link takes part in the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import BLOCK, batch, forest, forget, in_blocks, stored, tidy, whole_runs, words
from sojourn.operators.graph import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Runs up to this length are compared row by row in numpy; longer ones give spanning edges.
SHORT_RUN = 32

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("row", pa.string())])
_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text: lower-cased A-Z, word shingles with repeats, XXH64.

    Fewer words than a shingle are one shingle; no words (null or blank text) give zero.
    """
    tokens = words(text.encode().lower() if text else None)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: 1 - shingle].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(starts),
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, fp, row) for every row; fp is the fingerprint as a signed long, row passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(
                (fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows
            )
            yield batch(_FP, [b.column("doc_id"), fps.view(np.int64), b.column("row")])

    kept = F.col(row).cast("string") if row else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), kept.alias("row"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long, row string")


def _cells(fps: DataFrame) -> DataFrame:
    """(key, fp, deal, home): own cell of both halves, and the visited ones (home false)."""
    # v - ((v >> 1) & 0101...) leaves the popcount of each pair of bits in the place of the pair.
    return fps.select("fp", F.xxhash64("fp").alias("deal")).selectExpr(
        "fp",
        "deal",
        """inline(flatten(transform(
            transform(
                array(named_struct('h', 0L, 'v', fp & 4294967295L),
                      named_struct('h', 4294967296L, 'v', shiftrightunsigned(fp, 32))),
                x -> named_struct('h', x.h, 'p', x.v - (shiftright(x.v, 1) & 1431655765L))),
            x -> concat(
                array(named_struct('key', x.h + x.p, 'home', true)),
                transform(
                    filter(sequence(0, 15), i -> (shiftright(x.p, 2 * i) & 3L) > 0),
                    i -> named_struct('key', x.h + x.p - shiftleft(1L, 2 * i), 'home', false))))))""",
    )


def _crowded(cells: DataFrame) -> DataFrame:
    """(key, blocks) of the cells with more than a block of residents or visitors."""
    return (
        cells.groupBy("key")
        .agg(F.count_if("home").alias("residents"), F.count_if(~F.col("home")).alias("visitors"))
        .where((F.col("residents") > BLOCK) | (F.col("residents") > 0) & (F.col("visitors") > BLOCK))
        .select("key", F.ceil(F.greatest("residents", "visitors") / BLOCK).alias("blocks"))
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links (a spanning forest of long runs) among the rows that share a cell."""
    for table, starts in whole_runs(batches, ["key", "slot"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        sizes = np.diff(np.append(starts, len(fp)))
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []
        run_of = np.repeat(np.arange(len(starts)), sizes)
        run_of[np.repeat(sizes > SHORT_RUN, sizes)] = -1
        for d in range(1, min(SHORT_RUN, len(fp))):
            near = (run_of[d:] == run_of[:-d]) & (run_of[d:] >= 0) & (home[d:] | home[:-d])
            at = np.flatnonzero(near)
            if not at.size:
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= MAX_BITS]
            src.append(fp[at])
            dst.append(fp[at + d])
        for r in np.flatnonzero(sizes > SHORT_RUN):
            f = fp[starts[r] : starts[r] + sizes[r]]
            h = home[starts[r] : starts[r] + sizes[r]]
            if not h.any():
                continue

            def linked(i: int, others: np.ndarray, f=f, h=h) -> np.ndarray:
                hit = np.bitwise_count(f[others] ^ f[i]) <= MAX_BITS
                return hit if h[i] else hit & h[others]

            for i, found in forest(len(f), linked):
                src.append(np.full(len(found), f[i]))
                dst.append(f[found])
        if src:
            a, b = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
            keep = a != b
            if keep.any():
                yield batch(_EDGE, [a[keep], b[keep]])


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): links between the distinct values of ``fp``, enough to span every component."""
    cells = _cells(fps.select("fp").distinct())
    rows = in_blocks(cells, _crowded(cells), "key").select("key", "slot", "fp", "home")
    together = rows.repartition("key", "slot").sortWithinPartitions("key", "slot")
    return together.mapInArrow(tidy(_verify), "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, fp, row, root, component_id), one row per row of ``docs``.

    ``root`` is a fingerprint that stands for the component, ``row`` a column to pass through as a string.

    Fingerprints that differ in three bits at most are linked; component_id is the smallest doc_id
    that links reach. Null and blank texts have fingerprint zero and link like any other. Repeated
    rows stay repeated; a null doc_id is never a component_id unless its whole component has none.
    An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    base = stored(fingerprints(docs, doc_id, text, row), "simhash")
    firsts = stored(base.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    edges = stored(links(firsts), "simhash-links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    comps = connected_components(ends, edges).select(F.col("node").alias("fp"), "component")
    members = stored(comps.join(firsts, "fp"), "simhash-members")
    roots = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.join(roots, "component").select("fp", "component", "component_id")
    classes = stored(
        firsts.join(linked, "fp", "left").select(
            "fp",
            F.coalesce("component", "fp").alias("root"),
            F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"),
        ),
        "simhash-classes",
    )
    for table in (firsts, edges, members):
        forget(table)
    return base.join(classes, "fp").select("doc_id", "fp", "row", "root", "component_id")


def hexadecimal(fp: str = "fp"):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
