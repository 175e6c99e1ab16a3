"""Removal of passages that an earlier document holds, by level-wise doubling.

A window is ``window`` consecutive words. Level one looks at half windows: of every run of half
windows as long as a window, the one with the smallest hash is looked at, so equal windows always
show the same halves. Halves that occur in one document alone can't be part of a repeated window.
Level two doubles the halves that survive: only windows whose chosen half is repeated are hashed,
compared with the smallest document that holds them, and lead to removals.

Texts with the same words are folded first; a later copy needs no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import batch, forget, fresh, lists, release, stored, tidy, unused, words

WINDOW = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash

_SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("identity", pa.binary()),
        ("n_words", pa.int64()),
        ("halves", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
    ]
)
_WIDE = pa.schema(
    [("doc_id", pa.int64()), ("turn", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
)
#: What ``cleaned`` adds: counts, the digest of the kept words and the kept text (null: unchanged).
CLEANED = "struct<n_words:bigint,n_removed:bigint,kept_sha256:string,kept_text:string>"
_CLEANED = pa.struct(
    [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)


class Hasher:
    """64-bit hashes of words and of all runs of a given length; words are looked up once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.known) > 150_000:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for w in set(tokens).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    @staticmethod
    def runs(codes: np.ndarray, length: int) -> np.ndarray:
        """The hash of every run of ``length`` codes, put together from runs of doubled lengths."""
        with np.errstate(over="ignore"):
            power, part, done, size, factor = codes, None, 0, 1, _BASE
            rest = length
            while rest:
                if rest & 1:
                    if part is None:
                        part = power
                    else:
                        n = len(codes) - done - size + 1
                        part = part[:n] * factor + power[done : done + n]
                    done += size
                rest >>= 1
                if rest:
                    power = power[:-size] * factor + power[size:]
                    factor = factor * factor
                    size *= 2
            mixed = part ^ (part >> np.uint64(31))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            return mixed ^ (mixed >> np.uint64(29))


def _chosen(halves: np.ndarray, reach: int) -> np.ndarray:
    """For each window the place of the smallest of its ``reach`` half windows (the last of equals)."""
    n = len(halves) - reach + 1
    order = np.lexsort((-np.arange(len(halves)), halves))
    rank = np.empty(len(halves), dtype=np.int64)
    rank[order] = np.arange(len(halves))
    low, size = rank, 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return order[np.minimum(low[:n], low[reach - size : reach - size + n])]


def _halves(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all half windows, and for each window the place of its chosen half."""
    half = window // 2
    hashes = Hasher.runs(codes, half)
    return hashes, _chosen(hashes, window - half + 1)


def _identity(tokens: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(tokens)).digest()[:16]


def _turn(identity: bytes) -> int:
    """Tells apart texts that share a doc_id."""
    return int.from_bytes(identity[:2], "little")


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            identities, counts, flat, places, sizes = [], [], [], [], []
            for t in b.column("text"):
                tokens = words(t.as_py())
                identities.append(_identity(tokens))
                counts.append(len(tokens))
                if len(tokens) < window:
                    sizes.append(0)
                    continue
                hashes, chosen = _halves(hasher.words(tokens), window)
                at = np.unique(chosen)
                flat.append(hashes[at])
                places.append(at)
                sizes.append(len(at))
            h = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            p = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield batch(
                _SCAN,
                [
                    b.column("doc_id"),
                    identities,
                    counts,
                    lists(h.view(np.int64), sizes, pa.int64()),
                    lists(p.astype(np.int32), sizes, pa.int32()),
                ],
            )

    return run


def _widen(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids, turns, flat, places, sizes = [], [], [], [], []
            rows = zip(b.column("doc_id"), b.column("text"), b.column("turn").to_pylist(), b.column("alive"), strict=True)
            for doc_id, text, turn, alive in rows:
                tokens = words(text.as_py())
                # A text is cut to windows only for its own entry: a doc_id may be repeated.
                if len(tokens) < window or _turn(_identity(tokens)) != turn:
                    continue
                codes = hasher.words(tokens)
                _, chosen = _halves(codes, window)
                at = np.flatnonzero(np.isin(chosen, alive.values.to_numpy(zero_copy_only=False)))
                ids.append(doc_id.as_py())
                turns.append(turn)
                flat.append(Hasher.runs(codes, window)[at])
                places.append(at)
                sizes.append(len(at))
            if ids:
                yield batch(
                    _WIDE,
                    [
                        ids,
                        turns,
                        lists(np.concatenate(flat).view(np.int64), sizes, pa.int64()),
                        lists(np.concatenate(places).astype(np.int32), sizes, pa.int32()),
                    ],
                )

    return run


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, cuts) for documents that lose words; cuts: array of (turn, whole, starts).

    ``turn`` tells texts of one doc_id apart, ``whole`` marks later copies of a text, ``starts`` are
    the first words of the windows to remove.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scan = stored(
        rows.where("doc_id IS NOT NULL").mapInArrow(
            tidy(_scan(window)), "doc_id long, identity binary, n_words long, halves array<long>, places array<int>"
        ),
        "passages-scan",
    )
    seen = scan.where(F.col("n_words") >= window)
    firsts = seen.groupBy("identity").agg(F.min("doc_id").alias("first"))
    turn = F.conv(F.hex(F.concat(F.substring("identity", 2, 1), F.substring("identity", 1, 1))), 16, 10).cast("long")
    known = stored(
        seen.join(firsts, "identity").withColumn("copy", F.col("doc_id") > F.col("first")), "passages-known"
    )
    forget(scan)
    copies = known.where("copy").select(
        "doc_id", turn.alias("turn"), F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")
    )
    texts = known.where(~F.col("copy")).select(
        "doc_id", F.shiftleft(turn, 32).alias("base"), F.arrays_zip("halves", "places").alias("z")
    )

    # Level one: half windows in more than one document. Written, like the heads below, so that both
    # sides of the join are shuffled for it and a crowded hash can be split.
    halves = texts.select("doc_id", "base", F.inline("z")).select(
        "doc_id", "halves", (F.col("base") + F.col("places")).alias("spot")
    )
    turn_of = F.shiftright("spot", 32)
    place_of = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    shared = stored(
        halves.groupBy("halves")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("halves"),
        "passages-shared",
    )
    alive = (
        halves.join(shared, "halves", "left_semi")
        .groupBy("doc_id", turn_of.alias("turn"))
        .agg(F.collect_set(place_of).alias("alive"))
    )

    # Level two: the windows that double them.
    wide = stored(
        # Texts are long and shrink well in files: at no size is a table of them broadcast.
        rows.join(alive.hint("merge"), "doc_id").mapInArrow(
            tidy(_widen(window)), "doc_id long, turn long, hashes array<long>, places array<int>"
        ),
        "passages-wide",
    )
    windows = wide.select("doc_id", "turn", F.inline(F.arrays_zip("hashes", "places"))).select(
        "doc_id", "hashes", (F.shiftleft("turn", 32) + F.col("places")).alias("spot")
    )
    heads = stored(
        windows.groupBy("hashes")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("hashes", "low"),
        "passages-heads",
    )
    hits = windows.join(heads, "hashes").where(F.col("doc_id") > F.col("low"))
    cut = (
        hits.groupBy("doc_id", turn_of.alias("turn"))
        .agg(F.collect_set(place_of).alias("starts"))
        .select("doc_id", "turn", F.lit(False).alias("whole"), "starts")
    )
    cuts = stored(
        copies.unionByName(cut)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("turn", "whole", "starts")).alias("cuts")),
        "passages-cuts",
    )
    for table in (known, shared, wide, heads):
        forget(table)
    return cuts


def _clean(window: int) -> Column:
    @F.arrow_udf(CLEANED)
    def run(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts, cuts, strict=True):
            tokens = words(t.as_py())
            n, removed, kept = len(tokens), 0, None
            entries = c.as_py() if n >= window and c.is_valid else None
            if entries:
                turn = _turn(_identity(tokens))
                cover = np.zeros(n + 1, dtype=np.int64)
                for e in entries:
                    if e["turn"] == turn:
                        starts = np.arange(0, n - window + 1) if e["whole"] else np.array(e["starts"], dtype=np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = int(gone.sum())
                if removed:
                    tokens = [tokens[i] for i in np.flatnonzero(~gone).tolist()]
            joined = b" ".join(tokens)
            if removed:
                kept = joined.decode()
            out.append((n, removed, hashlib.sha256(joined).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        release()
        return pa.StructArray.from_arrays(
            [pa.array(v, f.type) for v, f in zip(columns, _CLEANED, strict=True)], fields=list(_CLEANED)
        )

    return run


def cleaned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, into: str = "cleaned"
) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``into`` of type CLEANED.

    A word goes when a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller doc_id; windows are those of the input. Null and blank texts have no
    words. Texts shorter than a window stay. Rows with a null doc_id, and rows that share a doc_id,
    are not earlier than each other; repeated rows keep the same words. An empty table gives no
    rows. ``into`` must not be a column of ``docs``; no other name matters.
    """
    key, found = (fresh(docs, name) for name in ("__id", "__cuts"))
    unused(docs, into)
    cuts = removals(docs, doc_id, text, window).select(F.col("doc_id").alias(key), F.col("cuts").alias(found))
    joined = docs.join(cuts.hint("merge"), F.col(doc_id).cast("long") == F.col(key), "left")
    return joined.withColumn(into, _clean(window)(F.col(text), F.col(found))).drop(key, found)
