"""Packing of tokenised documents into fixed sequences: shortest pack first over the length histogram.

Every document is cut into full pieces of the sequence length and a remainder. Lengths are placed
longest first into the shortest open pack that still has room, many packs at once: a pattern is a
list of lengths with the number of packs that have it. Only the histogram (one count per length)
reaches the driver. Patterns are joined back to the pieces by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sojourn.llm.common import batch, stored, tidy

SEQUENCE = 2048
END = 1  # id after each document
#: A slot: the pieces of one length in one pattern. Each length adds three patterns at most, and a
#: pattern of 2048 has 63 different lengths at most, so the table is bounded whatever the input.
_SLOTS = "length int, first_rank long, packs long, first_sequence long, first_offset int, times int"

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("task", pa.int64()),
        ("place", pa.int64()),
    ]
)
_MARK = re.compile(rb"([!-/:-@\[-`{-~](?<=[a-z0-9].)[!-/:-@\[-`{-~]*)(?=[ \n])")


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts for a vocabulary that drops white space between words and upper case.

    No token spans white space, so the ids of a text are those of its words in order. A word is
    encoded once and kept as bytes. Words are kept in two tables: when the newer one is full it
    becomes the older one, so words that still occur stay and memory is bounded. Marks at the end of
    a word are words of their own, as the vocabulary's own split has it.
    """

    def __init__(self, path: str, most: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _each(self, new: list[bytes]) -> list[bytes]:
        out = (self.tokenizer.encode(w.decode(), add_special_tokens=False) for w in new)
        return [np.array(e.ids, dtype=np.uint16).tobytes() for e in out]

    def _letters(self, new: list[bytes]) -> list[bytes]:
        """Words of letters alone, many in one call: each is one piece of the vocabulary's split."""
        e = self.tokenizer.encode(" ".join(w.decode() for w in new), add_special_tokens=False)
        at = np.flatnonzero(np.diff(np.array(e.word_ids, dtype=np.int64), prepend=-1))
        if len(at) != len(new):  # a letter that the vocabulary takes for something else
            return self._each(new)
        ids = np.array(e.ids, dtype=np.uint16).tobytes()
        ends = [*(at[1:] * 2).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip((at * 2).tolist(), ends, strict=True)]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        missing = words.difference(self.known)
        new = missing.difference(self.older)
        self.known.update((w, self.older[w]) for w in missing.difference(new))
        plain, letters, other = [], [], []
        for w in new:
            if w.isalpha() and w.islower():
                plain.append(w)
            else:
                (letters if w.decode().isalpha() else other).append(w)
        # Lower-case ASCII letters are their own byte-level form and one piece of the split.
        tokenize = self.tokenizer.model.tokenize
        for w in plain:
            self.known[w] = array("H", [t.id for t in tokenize(w.decode())]).tobytes()
        for at in range(0, len(letters), 256):
            part = letters[at : at + 256]
            self.known.update(zip(part, self._letters(part), strict=True))
        self.known.update(zip(other, self._each(other), strict=True))

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for at in range(0, len(texts), 64):
            split = [self._split(t) for t in texts[at : at + 64]]
            self._learn(set().union(*split))
            for tokens in split:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), dtype=np.uint16)

    @staticmethod
    def _split(text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode()
        if b"<|" in raw:  # special tokens are told apart by case
            return raw.split()
        return _MARK.sub(rb" \1", raw.lower()).split()


def _cut(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)  # of this task: Spark keeps the worker, and its words would stay in memory
        task = TaskContext.get().partitionId()
        places = np.zeros(sequence + 1, dtype=np.int64)
        for b in batches:
            rows: list[tuple] = []
            texts = coder.encode_all(b.column("text").to_pylist())
            for doc_id, found in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(found, np.uint16(END)).astype("<u4")
                for start in range(0, len(ids), sequence):
                    part = ids[start : start + sequence]
                    n = len(part)
                    rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), task, int(places[n])))
                    places[n] += 1
            yield batch(_PIECES, list(zip(*rows, strict=True)))

    return run


def pack_lengths(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, number of packs) that hold the histogram, shortest pack first."""
    done: list[tuple[dict[int, int], int]] = []
    room: dict[int, list[tuple[dict[int, int], int]]] = {}  # by free space

    def put(pattern: dict[int, int], packs: int, free: int) -> None:
        (room.setdefault(free, []) if free else done).append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # Shortest packs first: those with the most room, each filled with as many as fit in turn.
        while left:
            free = max((f for f in room if f >= length and room[f]), default=0)
            if not free:
                break
            pattern, packs = room[free].pop()
            used = min(packs, left)
            if used < packs:
                room[free].append((pattern, packs - used))
            left -= used
            put({**pattern, length: pattern.get(length, 0) + 1}, used, free - length)
        if left:
            each = sequence // length
            if left >= each:
                put({length: each}, left // each, sequence - each * length)
            if left % each:
                put({length: left % each}, 1, sequence - left % each * length)
    return done + [x for f in sorted(room) for x in room[f]]


def _slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, packs, first sequence, first offset, times) for each length of each pattern."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern.items():
            out.append((length, ranks.get(length, 0), packs, sequence, offset, times))
            ranks[length] = ranks.get(length, 0) + packs * times
            offset += length * times
        sequence += packs
    return out


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    The ids of a text (null: of no words) are followed by the id END, so every document, empty ones
    too, has a piece. Repeated rows are packed again; a null doc_id stays null. An empty table gives
    no rows. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(
        rows.mapInArrow(
            tidy(_cut(vocabulary or default_vocabulary(), sequence)),
            "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task long, place long",
        ),
        "pieces",
    )
    counts = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(pack_lengths(histogram, sequence)),
        _SLOTS,
    )
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ).select("length", "task", "before")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    at = F.col("rank") - F.col("first_rank")
    return (
        # The slot table is bounded by the sequence length, not by the documents.
        ranked.join(F.broadcast(slots), "length")
        .where((at >= 0) & (at < F.col("packs") * F.col("times")))
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("first_sequence") + at % F.col("packs")).alias("sequence_id"),
            (F.col("first_offset") + F.floor(at / F.col("packs")) * F.col("length")).cast("long").alias("offset"),
        )
    )
