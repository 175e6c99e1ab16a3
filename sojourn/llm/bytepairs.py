"""Byte-level BPE over overlapping chunks.

A long text is cut into chunks that overlap. Every chunk is split into pre-tokens by itself, wherever
it begins. A split depends on nothing before the place it has reached, so from the first place in the
overlap where the earlier chunk ends a pre-token and the later chunk does too, both agree: there they
are stitched. Each chunk then encodes the pre-tokens from its own stitch to the next. Chunks are rows,
so one very long text is spread over many tasks. A text with an overlap in which nothing meets (one
pre-token is longer than it) is split from its start by one task instead, as a short text is.

Ids are kept as bytes, four to an id, lowest first. Decoding joins the bytes of the ids; a character
may be cut between ids, never between the parts of a text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import batch, stored

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK = 65_536
OVERLAP = 1024
#: How far the pattern may look beyond the end of a pre-token.
LOOK = 8
#: Pre-tokens whose ids a task keeps, and the longest that it keeps.
KEPT = 300_000
LONGEST_KEPT = 32

_PART_SQL = "doc_id long, text_row long, part long, parts long, ids binary"
_PART = pa.schema(
    [("doc_id", pa.int64()), ("text_row", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("ids", pa.binary())]
)
_CHUNK_SQL = "doc_id long, text_row long, part long, parts long, chunk string"
_CHUNK = pa.schema([*[_PART.field(i) for i in range(4)], ("chunk", pa.string())])
_DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}


class Encoder(dict):
    """Ids of pre-tokens, four bytes each. Short pre-tokens are kept until KEPT of them are known."""

    def __init__(self, path: str) -> None:
        super().__init__()
        # Every pre-token is one match: the splitting is done outside.
        self.merges = tiktoken.Encoding(
            "pieces", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={}
        )

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merges.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


class Decoder:
    """Bytes of ids, by a table of offsets into the joined tokens."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def chunks(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping chunks of a text; one for an empty text."""
    return [text[a : a + size + overlap] for a in range(0, max(len(text), 1), size)]


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_row", "text")), strict=True):
                every = chunks(text, size, overlap)
                n = len(every)
                yield batch(_CHUNK, [[doc_id] * n, [row] * n, list(range(n)), [n] * n, every])

    return run


#: Kinds of characters that a pattern may name, and one character of each that no pattern spells out.
_KINDS = ((r"\p{L}", "b"), (r"\p{N}", "1"), (r"\s", "\t"))
_OTHER = "!"


@functools.lru_cache(1)
def _odd() -> tuple[re.Pattern | None, dict[int, str]]:
    """Characters that the two libraries take for different kinds, and what stands for them in a split.

    Their tables of Unicode are not of one age; ids must be those of the tokenizer's library.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ours, theirs = np.zeros(0x110000, np.int8), np.zeros(0x110000, np.int8)
    single = {bytes([b]): b for b in range(256)}
    for k, (kind, _) in enumerate(_KINDS, 1):
        other = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        for table, chars in ((ours, "".join(regex.findall(kind, every))), (theirs, bytes(other.encode_ordinary(every)).decode())):
            table[np.frombuffer(chars.encode("utf-32-le"), "<u4")] = k
    codes = np.flatnonzero(ours != theirs)
    if not codes.size:
        return None, {}
    marks = [_OTHER, *(mark for _, mark in _KINDS)]
    first = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
    last = [*(first[1:] - 1).tolist(), len(codes) - 1]
    ranges = "".join(f"\\U{codes[a]:08x}-\\U{codes[z]:08x}" for a, z in zip(first.tolist(), last, strict=True))
    return re.compile(f"[{ranges}]"), {int(c): marks[theirs[c]] for c in codes}


def _plain(text: str) -> str:
    """The text as it is split: of the same length, with characters of one kind in both libraries."""
    odd, marks = (None, {}) if text.isascii() else _odd()
    return text.translate(marks) if odd and odd.search(text) else text


def places(pattern: str, text: str) -> np.ndarray:
    """Where the pre-tokens of a text end, in order."""
    return np.fromiter((m.end() for m in regex.compile(pattern).finditer(_plain(text))), np.int32)


def split(pattern: str, text: str) -> list[str]:
    """The pre-tokens of a text."""
    plain = _plain(text)
    if plain is text:
        return regex.compile(pattern).findall(text)
    return [text[m.start() : m.end()] for m in regex.compile(pattern).finditer(plain)]


def _zone(pattern: str, size: int, overlap: int):
    """(head, tail) of a chunk: ends of pre-tokens within its own overlap with the chunk before, and
    within the next chunk's, both counted from the start of that overlap."""

    @F.arrow_udf("struct<head: array<int>, tail: array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        heads, tails = [], []
        for t in texts:
            text = t.as_py()
            ends = places(pattern, text)
            # What lies within reach of the chunk's end may be cut short.
            ends = ends[ends <= len(text) - LOOK]
            heads.append(ends[ends <= overlap].tolist())
            tails.append((ends[ends >= size] - size).tolist())
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(heads, ints), pa.array(tails, ints)], ["head", "tail"])

    return run


def _encode_parts(path: str, pattern: str, size: int) -> Callable:
    """Ids of the pre-tokens of a chunk from its stitch to the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            ids = []
            for text, start, stop in zip(*(b.column(c).to_pylist() for c in ("chunk", "start", "stop")), strict=True):
                # From a stitch on the split is the same, whatever came before.
                part = text[start or 0 :] if stop is None else text[start or 0 : size + stop + LOOK]
                pieces = split(pattern, part)
                beyond = 0 if stop is None else len(part) - (size + stop - (start or 0))
                while beyond > 0:
                    beyond -= len(pieces.pop())
                ids.append(encoder.encode(pieces))
            yield batch(_PART, [*(b.column(c) for c in ("doc_id", "text_row", "part", "parts")), ids])

    return run


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("text_row", F.monotonically_increasing_id())


def _whole() -> tuple:
    return F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts")


def encoded_short(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN, size: int = CHUNK,
) -> DataFrame:
    """Those rows of ``encoded`` that come from texts of one chunk; each has a single part."""
    none = F.lit(None).cast("int")
    rows = _texts(docs, doc_id, text).where(F.char_length("text") <= size)
    return rows.select(
        "doc_id", "text_row", *_whole(), F.col("text").alias("chunk"), none.alias("start"), none.alias("stop")
    ).mapInArrow(_encode_parts(ranks or default_ranks(), pattern, size), _PART_SQL)


def encoded_long(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN, size: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Those rows of ``encoded`` that come from texts of several chunks."""
    if not 2 * LOOK <= overlap < size:
        raise ValueError("the overlap must be shorter than a chunk and longer than the pattern looks ahead")
    none = F.lit(None).cast("int")
    rows = _texts(docs, doc_id, text).where(F.char_length("text") > size)
    cut = stored(rows.mapInArrow(_cut(size, overlap), _CHUNK_SQL).repartition("text_row", "part"), "chunks")
    zones = stored(
        cut.select("text_row", "part", _zone(pattern, size, overlap)("chunk").alias("zone")).select(
            "text_row", "part", "zone.*"
        ),
        "chunk-ends",
    )
    order = Window.partitionBy("text_row").orderBy("part")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    stitched = zones.select("text_row", "part", met.alias("start")).select(
        "text_row",
        "part",
        "start",
        F.lead("start").over(order).alias("stop"),
        (F.count_if(F.col("start").isNull() & (F.col("part") > 0)).over(Window.partitionBy("text_row")) == 0).alias("meets"),
    )
    joined = cut.join(stitched, ["text_row", "part"])
    long = joined.where("meets").select("doc_id", "text_row", "part", "parts", "chunk", "start", "stop")
    pieces = F.array_sort(F.collect_list(F.struct("part", F.substring("chunk", 1, size).alias("chunk"))))
    apart = (
        joined.where(~F.col("meets"))
        .groupBy("text_row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(pieces, lambda p: p["chunk"]), "").alias("chunk"))
        .select("doc_id", "text_row", *_whole(), "chunk", none.alias("start"), none.alias("stop"))
    )
    return long.unionByName(apart).mapInArrow(_encode_parts(ranks or default_ranks(), pattern, size), _PART_SQL)


def encoded(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    size: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, text_row, part, parts, ids): the ids of every text, in parts of one row each.

    ``ids`` holds four bytes an id, lowest first; the parts of a text (one ``text_row``) in order are
    the ids of the whole text, as the vocabulary gives them for each match of ``pattern``, without
    special tokens. A null text is empty, and an empty text is one part without ids. Repeated rows,
    and rows that share a doc_id or have none, stay apart. An empty table gives no rows. Other
    columns are not looked at. Texts of one chunk stay in the tasks that read them.
    """
    return encoded_short(docs, doc_id, text, ranks, pattern, size).unionByName(
        encoded_long(docs, doc_id, text, ranks, pattern, size, overlap)
    )


def decoded(parts: DataFrame, ranks: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the raw bytes of their ids; a part of a text is whole characters."""
    if into in parts.columns:
        raise ValueError(f"there is a column {into} already")
    path = ranks or default_ranks()

    @F.arrow_udf("binary")
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(path)
        for a in column:
            yield pa.array(
                [decoder.decode(np.frombuffer(v.as_py(), "<u4")) if v.is_valid else None for v in a], pa.binary()
            )

    return parts.withColumn(into, run(ids))


class _Decimal(dict):
    """Decimal digits of ids, as many as a vocabulary has."""

    def __missing__(self, i: int) -> str:
        self[i] = str(i)
        return self[i]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every text from its parts in order; no text is held whole."""
    doc, n, ids_sha, bytes_sha = None, 0, None, None

    def row() -> tuple:
        return doc, n, ids_sha.hexdigest(), bytes_sha.hexdigest()

    decimal = _Decimal()
    for b in batches:
        done = []
        columns = [b.column(c) for c in ("doc_id", "part", "ids", "decoded")]
        for doc_id, part, ids, raw in zip(*(c.to_pylist() for c in columns), strict=True):
            if part == 0:
                if ids_sha:
                    done.append(row())
                doc, n, ids_sha, bytes_sha = doc_id, 0, hashlib.sha256(), hashlib.sha256()
            every = np.frombuffer(ids, "<u4").tolist()
            if every:
                ids_sha.update((" " if n else "").encode() + " ".join(map(decimal.__getitem__, every)).encode())
            n += len(every)
            bytes_sha.update(raw)
        if done:
            yield batch(_DIGEST, list(zip(*done, strict=True)))
    if ids_sha:
        yield batch(_DIGEST, [[v] for v in row()])


def digests(parts: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text of ``decoded`` parts.

    The hash of the ids is that of their decimal numbers, joined by one space. Parts are sorted first;
    rows of ``encoded_short`` (``short``) are hashed where they are.
    """
    rows = parts if short else parts.repartition("text_row", "parts").sortWithinPartitions("parts", "text_row", "part")
    return rows.mapInArrow(_digested, _DIGEST_SQL)
