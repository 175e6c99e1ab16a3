"""WARC archives whose records are compressed one by one with a dictionary made from such records.

An archive starts with a skippable Zstandard frame that holds the dictionary; every record is a
frame of its own after it. Payloads that were archived before become revisit records without a
payload. Archives are written to the shared folder by the tasks and read back record by record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import batch, stored
from sojourn.session import new_folder

#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
#: The dictionary is made from at most so many records, those of the smallest hashes, and bytes.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
#: Larger payloads join the sample after all others, the smallest first: none ends it early.
SAMPLE_ROW_BYTES = 256 << 10
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: A task starts another archive when one has so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str) -> str:
    """No character of a url may end the header line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is set. The HTTP head tells the payload's length."""
    head = _HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records; empty where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open(path: str, mode: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if mode == "w" else store.open_input_stream(inner, compression=None)


class Writer:
    """Writes one archive."""

    def __init__(self, path: str, content: bytes) -> None:
        self.path, self.records, self.bytes = path, 0, 0
        self.out = _open(path, "w")
        known = zstandard.ZstdCompressionDict(content) if content else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        self._put(struct.pack("<II", _SKIPPABLE, len(content)) + content)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self._put(self.zstd.compress(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, one in memory at a time."""
    with _open(path, "r") as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != _SKIPPABLE:
            raise ValueError(f"{path} does not start with a dictionary")
        content = raw.read(size)
        known = zstandard.ZstdCompressionDict(content) if content else None
        zstd = zstandard.ZstdDecompressor(dict_data=known)
        stream = _Buffered(zstd.stream_reader(raw, read_across_frames=True))
        while line := stream.line():
            if line != b"WARC/1.1":
                raise ValueError(f"no record where one should start in {path}")
            headers = {}
            while line := stream.line():
                key, _, value = line.decode().partition(": ")
                headers[key] = value
            block = stream.exactly(int(headers["Content-Length"]))
            stream.exactly(4)
            yield headers, block


class _Buffered:
    """Lines and exact lengths from a stream."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.held = stream, b""

    def _more(self) -> bool:
        got = self.stream.read(1 << 18)
        self.held += got
        return bool(got)

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            if not self._more():
                if self.held:
                    raise ValueError("a record is cut short")
                return b""
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def exactly(self, n: int) -> bytes:
        parts = [self.held]
        size = len(self.held)
        while size < n:
            got = self.stream.read(max(1 << 18, n - size))
            if not got:
                raise ValueError("a record is cut short")
            parts.append(got)
            size += len(got)
        every = b"".join(parts)
        self.held = every[n:]
        return every[:n]


def archive(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write a record per row to archives in ``folder``; (archive, records, bytes) of each.

    Null html is an empty payload, a null url or id is left out of the record. Of rows with equal
    payloads of REVISIT_BYTES or more the one with the smallest id is a response, and so are rows
    that share this id; the others revisit it (a null id is never smallest, unless there is no
    other: then all are responses). An empty table gives no archives. Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))

    # The sample is chosen by ids alone, so that no task gathers the payloads of all others.
    order = ["hash", "digest", "page_id"]
    keys = rows.select(F.xxhash64("page_id").alias("hash"), "digest", "page_id", F.length("payload").alias("size"))
    sample = keys.where("page_id IS NOT NULL").distinct().orderBy(*order).limit(SAMPLE_ROWS)
    large = F.greatest("size", F.lit(SAMPLE_ROW_BYTES))
    so_far = F.sum("size").over(Window.orderBy(large, *order).rowsBetween(Window.unboundedPreceding, 0))
    picked = sample.withColumn("upto", so_far).where(F.col("upto") <= SAMPLE_BYTES).select("digest", "page_id")
    bounded = (
        rows.join(F.broadcast(picked), ["digest", "page_id"])  # SAMPLE_ROWS rows at most
        .dropDuplicates(["digest", "page_id"])
        .orderBy("page_id", "digest")
    )
    known = dictionary(
        [record(r["page_id"], r["url"], bytes(r["payload"]), r["digest"], None) for r in bounded.collect()]
    )

    firsts = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    decided = rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        done, writer = [], None
        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if writer is None:
                    # The attempt is part of the name: what a lost attempt wrote is never listed.
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.zst"
                    writer = Writer(f"{folder}/{name}", known)
                writer.add(record(*(v.as_py() for v in row)))
                if writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield batch(_MANIFEST, list(zip(*done, strict=True)))

    listed = decided.select("page_id", "url", "payload", "digest", "refers_to")
    return stored(listed.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (column archive): page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and the payload (null for revisits, or unless asked for).

    Length and digest of a response are those of the payload that was read; a digest that differs
    from the record's own is an error. Those of a revisit are of the payload it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for path in b.column("archive").to_pylist():
                for headers, block in read_archive(path):
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = headers["WARC-Type"] == "response"
                    if full:
                        size = len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"a payload in {path} does not have its digest")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                    rows.append(
                        (
                            int(page) if page is not None else None,
                            headers.get("WARC-Target-URI"),
                            headers["WARC-Type"],
                            size,
                            digest,
                            int(refers) if refers is not None else None,
                            body if full and payloads else None,
                        )
                    )
                    held += len(body)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield batch(_READ, list(zip(*rows, strict=True)))
                        rows, held = [], 0
        if rows:
            yield batch(_READ, list(zip(*rows, strict=True)))

    n = max(1, archives.count())  # one archive per task
    return archives.select("archive").repartition(n, "archive").mapInArrow(
        run,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary",
    )
