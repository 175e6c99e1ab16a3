"""Helpers shared by the operators: tables in the shared folder, Arrow columns, sorted runs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.session import new_folder

#: Rows of one block of a crowded cell or bucket; a task holds two blocks at a time.
BLOCK = 4096
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: After a batch of so many bytes a worker gives its free memory back at once.
LARGE_BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts be small: their rows are long, and several are in memory at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    Ends the lineage at a point that no lost executor can undo, and computes every row once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once all that was computed from it is stored itself."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have: ``name``, longer where it is taken."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unused(docs: DataFrame, into: str) -> str:
    """``into``; an error where ``docs`` has such a column, as nothing is overwritten unasked."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {into!r} already")
    return into


def words(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0D (what bytes.split takes for white space)."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


def release() -> None:
    """Give memory that is free, but kept by the allocators, back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over batches, giving free memory back: Spark keeps a worker for the stages that follow."""

    def watched(batches: Iterator) -> Iterator:
        for b in batches:
            yield b
            if b.nbytes > LARGE_BATCH:
                release()

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(watched(batches))
        release()

    return wrapped


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(flat: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete key runs with the start of each run; the rows come sorted by the keys.

    A run that a batch cuts is held back until it is complete. Runs are bounded by the caller, who
    splits crowded keys into blocks.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        change[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def same_key(a: pa.RecordBatch, b: pa.RecordBatch, at: int) -> bool:
        return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[at].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and same_key(held[-1], b, b.num_rows - 1) and same_key(held[0], b, 0):
            held.append(b)  # all of it belongs to the run that is still open
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        at = starts(table)
        last = int(at[-1])
        if last:
            yield table.slice(0, last), at[:-1]
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Spanning edges of n nodes as (node, its new neighbours).

    ``linked(i, others)`` marks those of the others that node i links to. At most n - 1 edges come
    out, however many links there are.
    """
    edges: list[tuple[int, np.ndarray]] = []
    left = np.arange(n)
    while left.size > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and left.size:
            i = stack.pop()
            hit = linked(i, left)
            if hit.any():
                found = left[hit]
                edges.append((i, found))
                left = left[~hit]
                stack.extend(found.tolist())
    return edges


def in_blocks(rows: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """Spread the rows of crowded keys over pairs of blocks; adds ``slot`` (0 for other keys).

    ``crowded`` has the key and ``blocks``, the number of blocks that its rows are dealt to by
    ``deal`` (a number that stays the same for a row). Rows with ``home`` true meet each other in
    every pair of home blocks and meet all other rows (``home`` false) block by block.
    """
    slot = F.expr(
        """
        CASE WHEN blocks IS NULL THEN array(0L)
        WHEN home THEN concat(
            transform(sequence(0L, blocks - 1), j -> 1 + least(j, b) * blocks + greatest(j, b)),
            transform(sequence(0L, blocks - 1), j -> -1 - (b * blocks + j)))
        ELSE transform(sequence(0L, blocks - 1), j -> -1 - (j * blocks + b)) END
        """
    )
    return (
        rows.join(crowded.select(key, F.col("blocks").cast("long").alias("blocks")), key, "left")
        .withColumn("b", F.pmod("deal", "blocks"))
        .withColumn("slot", F.explode(slot))
        .drop("b", "blocks")
    )
