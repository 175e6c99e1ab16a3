"""Time-ordered logic per key without ever sorting a whole key in one task.

A key (a device) may own a third of all rows. Windows therefore run over (key, time chunk), and
what crosses a chunk edge travels through a summary with one row per (key, chunk): its first and
last row and its last break. The only per-key window is over that summary, whose size is the
number of chunks in the data period, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEEK = 7 * 86400


def with_next(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    ends_run: Callable[[Column, Column], Column] | None = None,
    chunk: int = WEEK,
    unique_time: bool = False,
    number: str | None = None,
) -> DataFrame:
    """Add ``next`` (struct of the ``order`` columns of the following row, null on the last one).

    With ``ends_run(current, following)`` also add ``run_start``: the order columns of the first
    row of the maximal run the row belongs to (only its time where times are unique), where a run
    ends after every row for which the function is true. (key, run_start) names a run. ``number``
    names a column for the number of that run, from 1 per key: the runs begun in the chunk so far are
    counted in the same pass, those of earlier chunks through the summary.
    The first ``order`` column is the time and must be an integer type.

    All frames look backwards from the current row, so each is one pass over its sorted chunk.
    """
    by, order = list(by), list(order)
    t = order[0]
    here = F.struct(*[F.col(c) for c in order])

    def mark(row: Column) -> Column:
        return row[t] if unique_time else row

    chunked = Window.partitionBy(*by, "_chunk").orderBy(*order)
    # Null keys leave first and the chunk is never null, so the join below has no filter to push
    # into only one of its branches: both then share one exchange of the rows.
    x = df
    for c in [*by, t]:
        x = x.where(F.col(c).isNotNull())
    x = x.withColumn("_chunk", _chunk_of(t, chunk))
    x = x.withColumn("_inner", F.lead(here).over(chunked))
    aggs = [F.min(here).alias("_first")]
    if ends_run is not None:
        x = x.withColumn("_lag", F.lag(here).over(chunked))
        begins = F.col("_lag").isNotNull() & ends_run(F.col("_lag"), here)
        x = x.withColumn("_mark", F.when(begins, mark(here))).drop("_lag")
        so_far = chunked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumn("_run", F.last("_mark", ignorenulls=True).over(so_far))
        aggs += [F.max(here).alias("_last"), F.max("_mark").alias("_last_mark")]
        if number:
            x = x.withColumn("_begun", F.count("_mark").over(so_far))
            aggs.append(F.count("_mark").alias("_begins"))

    chunks = Window.partitionBy(*by).orderBy("_chunk")
    s = x.groupBy(*by, "_chunk").agg(*aggs).withColumn("_after", F.lead("_first").over(chunks))
    if ends_run is not None:
        first = F.col("_first")
        s = s.withColumn("_before", F.lag("_last").over(chunks))
        opened = F.col("_before").isNull() | ends_run(F.col("_before"), first)
        s = s.withColumn("_edge_mark", F.when(opened, mark(first)))
        s = s.withColumn("_any_mark", F.coalesce("_last_mark", "_edge_mark"))
        earlier = F.last("_any_mark", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
        s = s.withColumn("_edge_run", F.coalesce(F.col("_edge_mark"), earlier))
        if number:
            edge = F.col("_edge_mark").isNotNull().cast("bigint")
            upto = chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            s = s.withColumn("_base", F.sum(F.col("_begins") + edge).over(upto) - F.col("_begins"))
        s = s.select(*by, "_chunk", "_after", "_edge_run", *(["_base"] if number else []))
    else:
        s = s.select(*by, "_chunk", "_after")
    out = x.join(s, [*by, "_chunk"]).withColumn("next", F.coalesce("_inner", "_after"))
    if ends_run is not None:
        out = out.withColumn("run_start", F.coalesce("_run", "_edge_run"))
        if number:
            out = out.withColumn(number, (F.col("_base") + F.col("_begun")).cast("int"))
    return out.drop("_chunk", "_inner", "_after", "_mark", "_run", "_edge_run", "_begun", "_base")


def _chunk_of(t: str, size: int) -> Column:
    return F.coalesce(F.floor(F.col(t) / size).cast("bigint"), F.lit(0).cast("bigint"))


def number_runs(runs: DataFrame, by: Sequence[str], start: str, name: str) -> DataFrame:
    """Number the runs of each key from 1 in time order.

    Two levels again: ranks inside (key, chunk) plus the number of runs in earlier chunks.
    """
    by = list(by)
    x = runs.withColumn("_chunk", _chunk_of(start, WEEK))
    inner = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(start))
    x = x.withColumn("_inner", inner)
    s = x.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        x.join(s, [*by, "_chunk"])
        .withColumn(name, (F.col("_base") + F.col("_inner")).cast("int"))
        .drop("_chunk", "_inner", "_base")
    )
