"""Incremental ingest: each run takes only raw files that no earlier run has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sojourn.params import N_GROUPS
from sojourn.sources import raw
from sojourn.sources.grouped import GROUPED_COLUMNS, with_group


#: Compressed bytes of new files in one batch of the stream; what a task holds follows it, not the backlog.
BATCH_BYTES = 256 << 20


def ingest_incremental(
    spark: SparkSession, root: str, out: str, checkpoint: str, n_groups: int = N_GROUPS, batch_bytes: int = BATCH_BYTES
) -> None:
    """Append new ``.csv.gz`` files and zip archives below ``root`` to the grouped layout at ``out``,
    then stop.

    A file stream with ``availableNow``: progress is committed per file, so a crash in the middle
    of a day neither loses nor repeats rows. Rows are shuffled by folder before they are written, so
    a batch leaves one file per folder, not one per task and folder. A run takes as many batches of
    at most ``batch_bytes`` (one file at least) as the new files need.
    """

    def files():
        return spark.readStream.option("maxBytesPerTrigger", batch_bytes)

    texts = raw.typed(raw.parse_rows(raw.raw_lines(files(), root)), "month", "day")
    pings = texts.unionByName(raw.zip_lines(files(), root))
    pings = pings.na.drop(subset=["device_aid", "latitude", "longitude"])
    query = (
        with_group(pings.select(*GROUPED_COLUMNS, "month", "day"), n_groups)
        .repartition("grp", "month", "day")
        .writeStream.format("parquet")
        .partitionBy("grp", "month", "day")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def days_to_do(days: DataFrame, done: DataFrame) -> DataFrame:
    """Batch form of resuming: days (month, day, ...) that the manifest does not hold yet."""
    return days.join(done.select("month", "day").distinct(), ["month", "day"], "left_anti")
