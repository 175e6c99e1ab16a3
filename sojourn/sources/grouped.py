"""The grouped Parquet layout, its registry and manifest, and stay outputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.hashing import device_group
from sojourn.params import N_GROUPS

GROUPED_COLUMNS = ["timestamp", "device_aid", "latitude", "longitude", "location_method"]


def with_group(pings: DataFrame, n_groups: int = N_GROUPS) -> DataFrame:
    return pings.withColumn("grp", device_group("device_aid", n_groups))


def device_registry(pings: DataFrame, n_groups: int = N_GROUPS, ordered: bool = True) -> DataFrame:
    """Distinct devices per month with their group, in order."""
    seen = pings.where(F.col("device_aid").isNotNull()).select("month", "device_aid").dropDuplicates()
    out = with_group(seen, n_groups)
    return out.orderBy("month", "device_aid") if ordered else out


def write_grouped_pings(pings: DataFrame, path: str, n_groups: int = N_GROUPS) -> None:
    """One folder per (grp, month, day), snappy Parquet; only days present are replaced.

    The rebalance hint gathers a folder's rows in few files and lets a folder far larger than the
    others be split over several tasks.
    """
    rows = with_group(pings.select(*GROUPED_COLUMNS, "month", "day"), n_groups)
    (
        rows.hint("rebalance", "grp", "month", "day")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("grp", "month", "day")
        .parquet(path)
    )


GROUPED_SCHEMA = (
    "timestamp bigint, device_aid string, latitude double, longitude double, "
    "location_method string, grp int, month string, day string"
)


def read_grouped(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """All rows of the layout. A corrupt file fails the job, or is passed over with
    ``skip_corrupt``; ``unreadable_files`` then tells which ones those are."""
    return spark.read.schema(GROUPED_SCHEMA).option("ignoreCorruptFiles", skip_corrupt).parquet(path)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the Parquet files below ``path`` from which ``skip_corrupt`` gets no row."""
    file = F.col("_metadata.file_path").alias("path")
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(file)
    )
    # The hash makes every column be decoded.
    rows = read_grouped(spark, path, skip_corrupt=True).select(file, F.xxhash64(*GROUPED_COLUMNS).alias("h"))
    good = rows.groupBy("path").agg(F.max("h").alias("h")).where("h IS NOT NULL")
    return listed.join(good, "path", "left_anti")


def scan_group_range(
    spark: SparkSession, path: str, start: int, end: int, skip_corrupt: bool = False
) -> DataFrame:
    """Trace columns of groups in [start, end): other folders and columns are never opened."""
    wanted = (F.col("grp") >= start) & (F.col("grp") < end)
    rows = read_grouped(spark, path, skip_corrupt).where(wanted)
    return rows.select("device_aid", "timestamp", "latitude", "longitude")


# ---------------------------------------------------------------- sinks of registry and manifest
def write_registry(pings: DataFrame, path: str, n_groups: int = N_GROUPS) -> None:
    """The registry of whole months, one folder per month; only months present are replaced."""
    rows = device_registry(pings, n_groups, ordered=False).hint("rebalance", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


MANIFEST_SCHEMA = "records bigint, devices bigint, records_per_group map<int,bigint>, month string, day string"


def write_manifest(pings: DataFrame, path: str) -> None:
    """Manifest rows of whole days of grouped pings; only days present are replaced."""
    rows = manifest_days(pings)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "day").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, as ``days_to_do`` of the incremental ingest takes it."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


# ---------------------------------------------------------------- manifest
def day_group_counts(pings: DataFrame) -> DataFrame:
    """Records and distinct devices per (month, day, grp), by way of one row per device."""
    per_device = pings.groupBy("month", "day", "grp", "device_aid").agg(F.count(F.lit(1)).alias("_n"))
    return per_device.groupBy("month", "day", "grp").agg(
        F.sum("_n").alias("records"), F.count("device_aid").alias("devices")
    )


def manifest_days(pings: DataFrame) -> DataFrame:
    """One row per day: records, devices and a map of records per group.

    A device is in exactly one group, so devices add up over groups.
    """
    return (
        day_group_counts(pings)
        .groupBy("month", "day")
        .agg(
            F.sum("records").alias("records"),
            F.sum("devices").alias("devices"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "records")))).alias("records_per_group"),
        )
    )


def manifest_summary(pings: DataFrame) -> DataFrame:
    """One row: days, records, and min, max and mean records over non-empty groups."""
    counts = day_group_counts(pings)
    groups = counts.groupBy("grp").agg(F.sum("records").alias("n"))
    totals = groups.agg(
        F.sum("n").alias("total_records"),
        F.min("n").alias("records_per_group_min"),
        F.max("n").alias("records_per_group_max"),
        F.avg("n").alias("records_per_group_mean"),
    )
    days = counts.select("month", "day").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.withColumn("days_processed", days)


def profile_pings(pings: DataFrame, approximate: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Dry run over raw pings with month and day: totals and expected group sizes.

    The exact form counts devices by one partial aggregate per device; ``approximate`` uses a
    sketch instead. With ``files`` (the rows of ``discover_days``) a column of that name counts them.
    """
    rows = pings.na.drop(subset=["device_aid", "latitude", "longitude"])
    n_days = pings.select("month", "day").distinct().agg(F.count(F.lit(1))).scalar()
    if approximate:
        base = rows.agg(
            F.count(F.lit(1)).alias("records"), F.approx_count_distinct("device_aid").alias("devices")
        )
    else:
        base = rows.groupBy("device_aid").agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.count("device_aid").alias("devices")
        )
    if files is not None:
        base = base.withColumn("files", files.agg(F.count(F.lit(1))).scalar())
    return base.withColumns(
        {
            "days": n_days,
            "mean_records_per_device": F.col("records") / F.greatest("devices", F.lit(1)),
            **{f"devices_per_group_{g}": F.floor(F.col("devices") / g).cast("bigint") for g in (50, 100, 300)},
        }
    )


# ---------------------------------------------------------------- stays
def write_stays(stays: DataFrame, path: str) -> None:
    """Stays with a ``batch`` column, one folder per batch; only batches present are replaced."""
    stays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def merge_stays(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of per-batch stay tables by column name."""
    return reduce(DataFrame.unionByName, parts)
