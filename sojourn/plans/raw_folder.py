"""Raw day folders written from the derived pings, in the shared folder, once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.plans import fixtures as fx
from sojourn.session import new_folder, shared_folder
from sojourn.sources import raw

_written: dict[tuple[str, str], str] = {}


def month_day(t: str = "timestamp"):
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(t) / 86400).cast("int"))
    return F.lpad(F.month(date).cast("string"), 2, "0"), F.lpad(F.dayofmonth(date).cast("string"), 2, "0")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty pings in the kept columns of the raw feed, with month and day."""
    month, day = month_day()
    method = F.when(F.col("timestamp") % 2 == 0, "gps").otherwise("wifi")
    return fx.dirty_pings(spark, sf_dir).select(
        "timestamp", "device_aid", "latitude", "longitude", method.alias("location_method"),
        month.alias("month"), day.alias("day"),
    )


def raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """Path of ``{MM}/{DD}/*.csv.gz`` files with all sixteen columns; personal ones hold dummies."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        shared_folder(spark)
        root = new_folder(spark, "raw")
        rows = raw_rows(spark, sf_dir)
        columns = [F.col(c) if c in raw.KEPT_COLUMNS else F.lit("dummy").alias(c) for c in raw.RAW_COLUMNS]
        (
            rows.select(*columns, F.col("month").alias("m"), F.col("day").alias("d"))
            .hint("rebalance", "m", "d")
            .write.partitionBy("m", "d")
            .option("header", True)
            .option("sep", "\t")
            .option("compression", "gzip")
            .csv(root)
        )
        _plain_names(spark, root)
        _written[key] = root
    return _written[key]


def _plain_names(spark: SparkSession, root: str) -> None:
    """Rename ``m=01/d=02`` to ``01/02`` through the Hadoop file system of the folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for month in fs.listStatus(path(root)):
        if not month.isDirectory() or "=" not in month.getPath().getName():
            continue
        target = path(root, month.getPath().getName().split("=")[1])
        fs.rename(month.getPath(), target)
        for day in fs.listStatus(target):
            if "=" in day.getPath().getName():
                fs.rename(day.getPath(), path(target, day.getPath().getName().split("=")[1]))
