"""Raw ping files: tab-separated .csv.gz and .zip archives of .csv, one folder per day."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column order of the raw feed, and the five columns that may leave a scan.
RAW_COLUMNS = [
    "timestamp", "device_aid", "device_aid_type", "latitude", "longitude", "horizontal_accuracy",
    "altitude", "altitude_accuracy", "location_method", "ip", "user_agent", "OS", "OS_version",
    "manufacturer", "model", "carrier",
]
KEPT_COLUMNS = ["timestamp", "device_aid", "latitude", "longitude", "location_method"]

_SURPLUS = "_surplus"
RAW_SCHEMA = ", ".join(f"`{c}` string" for c in [*RAW_COLUMNS, _SURPLUS])
# Empty fields must stay apart from absent ones, so that only longer rows fill the surplus column.
CSV_OPTIONS = {"sep": "\t", "header": "false", "nullValue": "\u0001", "emptyValue": "", "quote": '"'}


# ---------------------------------------------------------------- paths and days
def path_day(path: Column, root: str) -> tuple[Column, Column]:
    """(month, day) from ``.../MM/DD/file`` or, under the root itself, ``DD/file``; both null when
    the parent folder is not two digits."""
    root = root.rstrip("/")
    name = root.rsplit("/", 1)[-1]
    default_month = name if re.fullmatch(r"\d\d", name) else "00"
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    bare_root = re.sub(r"^[a-z0-9]+:/+", "/", root)
    relative = F.substring(plain, F.lit(len(bare_root) + 2), F.length(plain))
    month = F.regexp_extract(relative, r"(?:^|/)(\d\d)/\d\d/[^/]+$", 1)
    day = F.regexp_extract(relative, r"(?:^|/)(\d\d)/[^/]+$", 1)
    return (
        F.when(day != "", F.when(month != "", month).otherwise(F.lit(default_month))),
        F.when(day != "", day),
    )


def discover_days(spark: SparkSession, root: str) -> DataFrame:
    """(path, month, day) of every raw file below ``root``; others are ignored. Each file is
    listed once, also when several name patterns fit it, and no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv.gz,zip}")
        .load(root)
        .select("path")
    )
    month, day = path_day(F.col("path"), root)
    return files.select("path", month.alias("month"), day.alias("day")).where(F.col("day").isNotNull())


# ---------------------------------------------------------------- text files
def parse_rows(rows: DataFrame) -> DataFrame:
    """Typed kept columns of header-less raw rows (``RAW_SCHEMA``).

    Header lines are verified and dropped: a file without one of the kept columns fails the job.
    Rows longer than the header are skipped. A line is a header only if it holds column names, so
    garbage in a data line gives nulls (``bad_lines`` counts such lines) and never fails the job.
    """
    looks_like_header = F.col("timestamp").isin(RAW_COLUMNS) & F.col("latitude").isin(RAW_COLUMNS)
    names = F.concat_ws(",", *KEPT_COLUMNS)
    expected = ",".join(KEPT_COLUMNS)
    keep = F.when(
        looks_like_header,
        F.when(names == expected, F.lit(False)).otherwise(
            F.raise_error(F.concat(F.lit("unexpected header, wanted " + expected + ", found "), names)).cast("boolean")
        ),
    ).otherwise(F.lit(True))
    return rows.where(F.col(_SURPLUS).isNull() & keep)


def typed(rows: DataFrame, *extra: str) -> DataFrame:
    """Text columns -> timestamp long, device_aid string, coordinates double."""
    return rows.select(
        F.col("timestamp").try_cast("bigint").alias("timestamp"),
        F.nullif(F.col("device_aid"), F.lit("")).alias("device_aid"),
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
        F.nullif(F.col("location_method"), F.lit("")).alias("location_method"),
        *extra,
    )


def raw_lines(reader, root: str) -> DataFrame:
    """Untyped rows of the ``.csv.gz`` files below ``root`` with month, day and path; ``reader`` is
    ``spark.read`` or ``spark.readStream``."""
    rows = (
        reader.schema(RAW_SCHEMA)
        .options(**CSV_OPTIONS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz")
        .csv(root)
    )
    path = F.col("_metadata.file_path")
    month, day = path_day(path, root)
    return rows.withColumns({"month": month, "day": day, "path": path}).where(F.col("day").isNotNull())


def scan_raw_pings(spark: SparkSession, root: str) -> DataFrame:
    """All ``.csv.gz`` pings below ``root`` with month and day; only kept columns are parsed."""
    return typed(parse_rows(raw_lines(spark.read, root)), "month", "day")


def bad_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, n_lines, n_bad) per text file below ``root``, headers left out. A line is bad if it is
    longer than the header, or if its time or a coordinate is neither empty nor a number."""
    lines = raw_lines(spark.read, root).where(~F.coalesce(F.col("timestamp").isin(RAW_COLUMNS), F.lit(False)))
    bad = F.col(_SURPLUS).isNotNull()
    for name, kind in (("timestamp", "bigint"), ("latitude", "double"), ("longitude", "double")):
        bad = bad | ((F.coalesce(name, F.lit("")) != "") & F.col(name).try_cast(kind).isNull())
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_bad"))


# ---------------------------------------------------------------- archives
def scan_zip_pings(spark: SparkSession, root: str) -> DataFrame:
    """Pings of every ``.csv`` member of every zip archive below ``root``, with month and day."""
    return zip_lines(spark.read, root)


def zip_lines(reader, root: str) -> DataFrame:
    """As ``scan_zip_pings``; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    archives = (
        reader.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .load(root)
    )
    month, day = path_day(F.col("path"), root)
    archives = archives.select("path", "content", month.alias("month"), day.alias("day"))
    return unzip_pings(archives.where(F.col("day").isNotNull()), "month", "day")


def unzip_pings(archives: DataFrame, *carry: str) -> DataFrame:
    """(path, content, carried columns) -> typed pings; one archive per input row, read in chunks.
    An archive without ``.csv`` members gives no rows."""
    fields = ", ".join([f"`{c}` string" for c in KEPT_COLUMNS + list(carry)])
    text = archives.select("path", "content", *carry).mapInArrow(_unzip(list(carry)), fields)
    return typed(text, *carry)


def _unzip(carry: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in KEPT_COLUMNS + carry])
        for batch in batches:
            for row in range(batch.num_rows):
                path = batch.column("path")[row].as_py()
                content = batch.column("content")[row].as_buffer()
                tags = {c: batch.column(c)[row].as_py() for c in carry}
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.endswith(".csv"):
                            continue
                        with archive.open(name) as member:
                            for table in _tables(member, f"{path}:{name}", tags):
                                yield from pa.table(table, schema=schema).to_batches()

    return run


def _tables(member, where: str, tags: dict[str, str]) -> Iterator[dict[str, list]]:
    """Kept columns of one member, some thousand rows at a time; longer rows are skipped and
    shorter ones padded, as in text files."""
    reader = csv.reader(io.TextIOWrapper(member, encoding="utf-8", newline=""), delimiter="\t")
    header = next(reader, [])
    missing = [c for c in KEPT_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"missing columns {missing} in {where}")
    width, at = len(header), [header.index(c) for c in KEPT_COLUMNS]
    while rows := list(itertools.islice(reader, 50_000)):
        kept = [r + [""] * (width - len(r)) for r in rows if r and len(r) <= width]
        out = {c: [r[i] for r in kept] for c, i in zip(KEPT_COLUMNS, at)}
        yield {**out, **{c: [v] * len(kept) for c, v in tags.items()}}


def scan_all(spark: SparkSession, root: str) -> DataFrame:
    """Text files and archives together, without rows lacking a device or coordinate."""
    both = scan_raw_pings(spark, root).unionByName(scan_zip_pings(spark, root))
    return both.na.drop(subset=["device_aid", "latitude", "longitude"])
