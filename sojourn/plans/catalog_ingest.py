"""Queries for sources, sinks and row cleaning."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions import geo
from sojourn.functions.hashing import device_group
from sojourn.operators import clean, trace
from sojourn.plans import fixtures as fx
from sojourn.plans import oracles as o
from sojourn.plans import stays as st
from sojourn.plans.raw_folder import raw_folder, raw_rows
from sojourn.plans.registry import query
from sojourn.session import new_folder
from sojourn.sources import grouped, raw
from sojourn.streaming.ingest import ingest_incremental


def deg7(*names: str):
    return [F.round(n, 7).alias(n) for n in names]


def group_sql(device: str, n: int) -> str:
    acc = "0::BIGINT"
    for i in range(4):
        acc = f"(({acc} * 4294967296 + ('0x' || substr(md5({device}), {1 + 8 * i}, 8))::BIGINT) % {n})"
    return f"{acc}::INTEGER"


_DAY = "make_timestamp(timestamp * 1000000)"
o.cte(
    "raw_rows",
    ("dirty_pings",),
    f"""SELECT timestamp, device_aid, latitude, longitude, CASE WHEN timestamp % 2 = 0 THEN 'gps' ELSE 'wifi' END AS location_method,
  lpad(month({_DAY})::VARCHAR, 2, '0') AS month, lpad(day({_DAY})::VARCHAR, 2, '0') AS day FROM dirty_pings""",
)
o.cte(
    "clean_rows",
    ("raw_rows",),
    f"SELECT *, {group_sql('device_aid', 50)} AS grp FROM raw_rows WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
)


@query("scan_raw_pings", o.sql("SELECT * FROM raw_rows", "raw_rows"))
def scan_raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.scan_raw_pings(spark, raw_folder(spark, sf_dir))


def _zip_rows(key, batches):
    """Archive the rows of one small bucket, as text columns in the feed's order."""
    text = io.StringIO()
    text.write("\t".join(raw.RAW_COLUMNS) + "\n")
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in raw.KEPT_COLUMNS}
        for i in range(batch.num_rows):
            cells = (columns[c][i] if c in columns else "dummy" for c in raw.RAW_COLUMNS)
            text.write("\t".join("" if v is None else str(v) for v in cells) + "\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("pings.csv", text.getvalue())
        archive.writestr("README.txt", "not a table")
    return pa.RecordBatch.from_pydict({"path": [f"{key}.zip"], "content": [out.getvalue()]})


def _zip_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_zip_rows("-".join(str(k.as_py()) for k in key), table.to_batches())])


@query("scan_zip_pings", o.sql("SELECT timestamp, device_aid, latitude, longitude, location_method FROM raw_rows", "raw_rows"))
def scan_zip_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Buckets of device, hour and place bound the rows of one archive.
    rows = raw_rows(spark, sf_dir).select(*[F.col(c).cast("string") for c in raw.KEPT_COLUMNS])
    bucket = F.pmod(F.xxhash64(*raw.KEPT_COLUMNS), F.lit(512))
    archives = rows.groupBy(bucket.alias("bucket")).applyInArrow(_zip_bucket, "path string, content binary")
    return raw.unzip_pings(archives)


@query("discover_days", o.sql("SELECT DISTINCT month, day FROM raw_rows", "raw_rows"))
def discover_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.discover_days(spark, raw_folder(spark, sf_dir)).select("month", "day").distinct()


@query("device_registry", o.sql(f"SELECT DISTINCT month, device_aid, {group_sql('device_aid', 50)} AS grp FROM raw_rows", "raw_rows"))
def device_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.device_registry(raw.scan_raw_pings(spark, raw_folder(spark, sf_dir)))


def _grouped_folder(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "grouped")
    grouped.write_grouped_pings(clean.drop_null_pings(raw.scan_raw_pings(spark, raw_folder(spark, sf_dir))), path)
    return path


@query("write_grouped_pings", o.sql("SELECT * FROM clean_rows", "clean_rows"))
def write_grouped_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(spark, _grouped_folder(spark, sf_dir))


@query(
    "ingest_manifest",
    o.sql(
        """SELECT month, day, d.records, d.devices, g.grp, g.records AS grp_records FROM
  (SELECT month, day, count(*) AS records, count(DISTINCT device_aid) AS devices FROM clean_rows GROUP BY ALL) d
  JOIN (SELECT month, day, grp, count(*) AS records FROM clean_rows GROUP BY ALL) g USING (month, day)""",
        "clean_rows",
    ),
)
def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped.with_group(clean.drop_null_pings(raw_rows(spark, sf_dir)))
    days = grouped.manifest_days(rows)
    return days.select("month", "day", "records", "devices", F.explode("records_per_group").alias("grp", "grp_records"))


@query(
    "ingest_manifest_summary",
    o.sql(
        """SELECT sum(n)::BIGINT AS total_records, min(n) AS records_per_group_min, max(n) AS records_per_group_max,
  round(avg(n), 6) AS records_per_group_mean, (SELECT count(DISTINCT month || day) FROM clean_rows) AS days_processed
  FROM (SELECT grp, count(*) AS n FROM clean_rows GROUP BY grp)""",
        "clean_rows",
    ),
)
def ingest_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped.manifest_summary(grouped.with_group(clean.drop_null_pings(raw_rows(spark, sf_dir))))
    return out.withColumn("records_per_group_mean", F.round("records_per_group_mean", 6))


@query(
    "profile_pings",
    o.sql(
        """SELECT count(*) AS records, count(DISTINCT device_aid) AS devices, (SELECT count(DISTINCT month || day) FROM raw_rows) AS days,
  round(count(*) / count(DISTINCT device_aid), 6) AS mean_records_per_device, count(DISTINCT device_aid) // 50 AS devices_per_group_50,
  count(DISTINCT device_aid) // 100 AS devices_per_group_100, count(DISTINCT device_aid) // 300 AS devices_per_group_300 FROM clean_rows""",
        "clean_rows",
    ),
)
def profile_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped.profile_pings(raw_rows(spark, sf_dir))
    return out.withColumn("mean_records_per_device", F.round("mean_records_per_device", 6))


@query("ingest_incremental", o.sql("SELECT * FROM clean_rows", "clean_rows"))
def ingest_incremental_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, out, ckpt = raw_folder(spark, sf_dir), new_folder(spark, "stream"), new_folder(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        ingest_incremental(spark, root, out, ckpt)
    return grouped.read_grouped(spark, out)


@query(
    "scan_group_range",
    o.sql("SELECT device_aid, timestamp, latitude, longitude FROM clean_rows WHERE grp >= 10 AND grp < 30", "clean_rows"),
)
def scan_group_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.scan_group_range(spark, _grouped_folder(spark, sf_dir), 10, 30)


@query(
    "merge_stays",
    o.sql(
        f"""SELECT device_aid, start, "end", round(latitude, 7) AS latitude, round(longitude, 7) AS longitude, size::BIGINT AS size,
  {group_sql('device_aid', 3)} AS batch FROM stays""",
        "stays",
    ),
)
def merge_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = st.detect_stays(fx.pings(spark, sf_dir)).withColumn("batch", device_group("device_aid", 3))
    path = new_folder(spark, "stays")
    grouped.write_stays(stays, path)
    parts = [spark.read.schema(stays.schema).parquet(path).where(F.col("batch") == b) for b in range(3)]
    return grouped.merge_stays(parts).select("device_aid", "start", "end", *deg7("latitude", "longitude"), "size", "batch")


# ---------------------------------------------------------------- rows
@query("device_group", o.sql(f"SELECT user_id, device_aid, {group_sql('device_aid', 50)} AS grp FROM slots WHERE slot = 0", "slots"))
def device_group_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.slots(spark, sf_dir).where("slot = 0")
    return rows.select("user_id", "device_aid", device_group("device_aid", 50).alias("grp"))


@query("drop_null_pings", o.sql("SELECT * FROM dirty_pings WHERE latitude IS NOT NULL AND longitude IS NOT NULL", "dirty_pings"))
def drop_null_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_null_pings(fx.dirty_pings(spark, sf_dir))


@query(
    "valid_coordinates",
    o.sql("SELECT * FROM dirty_pings WHERE latitude BETWEEN -80 AND 84 AND longitude BETWEEN -180 AND 180", "dirty_pings"),
)
def valid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.valid_coordinates(fx.dirty_pings(spark, sf_dir))


@query("dedupe_pings", o.sql("SELECT DISTINCT * FROM dirty_pings WHERE latitude IS NOT NULL AND longitude IS NOT NULL", "dirty_pings"))
def dedupe_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedupe_pings(fx.dirty_pings(spark, sf_dir))


@query(
    "haversine_m",
    o.sql(f"SELECT seq, round({o.haversine('latitude', 'longitude', '55.6::DOUBLE', '13.0::DOUBLE')}, 3) AS metres FROM pings", "pings"),
)
def haversine_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine_m("latitude", "longitude", F.lit(55.6), F.lit(13.0))
    return fx.pings(spark, sf_dir).select("seq", F.round(d, 3).alias("metres"))


@query("euclidean", o.sql("SELECT seq, round(sqrt(pow(latitude - 55.6, 2) + pow(longitude - 13.0, 2)), 9) AS units FROM pings", "pings"))
def euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.euclidean("latitude", "longitude", F.lit(55.6), F.lit(13.0))
    return fx.pings(spark, sf_dir).select("seq", F.round(d, 9).alias("units"))


@query(
    "snap_resolution",
    o.sql(
        "SELECT seq, round(round_even(latitude / 0.0003::DOUBLE, 0) * 0.0003::DOUBLE, 7) AS latitude, "
        "round(round_even(longitude / 0.0003::DOUBLE, 0) * 0.0003::DOUBLE, 7) AS longitude FROM pings",
        "pings",
    ),
)
def snap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pings(spark, sf_dir)
    return rows.select("seq", *[F.round(geo.snap(c, 0.0003), 7).alias(c) for c in ("latitude", "longitude")])


def tm_sql(lat: str, lon: str) -> tuple[str, str]:
    """SQL for the projection, written out from the same series constants."""
    c = geo.tm_coefficients()
    e = f"{c['e']!r}::DOUBLE"
    s = f"sin(radians({lat}))"
    lam = f"radians(({lon}) - 15.0::DOUBLE)"
    t = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    xi = f"atan2({t}, cos({lam}))"
    eta = f"asinh(sin({lam}) / sqrt({t} * {t} + cos({lam}) * cos({lam})))"
    x, y = eta, xi
    for j, b in enumerate(c["beta"], start=1):
        x += f" + {b!r}::DOUBLE * cos({xi} * {2 * j}) * sinh({eta} * {2 * j})"
        y += f" + {b!r}::DOUBLE * sin({xi} * {2 * j}) * cosh({eta} * {2 * j})"
    scale = f"{geo.TM_K0 * c['a_hat']!r}::DOUBLE"
    return f"(500000.0::DOUBLE + {scale} * ({x}))", f"({scale} * ({y}))"


_X, _Y = tm_sql("latitude", "longitude")
_CELL = "floor(x / 250)::BIGINT || '_' || floor(y / 250)::BIGINT"


@query("project_xy", o.sql(f"SELECT seq, round({_X}, 2) AS x, round({_Y}, 2) AS y FROM pings", "pings"))
def project_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project_xy("latitude", "longitude")
    return fx.pings(spark, sf_dir).select("seq", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("grid_cell_id", o.sql(f"SELECT seq, {_CELL} AS grid_id FROM (SELECT seq, {_X} AS x, {_Y} AS y FROM pings)", "pings"))
def grid_cell_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project_xy("latitude", "longitude")
    return fx.pings(spark, sf_dir).select("seq", geo.grid_cell_id(x, y).alias("grid_id"))


@query(
    "city_filter",
    o.sql(
        """SELECT seq, device_aid, (seq % 3)::VARCHAR AS municipality_code FROM pings
  WHERE longitude BETWEEN 12.95 AND 13.05 AND latitude BETWEEN 55.55 AND 55.60 AND seq % 3 IN (0, 2)""",
        "pings",
    ),
)
def city_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pings(spark, sf_dir).withColumn("municipality_code", (F.col("seq") % 3).cast("string"))
    out = clean.city_filter(rows, (12.95, 55.55, 13.05, 55.60), ["0", "2"])
    return out.select("seq", "device_aid", "municipality_code")


o.cte(
    "checked",
    ("pings",),
    """SELECT device_aid, seq, timestamp, CASE WHEN seq % 70 = 0 THEN NULL ELSE latitude END AS latitude,
  CASE WHEN seq % 110 = 0 THEN 180.0::DOUBLE ELSE longitude END AS longitude FROM pings WHERE seq % 7 <> 3 OR device_aid NOT LIKE '%1'""",
)


@query(
    "trace_checks",
    o.sql(
        """SELECT device_aid, count(*) AS n_rows, count(*) FILTER (latitude IS NULL) AS n_missing,
  count(*) FILTER (nx < timestamp) AS n_unordered, count(*) FILTER (latitude IS NOT NULL AND abs(longitude) >= 180) AS n_outside,
  n_missing + n_unordered + n_outside = 0 AS ok
  FROM (SELECT *, lead(timestamp) OVER (PARTITION BY device_aid ORDER BY seq) AS nx FROM checked) GROUP BY device_aid""",
        "checked",
    ),
)
def trace_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pings(spark, sf_dir).where("seq % 7 <> 3 or device_aid not like '%1'")
    rows = rows.withColumn("latitude", F.when(F.col("seq") % 70 != 0, F.col("latitude")))
    rows = rows.withColumn("longitude", F.when(F.col("seq") % 110 == 0, 180.0).otherwise(F.col("longitude")))
    return clean.trace_checks(rows)


@query(
    "local_time",
    o.sql('SELECT device_aid, start, start + 3600 AS localtime, "end" + 3600 AS l_localtime FROM stays', "stays"),
)
def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = st.detect_stays(fx.pings(spark, sf_dir))
    return stays.select("device_aid", "start", "localtime", "l_localtime")


@query(
    "stay_duration",
    o.sql('SELECT device_aid, start, round(("end" - start) / 60, 6) AS duration_min FROM stays', "stays"),
)
def stay_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = trace.stay_duration(st.detect_stays(fx.pings(spark, sf_dir)).drop("duration_min"))
    return stays.select("device_aid", "start", F.round("duration_min", 6).alias("duration_min"))
