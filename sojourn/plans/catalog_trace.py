"""Queries from ordered traces to stays and stop locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.operators import clean, places, trace
from sojourn.params import StayParams
from sojourn.plans import fixtures as fx
from sojourn.plans import oracles as o
from sojourn.plans import stays as st
from sojourn.plans.catalog_ingest import _CELL, _X, _Y, deg7
from sojourn.plans.registry import query
from sojourn.session import cut

P = StayParams()
LATLON = "round(latitude, 7) AS latitude, round(longitude, 7) AS longitude"
STOP = "round(stop_latitude, 7) AS stop_latitude, round(stop_longitude, 7) AS stop_longitude"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.one_per_second(st.prepared(fx.pings(spark, sf_dir)))


@query("fill_gaps", o.sql("SELECT device_aid, timestamp, latitude, longitude FROM filled", "filled"))
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.fill_gaps(fx.pings(spark, sf_dir))


@query(
    "stationary_events",
    o.sql(f"SELECT device_aid, event_start, event_end, n_pings, {LATLON} FROM stops", "stops"),
)
def stationary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = trace.fill_gaps(st.prepared(fx.pings(spark, sf_dir)))
    return trace.stationary_events(filled).select(
        "device_aid", "event_start", "event_end", "n_pings", *deg7("latitude", "longitude")
    )


o.cte(
    "untimed",
    ("pings",),
    """SELECT device_aid, place, ev, min(timestamp) AS event_start, count(*) AS n_pings, median(latitude) AS latitude,
    median(longitude) AS longitude FROM (
    SELECT *, sum(brk) OVER (PARTITION BY device_aid ORDER BY timestamp) AS ev FROM (
      SELECT *, CASE WHEN lag(place) OVER (PARTITION BY device_aid ORDER BY timestamp) = place THEN 0 ELSE 1 END AS brk FROM (
        SELECT *, lead(timestamp) OVER (PARTITION BY device_aid ORDER BY timestamp, latitude, longitude) AS nx
        FROM (SELECT DISTINCT device_aid, timestamp, latitude, longitude, place FROM pings))
      WHERE nx IS NULL OR nx <> timestamp))
  GROUP BY device_aid, place, ev HAVING count(*) >= 2""",
)


@query(
    "stationary_events_untimed",
    o.sql(f"SELECT device_aid, event_start, n_pings, {LATLON} FROM untimed", "untimed"),
)
def stationary_events_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trace.stationary_events(_clean(spark, sf_dir), timed=False)
    return events.select("device_aid", "event_start", "n_pings", *deg7("latitude", "longitude"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.stationary_events(_clean(spark, sf_dir), fill=True)


o.cte(
    "nodes",
    ("points",),
    """SELECT device_aid, place, latitude, longitude, n_events,
    row_number() OVER (PARTITION BY device_aid ORDER BY latitude, longitude) AS node FROM points""",
)
_D = o.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")
o.cte(
    "links",
    ("nodes",),
    f"""SELECT a.device_aid, a.node AS src, b.node AS dst, greatest(a.n_events, b.n_events) AS n, {_D} AS distance
  FROM nodes a JOIN nodes b ON a.device_aid = b.device_aid AND a.node < b.node WHERE {_D} <= 30""",
)
o.cte(
    "ranked",
    ("medians",),
    """SELECT *, dense_rank() OVER (PARTITION BY device_aid ORDER BY stop_latitude, stop_longitude) AS rank FROM medians""",
)


@query("unique_stop_points", o.sql(f"SELECT device_aid, {LATLON}, n_events, node FROM nodes", "nodes"))
def unique_stop_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = places.unique_points(_events(spark, sf_dir))
    return points.select("device_aid", *deg7("latitude", "longitude"), "n_events", F.col("node").cast("bigint").alias("node"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = places.radius_neighbors(places.unique_points(_events(spark, sf_dir)), P.r2)
    return pairs.withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")})


@query("radius_neighbors", o.sql("SELECT device_aid, src, dst, round(distance, 3) AS distance FROM links", "links"))
def radius_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("device_aid", "src", "dst", F.round("distance", 3).alias("distance"))


@query(
    "edge_weights",
    o.sql(
        "SELECT device_aid, src, dst, n::DOUBLE AS weight, round(n / distance, 6) AS weight_by_distance FROM links", "links"
    ),
)
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = places.edge_weights(_links(spark, sf_dir))
    both = places.edge_weights(plain.withColumnRenamed("weight", "plain"), weighted=True)
    return both.select(
        "device_aid", "src", "dst", F.col("plain").alias("weight"), F.round("weight", 6).alias("weight_by_distance")
    )


def _rank(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("device_aid").orderBy("stop_latitude", "stop_longitude")
    return rows.withColumn("rank", F.dense_rank().over(w).cast("bigint"))


@query(
    "stop_locations",
    o.sql(f"SELECT p.device_aid, {LATLON}, n_events, rank FROM points p JOIN ranked USING (device_aid, place)", "points", "ranked"),
)
def stop_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = places.stop_locations(places.unique_points(_events(spark, sf_dir)))
    return _rank(labelled).select("device_aid", *deg7("latitude", "longitude"), "n_events", "rank")


@query("label_medians", o.sql(f"SELECT device_aid, {STOP} FROM medians", "medians"))
def label_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = places.stop_locations(places.unique_points(_events(spark, sf_dir)))
    points = labelled.drop("stop_latitude", "stop_longitude")
    return places.label_medians(points).select("device_aid", *deg7("stop_latitude", "stop_longitude"))


@query(
    "label_pings",
    o.sql(f"SELECT device_aid, timestamp, {LATLON}, event_start, {STOP}, loc = -1 AS moving FROM labelled", "labelled"),
)
def label_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.labelled_pings(fx.pings(spark, sf_dir))
    return rows.select(
        "device_aid", "timestamp", *deg7("latitude", "longitude"), "event_start",
        *deg7("stop_latitude", "stop_longitude"), (F.col("loc") == -1).alias("moving"),
    )


@query(
    "interval_segments",
    o.sql("SELECT device_aid, timestamp, interval::INTEGER AS interval, loc = -1 AS moving FROM intervals", "intervals"),
)
def interval_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.labelled_pings(fx.pings(spark, sf_dir))
    return rows.select("device_aid", "timestamp", "interval", (F.col("loc") == -1).alias("moving"))


@query(
    "aggregate_stays",
    o.sql(f'SELECT device_aid, interval::INTEGER AS interval, start, "end", {LATLON}, size FROM stays', "stays"),
)
def aggregate_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = trace.aggregate_stays(st.labelled_pings(fx.pings(spark, sf_dir)))
    return stays.select("device_aid", "interval", "start", "end", *deg7("latitude", "longitude"), "size")


@query(
    "detect_stays",
    o.sql(
        f"""SELECT device_aid, start, "end", {LATLON}, size, start + 3600 AS localtime, "end" + 3600 AS l_localtime,
  round(("end" - start) / 60, 6) AS duration_min FROM stays""",
        "stays",
    ),
)
def detect_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = st.detect_stays(fx.pings(spark, sf_dir))
    return stays.select(
        "device_aid", "start", "end", *deg7("latitude", "longitude"), "size", "localtime", "l_localtime",
        F.round("duration_min", 6).alias("duration_min"),
    )


# ---------------------------------------------------------------- shared places
_SNAP = "round_even({0} / 0.00001::DOUBLE, 0) * 0.00001::DOUBLE"


def _corner(rows: DataFrame) -> DataFrame:
    """Name each community by its least coordinates, since label numbers are arbitrary."""
    least = rows.groupBy("loc").agg(F.min("latitude").alias("south"), F.min("longitude").alias("west"))
    return rows.join(least, "loc")


@query(
    "shared_stop_locations",
    o.sql(
        f"""SELECT device_aid, event_start, round(min({_SNAP.format('latitude')}) OVER (PARTITION BY place), 7) AS south,
  round(min({_SNAP.format('longitude')}) OVER (PARTITION BY place), 7) AS west FROM stops""",
        "stops",
    ),
)
def shared_stop_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = places.shared_stop_locations(_events(spark, sf_dir), resolution=1e-5)
    return _corner(shared).select("device_aid", "event_start", *deg7("south", "west"))


@query(
    "cluster_points",
    o.sql(
        """SELECT seq, round(min(latitude) OVER (PARTITION BY place), 7) AS south,
  round(min(longitude) OVER (PARTITION BY place), 7) AS west FROM pings""",
        "pings",
    ),
)
def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pings(spark, sf_dir).select("seq", "latitude", "longitude")
    return _corner(places.cluster_points(rows, resolution=1e-5)).select("seq", *deg7("south", "west"))


# ---------------------------------------------------------------- reports
@query(
    "label_intervals",
    o.sql(
        """SELECT device_aid, label, min(timestamp) AS start, max(timestamp) AS "end" FROM (
  SELECT *, sum(brk) OVER (PARTITION BY device_aid ORDER BY timestamp) AS run FROM (
    SELECT *, CASE WHEN lag(label) OVER w = label AND timestamp - lag(timestamp) OVER w < 86400 THEN 0 ELSE 1 END AS brk
    FROM (SELECT DISTINCT device_aid, timestamp, (timestamp // 7200) % 3 AS label FROM pings)
    WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp)))
  GROUP BY device_aid, label, run""",
        "pings",
    ),
)
def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pings(spark, sf_dir).withColumn("loc", F.expr("(timestamp div 7200) % 3"))
    return trace.label_intervals(rows)


@query(
    "downsampling_report",
    o.sql(
        """SELECT f.device_aid, n_pings, coalesce(n_events, 0) AS n_events, coalesce(n_points, 0) AS n_points,
  round((1 - coalesce(n_events, 0) / n_pings) * 100, 6) AS pct_reduction, round((1 - n_points / n_events) * 100, 6) AS pct_duplicates
  FROM (SELECT device_aid, count(*) AS n_pings FROM filled GROUP BY 1) f
  LEFT JOIN (SELECT device_aid, sum(n_events)::BIGINT AS n_events, count(*) AS n_points FROM points GROUP BY 1) p USING (device_aid)""",
        "filled",
        "points",
    ),
)
def downsampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trace.downsampling_report(trace.fill_gaps(fx.pings(spark, sf_dir)), _events(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_reduction", "pct_duplicates")})


def _labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.stop_locations(places.unique_points(_events(spark, sf_dir)))


@query("stop_hulls")
def stop_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.stop_hulls(_labelled_points(spark, sf_dir)).select("device_aid", "loc", "n_points", "ring")


@query(
    "stop_hulls_square",
    o.sql(
        """SELECT device_aid, count(*) AS n_points, round(avg(latitude) - side / 2, 7) AS south, round(avg(longitude) - side / 2, 7) AS west,
  round(avg(latitude) + side / 2, 7) AS north, round(avg(longitude) + side / 2, 7) AS east
  FROM (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 0.00005::DOUBLE ELSE
    sqrt(pow(max(latitude) OVER w - min(latitude) OVER w, 2) + pow(max(longitude) OVER w - min(longitude) OVER w, 2)) END AS side
    FROM points WINDOW w AS (PARTITION BY device_aid, place))
  GROUP BY device_aid, place, side HAVING count(*) <= 2""",
        "points",
    ),
)
def stop_hulls_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    hulls = places.stop_hulls(_labelled_points(spark, sf_dir)).where("n_points <= 2")
    corner = {
        "south": F.array_min("ring.lat"), "west": F.array_min("ring.lon"),
        "north": F.array_max("ring.lat"), "east": F.array_max("ring.lon"),
    }
    return hulls.select("device_aid", "n_points", *[F.round(c, 7).alias(n) for n, c in corner.items()])


@query(
    "stop_subset",
    o.sql(
        f"""WITH u AS (SELECT device_aid, latitude, longitude, arg_min(loc, timestamp) AS loc FROM labelled GROUP BY ALL)
  SELECT 'all' AS which, device_aid, {LATLON} FROM u
  UNION ALL SELECT 'all_stationary', device_aid, {LATLON} FROM u WHERE loc <> -1
  UNION ALL SELECT 'all_nonstationary', device_aid, {LATLON} FROM u WHERE loc = -1
  UNION ALL SELECT 'unique_stationary', device_aid, {LATLON} FROM points""".replace("WITH u AS (", "SELECT * FROM (WITH u AS (")
        + ")",
        "labelled",
        "points",
    ),
)
def stop_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = cut(st.labelled_pings(fx.pings(spark, sf_dir)))
    kinds = ["all", "all_stationary", "all_nonstationary", "unique_stationary"]
    parts = [
        trace.stop_subset(labelled, k).select(F.lit(k).alias("which"), "device_aid", *deg7("latitude", "longitude"))
        for k in kinds
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "point_density",
    o.sql(f"SELECT {_CELL} AS grid_id, count(*) AS n_points FROM (SELECT {_X} AS x, {_Y} AS y FROM pings) GROUP BY 1", "pings"),
)
def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.point_density(fx.pings(spark, sf_dir).select("latitude", "longitude"))
