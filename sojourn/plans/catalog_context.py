"""Queries for anchors, zones, weights, venues and quality filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions import categories, geo
from sojourn.operators import anchors, clean, spatial, venues, zones
from sojourn.params import ScenarioParams, VenueParams
from sojourn.plans import fixtures as fx
from sojourn.plans import oracles as o
from sojourn.plans import stays as st
from sojourn.plans.catalog_ingest import _CELL, deg7, tm_sql
from sojourn.plans.catalog_trace import LATLON
from sojourn.plans.registry import query
from sojourn.session import cut


def _round(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- anchors
def ranked_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays whose labels are ranks of their coordinates, the same in both engines."""
    stays = st.detect_stays(fx.pings(spark, sf_dir))
    w = Window.partitionBy("device_aid").orderBy("latitude", "longitude")
    return stays.withColumn("loc", F.dense_rank().over(w).cast("bigint"))


o.cte(
    "rstays",
    ("stays",),
    """SELECT *, dense_rank() OVER (PARTITION BY device_aid ORDER BY latitude, longitude) AS loc,
    start + 3600 AS localtime, "end" + 3600 AS l_localtime FROM stays""",
)
o.cte(
    "stay_days",
    ("rstays",),
    """SELECT device_aid, loc, h // 24 AS day, h % 24 AS hour, sum(s)::BIGINT AS seconds FROM (
    SELECT *, least(l_localtime, (h + 1) * 3600) - greatest(localtime, h * 3600) AS s FROM (
      SELECT *, unnest(range(localtime // 3600, l_localtime // 3600 + 1)) AS h FROM rstays))
  WHERE s > 0 GROUP BY ALL""",
)
_TOP = """SELECT {by}, loc, {m} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {m} DESC, loc) AS rn FROM ({src})) WHERE rn = 1"""
o.cte(
    "candidates",
    ("stay_days",),
    _TOP.format(
        by="device_aid, night",
        m="seconds",
        src="""SELECT device_aid, loc, CASE WHEN hour >= 22 THEN day ELSE day - 1 END AS night, sum(seconds)::BIGINT AS seconds
    FROM stay_days WHERE hour >= 22 OR hour < 7 GROUP BY ALL""",
    ),
)
o.cte("observed", ("stay_days",), "SELECT DISTINCT device_aid, day FROM stay_days")
o.cte(
    "home_windows",
    ("candidates", "observed"),
    _TOP.format(
        by="device_aid, day",
        m="n_days",
        src="""SELECT o.device_aid, o.day, c.loc, count(*) AS n_days FROM observed o JOIN candidates c
    ON o.device_aid = c.device_aid AND c.night BETWEEN o.day - 13 AND o.day GROUP BY ALL HAVING count(*) >= 3""",
    ),
)
o.cte(
    "work_windows",
    ("stay_days", "observed", "home_windows"),
    _TOP.format(
        by="device_aid, day",
        m="seconds",
        src="""SELECT o.device_aid, o.day, b.loc, sum(b.seconds)::BIGINT AS seconds FROM observed o JOIN
    (SELECT * FROM stay_days WHERE (day + 3) % 7 < 5 AND hour BETWEEN 9 AND 16) b
    ON o.device_aid = b.device_aid AND b.day BETWEEN o.day - 27 AND o.day
    LEFT JOIN home_windows h ON h.device_aid = o.device_aid AND h.day = o.day AND h.loc = b.loc
    WHERE h.loc IS NULL GROUP BY ALL""",
    ),
)
o.cte(
    "anchors",
    ("home_windows", "work_windows", "rstays"),
    f"""SELECT coalesce(h.device_aid, w.device_aid) AS device_aid, h.latitude AS home_latitude, h.longitude AS home_longitude,
    w.latitude AS work_latitude, w.longitude AS work_longitude, coalesce(h.n, 0) AS n_home_days, coalesce(w.n, 0) AS n_work_days
  FROM (SELECT * FROM ({_TOP.format(by='device_aid', m='n', src='SELECT device_aid, loc, count(*) AS n FROM home_windows GROUP BY ALL')})
    JOIN (SELECT device_aid, loc, max(latitude) AS latitude, max(longitude) AS longitude FROM rstays GROUP BY ALL) USING (device_aid, loc)) h
  FULL JOIN (SELECT * FROM ({_TOP.format(by='device_aid', m='n', src='SELECT device_aid, loc, count(*) AS n FROM work_windows GROUP BY ALL')})
    JOIN (SELECT device_aid, loc, max(latitude) AS latitude, max(longitude) AS longitude FROM rstays GROUP BY ALL) USING (device_aid, loc)) w
  ON h.device_aid = w.device_aid""",
)


@query("stay_days", o.sql("SELECT * FROM stay_days", "stay_days"))
def stay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.stay_days(ranked_stays(spark, sf_dir))


@query("home_candidates_daily", o.sql("SELECT * FROM candidates", "candidates"))
def home_candidates_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.home_candidates_daily(anchors.stay_days(ranked_stays(spark, sf_dir)))


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    days = cut(anchors.stay_days(ranked_stays(spark, sf_dir)))
    seen = anchors.observed_days(days)
    return days, seen, anchors.home_by_window(anchors.home_candidates_daily(days), seen)


@query("home_by_window", o.sql("SELECT * FROM home_windows", "home_windows"))
def home_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[2]


@query("work_by_window", o.sql("SELECT * FROM work_windows", "work_windows"))
def work_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, seen, homes = _windows(spark, sf_dir)
    return anchors.work_by_window(days, homes, seen)


_HX, _HY = tm_sql("home_latitude", "home_longitude")
_PLACES = ("home_latitude", "home_longitude", "work_latitude", "work_longitude")


@query(
    "home_work_locations",
    o.sql(
        f"""SELECT device_aid, {', '.join(f'round({c}, 7) AS {c}' for c in _PLACES)}, n_home_days, n_work_days,
  CASE WHEN home_latitude IS NOT NULL THEN {_CELL} END AS home_grid_id FROM (SELECT *, {_HX} AS x, {_HY} AS y FROM anchors)""",
        "anchors",
    ),
)
def home_work_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(anchors.detect_home_work(cut(ranked_stays(spark, sf_dir))), 7, *_PLACES)


# ---------------------------------------------------------------- buildings
BOXES = [(12.90, 55.53, 13.02, 55.64), (13.00, 55.53, 13.12, 55.64)]


def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping downloads of the same footprints."""
    b = fx.buildings(spark, sf_dir)
    return zones.residential_buildings(b.union(b.where("building_id % 4 = 0")), BOXES)


o.cte(
    "homes",
    ("slots",),
    f"""SELECT device_aid, user_id, gy, gx, {o.deg('5553000 + gy * 100 + 4')} AS home_latitude,
    {o.deg('1290000 + gx * 200 + 4')} AS home_longitude, user_id % 10 <> 7 AS has_home FROM slots WHERE slot = 0""",
)
o.cte(
    "footprints",
    ("slots",),
    f"""SELECT user_id AS building_id, {o.deg('lat - h')} AS south, {o.deg('lon - h')} AS west, {o.deg('lat + h')} AS north,
    {o.deg('lon + h')} AS east, {o.deg('lat')} AS building_latitude, {o.deg('lon')} AS building_longitude
  FROM (SELECT user_id, 4 + user_id % 9 AS h, 5553000 + gy * 100 + 4 + CASE WHEN user_id % 5 = 0 THEN 30 ELSE 0 END AS lat,
    1290000 + gx * 200 + 4 AS lon FROM slots WHERE slot = 0 AND user_id % 10 <> 3 AND user_id % 13 <> 0)""",
)
_CORNERS = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]


def _edges_sql(source: str, key: str) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(_CORNERS, _CORNERS[1:]):
        x1, y1 = tm_sql(ay, ax)
        x2, y2 = tm_sql(by, bx)
        parts.append(f"SELECT {key}, south, west, north, east, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM {source}")
    return "\nUNION ALL ".join(parts)


o.cte("footprint_edges", ("footprints",), _edges_sql("footprints", "building_id"))
_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"
o.cte(
    "building_links",
    ("homes", "footprint_edges"),
    f"""SELECT device_aid, building_id, d FROM (
    SELECT device_aid, building_id, min(d) AS d, row_number() OVER (PARTITION BY device_aid ORDER BY min(d), building_id) AS rn FROM (
      SELECT device_aid, building_id, CASE WHEN home_latitude > south AND home_latitude < north AND home_longitude > west AND home_longitude < east
        THEN 0.0::DOUBLE ELSE sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2) END AS d FROM (
        SELECT *, {_T} AS t FROM (SELECT *, {_HX} AS x, {_HY} AS y FROM homes WHERE has_home) h JOIN footprint_edges
          ON abs(home_latitude - south) < 0.002 AND abs(home_longitude - west) < 0.003))
    GROUP BY device_aid, building_id HAVING min(d) <= 50) WHERE rn = 1""",
)
_BUILDING = ("building_latitude", "building_longitude")


@query(
    "residential_buildings",
    o.sql(f"SELECT building_id, {', '.join(f'round({c}, 7) AS {c}' for c in _BUILDING)} FROM footprints", "footprints"),
)
def residential_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buildings(spark, sf_dir).select("building_id", *deg7(*_BUILDING))


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.homes(spark, sf_dir).where("has_home").drop("has_home")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.link_home_buildings(_homes(spark, sf_dir), _buildings(spark, sf_dir))


@query(
    "link_home_buildings",
    o.sql(
        f"""SELECT h.device_aid, l.building_id, round(l.d, 3) AS distance_m, l.building_id IS NOT NULL AS has_building,
  {', '.join(f'round({c}, 7) AS {c}' for c in _BUILDING)} FROM (SELECT * FROM homes WHERE has_home) h
  LEFT JOIN building_links l USING (device_aid) LEFT JOIN footprints f ON f.building_id = l.building_id""",
        "building_links",
        "footprints",
    ),
)
def link_home_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _links(spark, sf_dir)
    return out.select("device_aid", "building_id", F.round("distance_m", 3).alias("distance_m"), "has_building", *deg7(*_BUILDING))


# ---------------------------------------------------------------- zones
o.cte(
    "zones",
    (),
    f"""SELECT zone_id, population, {o.deg('south')} AS south, {o.deg('west')} AS west, {o.deg('south + 2200')} AS north, {o.deg('west + 4400')} AS east
  FROM (SELECT n_nationkey::BIGINT AS zone_id, 5553000 + (n_nationkey // 5) * 2200 AS south, 1290000 + (n_nationkey % 5) * 4400 AS west,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * 10 * CASE WHEN n_nationkey % 12 = 0 THEN 15 ELSE 1 END AS population FROM nation)""",
)
o.cte(
    "profile",
    ("zones",),
    """SELECT zone_id, population, 50 + zone_id * 2 AS birth_sweden, 20::BIGINT AS birth_europe, 30 - zone_id AS birth_other,
    20000 + ((zone_id * 7) % 25) * 1000 AS income, population * (20 + zone_id) // 100 AS cars FROM zones""",
)


@query("pivot_zone_attributes", o.sql("SELECT zone_id, birth_sweden, birth_europe, birth_other FROM profile", "profile"))
def pivot_zone_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.pivot_zone_attributes(fx.zone_birth(spark, sf_dir))


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    births = zones.pivot_zone_attributes(fx.zone_birth(spark, sf_dir))
    return zones.zone_profile(fx.zones(spark, sf_dir), births, fx.zone_income(spark, sf_dir), fx.zone_cars(spark, sf_dir))


@query(
    "zone_profile",
    o.sql(
        """SELECT zone_id, population, birth_sweden, birth_europe, birth_other, income, cars,
  round(100 * (birth_europe + birth_other) / (birth_sweden + birth_europe + birth_other), 6) AS pct_foreign_born,
  round(CASE WHEN population > 0 THEN cars / population END, 6) AS cars_per_capita FROM profile""",
        "profile",
    ),
)
def zone_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(zone_table(spark, sf_dir).drop("ring", "zone_type"), 6, "pct_foreign_born", "cars_per_capita")


@query(
    "income_quartiles",
    o.sql(
        """SELECT zone_id, income, 'Q' || (1 + (income > q[1])::INT + (income > q[2])::INT + (income > q[3])::INT) AS income_quartile
  FROM profile, (SELECT quantile_cont(income, [0.25, 0.5, 0.75]) AS q FROM profile)""",
        "profile",
    ),
)
def income_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.income_quartiles(fx.zone_income(spark, sf_dir))


def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    majority = F.when(F.col("zone_id") >= 12, "native_born").otherwise("foreign_born")
    rows = fx.zones(spark, sf_dir).select("zone_id", majority.alias("birth_background"))
    return zones.register_groups(rows, "birth_background", ["native_born"], ["foreign_born"])


@query(
    "socioeconomic_groups",
    o.sql(
        """SELECT 'zone_' || zone_id AS area_id, CASE WHEN zone_id >= 12 THEN 'advantaged' ELSE 'disadvantaged' END AS group_variable, 1 AS tier FROM zones
  UNION ALL SELECT DISTINCT 'cell_' || (gy * 110 + gx), CASE WHEN (gy * 31 + gx * 17) % 100 >= 50 THEN 'disadvantaged' ELSE 'advantaged' END, 3 FROM slots""",
        "zones",
        "slots",
    ),
)
def socioeconomic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.slots(spark, sf_dir).select(
        (F.col("gy") * 110 + F.col("gx")).alias("grid_id"), ((F.col("gy") * 31 + F.col("gx") * 17) % 100).alias("deprivation")
    )
    tier3 = zones.gridded_groups(cells.distinct())
    tier1 = group_table(spark, sf_dir)
    return tier1.withColumn("area_id", F.concat(F.lit("zone_"), "zone_id")).drop("zone_id").unionByName(
        tier3.withColumn("area_id", F.concat(F.lit("cell_"), "grid_id")).drop("grid_id")
    )


o.cte("home_zones", ("homes",), "SELECT device_aid, 5 * (gy // 22) + gx // 22 AS zone_id FROM homes WHERE has_home")


@query("home_zone", o.sql("SELECT * FROM home_zones", "home_zones"))
def home_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.home_zone(_homes(spark, sf_dir), fx.zones(spark, sf_dir))


def device_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of devices with a home and a building."""
    linked = _links(spark, sf_dir).where("has_building")
    return zones.home_zone(linked, fx.zones(spark, sf_dir))


o.cte("used_zones", ("home_zones", "building_links"), "SELECT h.* FROM home_zones h JOIN building_links USING (device_aid)")
o.cte(
    "ipw",
    ("used_zones", "zones"),
    """SELECT zone_id, n_devices, population, (population / (SELECT sum(population) FROM zones)) / (n_devices / (SELECT count(*) FROM used_zones)) AS raw_weight
  FROM (SELECT zone_id, count(*) AS n_devices FROM used_zones GROUP BY 1) JOIN zones USING (zone_id)""",
)
o.cte(
    "weights",
    ("ipw",),
    """SELECT *, least(raw_weight, w0, 10.0::DOUBLE) AS population_weight, least(raw_weight, w0, 3.0::DOUBLE) AS capped_weight FROM ipw,
  (SELECT sqrt(pow(coalesce(stddev_samp(raw_weight), 0) / avg(raw_weight), 2) + 1) * 3.5 * median(raw_weight) AS w0 FROM ipw)""",
)


@query("raw_ipw", o.sql("SELECT zone_id, n_devices, population, round(raw_weight, 6) AS raw_weight FROM ipw", "ipw"))
def raw_ipw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(zones.raw_ipw(device_zones(spark, sf_dir), fx.zones(spark, sf_dir)), 6, "raw_weight")


@query(
    "trimmed_ipw",
    o.sql(
        """SELECT zone_id, round(w0, 6) AS trim_limit, round(population_weight, 6) AS population_weight,
  round(capped_weight, 6) AS capped_weight FROM weights""",
        "weights",
    ),
)
def trimmed_ipw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cut(zones.raw_ipw(device_zones(spark, sf_dir), fx.zones(spark, sf_dir)))
    tight = zones.trimmed_ipw(raw, ScenarioParams(max_weight=3.0)).select("zone_id", F.col("population_weight").alias("capped_weight"))
    out = zones.trimmed_ipw(raw).select("zone_id", "trim_limit", "population_weight").join(tight, "zone_id")
    return _round(out, 6, "trim_limit", "population_weight", "capped_weight")


def device_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All devices with weight, zone and group; the rest have nulls."""
    at = cut(device_zones(spark, sf_dir))
    weights = zones.trimmed_ipw(cut(zones.raw_ipw(at, fx.zones(spark, sf_dir))))
    return zones.weighted_devices(
        fx.homes(spark, sf_dir).select("device_aid"), at, weights, group_table(spark, sf_dir).drop("tier")
    )


o.cte(
    "devices",
    ("homes", "used_zones", "weights"),
    """SELECT h.device_aid, u.zone_id, w.population_weight,
    CASE WHEN u.zone_id >= 12 THEN 'advantaged' WHEN u.zone_id < 12 THEN 'disadvantaged' END AS group_variable
  FROM homes h LEFT JOIN used_zones u USING (device_aid) LEFT JOIN weights w ON w.zone_id = u.zone_id""",
)


@query(
    "weighted_devices",
    o.sql("SELECT device_aid, zone_id, round(population_weight, 6) AS population_weight, group_variable FROM devices", "devices"),
)
def weighted_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(device_table(spark, sf_dir), 6, "population_weight")


# ---------------------------------------------------------------- venues
_NAMES = [c for c, _ in fx.CATEGORY_SAMPLE]
_LIST = "[" + ", ".join(f"'{c}'" for c in _NAMES) + "]"
o.cte(
    "pois",
    ("slots",),
    f"""SELECT poi_id, lat_e5, lon_e5, {o.deg('lat_e5')} AS latitude, {o.deg('lon_e5')} AS longitude, cat_no,
    CASE WHEN cat_no < 12 THEN ({_LIST})[cat_no + 1] END AS category FROM (
    SELECT p_partkey AS poi_id, p_partkey % 15 AS cat_no, 5553000 + ((p_partkey * 61 + p_partkey // 110) % 110) * 100 + 50 AS lat_e5,
      1290000 + ((p_partkey * 29 + p_partkey // 13) % 110) * 200 + 60 AS lon_e5 FROM part
    UNION ALL SELECT 1000000 + user_id * 5 + slot, (user_id + slot) % 12, 5553000 + gy * 100 + 4 + ([0, 14, 36, 80, 400])[(user_id + slot) % 5 + 1],
      1290000 + gx * 200 + 4 FROM slots WHERE slot >= 1)""",
)


@query("map_poi_category", o.sql("SELECT poi_id, category FROM pois", "pois"))
def map_poi_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.map_poi_category(fx.pois(spark, sf_dir)).select("poi_id", "category")


@query("map_osm_category", o.sql("SELECT poi_id, category FROM pois", "pois"))
def map_osm_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.map_osm_category(fx.pois(spark, sf_dir)).select("poi_id", "category")


def poi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.exclude_poi(venues.map_poi_category(fx.pois(spark, sf_dir)))


@query("exclude_poi", o.sql("SELECT poi_id, category FROM pois WHERE cat_no < 12", "pois"))
def exclude_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi_table(spark, sf_dir).select("poi_id", "category")


def stop_table(spark: SparkSession, sf_dir: str, pings: DataFrame | None = None) -> DataFrame:
    stays = st.detect_stays(fx.pings(spark, sf_dir) if pings is None else pings)
    return stays.withColumn("stop_id", F.concat_ws("@", "device_aid", "start"))


_HOME_D = o.haversine("s.latitude", "s.longitude", "h.home_latitude", "h.home_longitude")
o.cte(
    "away",
    ("stays", "homes"),
    f"""SELECT device_aid || '@' || start AS stop_id, s.* FROM stays s JOIN homes h USING (device_aid)
  WHERE h.has_home AND {_HOME_D} > 100""",
)
o.cte("spots", ("away",), "SELECT DISTINCT latitude, longitude FROM away")
_POI_D = o.haversine("s.latitude", "s.longitude", "p.latitude", "p.longitude")
o.cte(
    "contained",
    ("spots", "pois"),
    f"""SELECT s.latitude, s.longitude, min(poi_id) AS poi_id FROM spots s JOIN pois p ON p.cat_no < 12
    AND s.latitude > {o.deg('lat_e5 - 6')} AND s.latitude < {o.deg('lat_e5 + 6')}
    AND s.longitude > {o.deg('lon_e5 - 6')} AND s.longitude < {o.deg('lon_e5 + 6')} GROUP BY ALL""",
)
o.cte(
    "closest",
    ("spots", "pois"),
    f"""SELECT latitude, longitude, poi_id, d FROM (
    SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY d, poi_id) AS rn FROM (
      SELECT s.latitude, s.longitude, poi_id, {_POI_D} AS d FROM spots s JOIN pois p ON p.cat_no < 12
        AND p.latitude BETWEEN s.latitude - 0.001 AND s.latitude + 0.001 AND p.longitude BETWEEN s.longitude - 0.002 AND s.longitude + 0.002)
    WHERE d <= 100) WHERE rn = 1""",
)
o.cte(
    "visits",
    ("away", "contained", "closest", "pois"),
    """SELECT a.device_aid, a.stop_id, coalesce(c.poi_id, n.poi_id) AS poi_id, p.category AS poi_category,
    CASE WHEN c.poi_id IS NOT NULL THEN 1 WHEN n.d <= 20 THEN 2 WHEN n.d <= 50 THEN 3 WHEN n.d <= 100 THEN 4 END AS match_tier,
    CASE WHEN c.poi_id IS NOT NULL THEN 0.0::DOUBLE ELSE n.d END AS distance_to_poi, p.latitude AS poi_latitude, p.longitude AS poi_longitude
  FROM away a LEFT JOIN contained c USING (latitude, longitude) LEFT JOIN closest n USING (latitude, longitude)
  LEFT JOIN pois p ON p.poi_id = coalesce(c.poi_id, n.poi_id)""",
)


def away_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(venues.non_home_stops(stop_table(spark, sf_dir), _homes(spark, sf_dir)))


@query("non_home_stops", o.sql(f"SELECT stop_id, device_aid, {LATLON} FROM away", "away"))
def non_home_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.non_home_stops(stop_table(spark, sf_dir), _homes(spark, sf_dir))
    return out.select("stop_id", "device_aid", *deg7("latitude", "longitude"))


@query("poi_containment", o.sql("SELECT stop_id, poi_id FROM away JOIN contained USING (latitude, longitude)", "away", "contained"))
def poi_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.poi_containment(away_stops(spark, sf_dir), poi_table(spark, sf_dir))


@query(
    "poi_within",
    o.sql("SELECT stop_id, poi_id, round(d, 3) AS distance_m FROM away JOIN closest USING (latitude, longitude)", "away", "closest"),
)
def poi_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(venues.poi_within(away_stops(spark, sf_dir), poi_table(spark, sf_dir)), 3, "distance_m")


def visit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.assign_poi(away_stops(spark, sf_dir), cut(poi_table(spark, sf_dir)))


@query(
    "assign_poi",
    o.sql(
        """SELECT device_aid, stop_id, poi_id, poi_category, match_tier, round(distance_to_poi, 3) AS distance_to_poi,
  round(poi_latitude, 7) AS poi_latitude, round(poi_longitude, 7) AS poi_longitude FROM visits""",
        "visits",
    ),
)
def assign_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visit_table(spark, sf_dir).select(
        "device_aid", "stop_id", "poi_id", "poi_category", "match_tier",
        F.round("distance_to_poi", 3).alias("distance_to_poi"), *deg7("poi_latitude", "poi_longitude"),
    )


@query(
    "match_rate",
    o.sql(
        """SELECT coalesce(match_tier, 0) AS match_tier, count(*) AS n_stops, round(count(*) / (SELECT count(*) FROM visits), 6) AS share FROM visits GROUP BY 1
  UNION ALL SELECT -1, count(match_tier), round(count(match_tier) / count(*), 6) FROM visits""",
        "visits",
    ),
)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(venues.match_rate(cut(visit_table(spark, sf_dir))), 6, "share")


# ---------------------------------------------------------------- filters
_LIMITS = VenueParams(min_stops_per_device=48, min_days_observed=22)
o.cte(
    "far_pings",
    ("truth",),
    f"""SELECT timestamp, device_aid, latitude, longitude, place FROM truth UNION ALL
  SELECT t + 20000 + 300 * k, device_aid, {o.deg('5778000 + gy * 100')}, {o.deg('1290000 + gx * 200')}, -1000 - user_id FROM (
    SELECT user_id, device_aid, max(timestamp) AS t, (user_id * 37) % 110 AS gy, (user_id * 53) % 110 AS gx, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS k
    FROM truth WHERE user_id % 30 = 11 GROUP BY user_id, device_aid)""",
)
o.stay_chain("far_", "far_pings")
o.cte(
    "far_kept",
    ("far_stays", "homes"),
    f"""SELECT s.* FROM far_stays s JOIN (SELECT device_aid FROM far_stays s LEFT JOIN homes h USING (device_aid)
    GROUP BY device_aid HAVING count(*) >= 48 AND count(DISTINCT (start + 3600) // 86400) >= 22 AND max({_HOME_D}) <= 200000) USING (device_aid)""",
)


@query("filter_devices", o.sql(f'SELECT device_aid, start, "end", {LATLON} FROM far_kept', "far_kept"))
def filter_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = cut(stop_table(spark, sf_dir, fx.far_pings(spark, sf_dir)))
    out = venues.filter_devices(stops, fx.homes(spark, sf_dir), _LIMITS)
    return out.select("device_aid", "start", "end", *deg7("latitude", "longitude"))


@query("filter_stops", o.sql('SELECT device_aid, start, "end" FROM stays WHERE "end" - start >= 45 * 60', "stays"))
def filter_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.filter_stops(stop_table(spark, sf_dir), 45).select("device_aid", "start", "end")


o.cte(
    "twin_pings",
    ("truth",),
    """SELECT timestamp, device_aid, latitude, longitude, place FROM truth UNION ALL
  SELECT timestamp + 60, 'dup_' || user_id, latitude, longitude, place FROM truth WHERE user_id % 20 = 0""",
)
o.stay_chain("twin_", "twin_pings")
o.cte(
    "twin_homes",
    ("users",),
    """SELECT 'dev_' || user_id AS device_aid, user_id % 50 AS building_id FROM users
  UNION ALL SELECT 'dup_' || user_id, user_id % 50 FROM users WHERE user_id % 20 = 0""",
)
o.cte(
    "twin_pairs",
    ("twin_stays", "twin_homes"),
    """SELECT a.device_aid AS src, b.device_aid AS dst FROM
    (SELECT * FROM twin_stays JOIN twin_homes USING (device_aid)) a JOIN (SELECT * FROM twin_stays JOIN twin_homes USING (device_aid)) b
    ON a.building_id = b.building_id AND a.device_aid < b.device_aid AND a.start < b."end" AND b.start < a."end"
    JOIN (SELECT device_aid, sum("end" - start) AS total FROM twin_stays GROUP BY 1) ta ON ta.device_aid = a.device_aid
    JOIN (SELECT device_aid, sum("end" - start) AS total FROM twin_stays GROUP BY 1) tb ON tb.device_aid = b.device_aid
  GROUP BY a.device_aid, b.device_aid, ta.total, tb.total
  HAVING sum(least(a."end", b."end") - greatest(a.start, b.start)) >= 0.8 * least(ta.total, tb.total)""",
)
o.cte(
    "twin_reach",
    ("twin_homes", "twin_pairs"),
    """SELECT device_aid, device_aid AS other FROM twin_homes
  UNION SELECT r.device_aid, CASE WHEN p.src = r.other THEN p.dst ELSE p.src END FROM twin_reach r JOIN twin_pairs p ON r.other IN (p.src, p.dst)""",
)


@query(
    "consolidate_duplicates",
    o.sql("SELECT device_aid, min(other) AS merged_into FROM twin_reach GROUP BY 1", "twin_reach"),
)
def consolidate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = cut(stop_table(spark, sf_dir, fx.twin_pings(spark, sf_dir)))
    u = fx.users(spark, sf_dir)
    every = u.select(F.concat(F.lit("dev_"), "user_id").alias("device_aid"), (F.col("user_id") % 50).alias("building_id"))
    twins = u.where("user_id % 20 = 0").select(
        F.concat(F.lit("dup_"), "user_id").alias("device_aid"), (F.col("user_id") % 50).alias("building_id")
    )
    return venues.consolidate_duplicates(stays, every.union(twins))
