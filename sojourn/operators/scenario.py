"""Rewiring trips to venues within reach, experienced segregation and localizability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions import geo
from sojourn.functions.hashing import uniform_draw
from sojourn.params import ScenarioParams


# ---------------------------------------------------------------- rewiring
def within_isochrone(trips: DataFrame, homes: DataFrame, reachable: DataFrame) -> DataFrame:
    """Flag trips whose venue already lies within reach of the device's home cell.

    ``trips``: stop_id, device_aid, poi_id, category; ``homes``: device_aid, grid_id. The lookup is
    done once per device and venue, not per trip.
    """
    pairs = trips.select("device_aid", "poi_id").distinct().join(homes.select("device_aid", "grid_id"), "device_aid")
    near = reachable.select("grid_id", "poi_id").distinct().withColumn("_in", F.lit(True))
    flags = pairs.join(near, ["grid_id", "poi_id"], "left")
    return trips.join(
        flags.select("device_aid", "poi_id", "grid_id", F.coalesce("_in", F.lit(False)).alias("within_isochrone")),
        ["device_aid", "poi_id"],
        "left",
    ).withColumn("within_isochrone", F.coalesce("within_isochrone", F.lit(False)))


#: Rows of one side of a report of pairs that stand together before the other side moves on. Files in columns keep
#: such runs and repeats in little space; a multiple of eight, as they pack eight values at a time.
TILE = 256


def rewire_candidates(flagged: DataFrame, reachable: DataFrame) -> DataFrame:
    """Same-category venues within reach for every trip that is not within already.

    Trips meet tiles of the venues of their cell and category, not single venues, and all trips pass one tile before
    the next.
    """
    away = flagged.where(~F.col("within_isochrone")).select("stop_id", "device_aid", "grid_id", "category")
    venue = F.struct(F.col("poi_id").alias("candidate_id"))
    venues = reachable.groupBy("grid_id", "category").agg(F.sort_array(F.collect_set(venue)).alias("_all"))
    tiles = _tiles(venues, ["grid_id", "category"], "_all")
    return tiles.join(away, ["grid_id", "category"]).select(
        "grid_id", "category", "stop_id", "device_aid", F.inline("_tile")
    )


def _tiles(rows: DataFrame, by: list[str], items: str, line: Callable[[Column], Column] | None = None) -> DataFrame:
    """The array ``items`` of each row in ``_tile``, a row per ``TILE`` items; ``line`` is done to every item."""

    def tile(start: Column) -> Column:
        part = F.slice(items, start, TILE)
        return F.transform(part, line) if line else part

    starts = F.sequence(F.lit(1), F.size(items), F.lit(TILE))
    return rows.select(*by, F.explode(F.transform(starts, tile)).alias("_tile"))


SPOT = ["grid_id", "home_latitude", "home_longitude"]


def running_shares(
    wanted: DataFrame, reachable: DataFrame, homes: DataFrame, pois: DataFrame, p: ScenarioParams = ScenarioParams()
) -> DataFrame:
    """One row per home spot and category: its candidates in venue order, with running weights.

    ``wanted``: device_aid, category (any number of rows). Devices that live at one spot share a row,
    so nothing here grows with devices or trips. ``candidates`` is an array of (poi_id, km, weight,
    run), bounded by the venues of one category within one walk; the last run is the total. Homes
    without coordinates have no candidates.
    """
    at = pois.select("poi_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    home = homes.select("device_aid", *SPOT)
    spots = wanted.select("device_aid", "category").distinct().join(home, "device_aid").select(*SPOT, "category").distinct()
    spots = spots.where(F.col("home_latitude").isNotNull() & F.col("home_longitude").isNotNull())
    venues = reachable.select("grid_id", "category", "poi_id").distinct().join(at, "poi_id")
    km = geo.haversine_m("home_latitude", "home_longitude", "_lat", "_lon") / 1000
    km = F.greatest(km, F.lit(float(p.floor_km)))
    if p.decay == "power":
        weight = F.pow(km, F.lit(-float(p.beta)))
    elif p.decay == "exponential":
        weight = F.exp(-float(p.beta) * km)
    else:
        raise ValueError(f"unknown decay {p.decay!r}")
    rows = spots.join(venues, ["grid_id", "category"]).withColumns({"km": km, "weight": weight})
    upto = Window.partitionBy(*SPOT, "category").orderBy("poi_id")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The window and the grouping have the same keys: one shuffle serves both.
    rows = rows.withColumn("run", F.sum("weight").over(upto))
    steps = F.sort_array(F.collect_list(F.struct("poi_id", "km", "weight", "run")))
    return rows.groupBy(*SPOT, "category").agg(steps.alias("candidates"))


def decay_weights(
    wanted: DataFrame,
    reachable: DataFrame,
    homes: DataFrame,
    pois: DataFrame,
    p: ScenarioParams = ScenarioParams(),
    digits: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Candidate shares per device and category, decaying with distance from home.

    A report with a row per device and venue; :func:`rewire_trips` draws from the running shares
    per home spot instead. Shares, and the rounding of (km, weight, share) to ``digits``, are done
    once per home spot, before the rows are spread over its devices, a tile of them at a time.
    """
    shares = running_shares(wanted, reachable, homes, pois, p)
    total = F.element_at("candidates", -1)["run"]

    def rounded(value: Column, i: int) -> Column:
        return F.round(value, digits[i]) if digits else value

    def line(c: Column) -> Column:
        return F.struct(
            c["poi_id"].alias("poi_id"),
            rounded(c["km"], 0).alias("km"),
            rounded(c["weight"], 1).alias("weight"),
            rounded(c["weight"] / total, 2).alias("share"),
        )

    tiles = _tiles(shares, [*SPOT, "category"], "candidates", line)
    devices = wanted.select("device_aid", "category").distinct().join(homes.select("device_aid", *SPOT), "device_aid")
    return tiles.join(devices, [*SPOT, "category"]).select("device_aid", "category", F.inline("_tile"))


def _drawn(candidates: Column, u: Column) -> Column:
    """The candidate whose running share is the first that reaches ``u``, by bisection of the array.

    The offset grows by falling powers of two as long as the share before it stays below ``u``; the
    last candidate takes what rounding may leave above its share.
    """
    n = F.size(candidates)
    total = F.element_at(candidates, -1)["run"]
    powers = F.transform(
        F.sequence(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(0), F.lit(-1)),
        lambda k: F.pow(F.lit(2.0), k).cast("int"),
    )

    def step(offset: Column, width: Column) -> Column:
        to = offset + width
        return F.when((to < n) & (F.get(candidates, to - 1)["run"] / total < u), to).otherwise(offset)

    return F.get(candidates, F.aggregate(powers, F.lit(0), step))["poi_id"]


def rewire_trips(
    flagged: DataFrame, shares: DataFrame, homes: DataFrame, pois: DataFrame, p: ScenarioParams = ScenarioParams()
) -> DataFrame:
    """One final venue per trip: kept when within reach, drawn by share when candidates exist,
    else the original.

    ``shares``: rows of :func:`running_shares`. The draw is a number fixed by seed and stop id; a
    trip meets the one row of its home spot and category and searches its array, so no row per trip
    and venue exists and the result is the same for any partitioning.
    """
    away = flagged.where(~F.col("within_isochrone")).select(
        "stop_id", "device_aid", "category", uniform_draw(p.seed, F.col("stop_id")).alias("_u")
    )
    drawn = (
        away.join(homes.select("device_aid", *SPOT), "device_aid")
        .join(shares, [*SPOT, "category"])
        .select("stop_id", _drawn(F.col("candidates"), F.col("_u")).alias("drawn_id"))
    )
    at = pois.select(F.col("poi_id").alias("final_poi_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    home = homes.select("device_aid", "home_latitude", "home_longitude")
    out = flagged.join(drawn, "stop_id", "left").withColumns(
        {
            "original_poi_id": F.col("poi_id"),
            "final_poi_id": F.coalesce("drawn_id", "poi_id"),
            "rewired": F.col("drawn_id").isNotNull(),
            "localizable": F.col("within_isochrone") | F.col("drawn_id").isNotNull(),
        }
    )
    out = out.join(at, "final_poi_id", "left").join(home, "device_aid", "left")
    d = geo.haversine_m("home_latitude", "home_longitude", "_lat", "_lon")
    return out.withColumn("distance_to_final", d).drop(
        "drawn_id", "poi_id", "_lat", "_lon", "home_latitude", "home_longitude"
    )


def rewire_rates(rewired: DataFrame) -> DataFrame:
    """Shares of kept, rewired and non-localizable trips per city."""

    def share(c):
        return F.avg(c.cast("double"))

    return rewired.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_trips"),
        share(F.col("within_isochrone")).alias("kept"),
        share(F.col("rewired")).alias("rewired"),
        share(~F.col("localizable")).alias("non_localizable"),
    )


# ---------------------------------------------------------------- segregation
def scenario_visits(rewired: DataFrame, devices: DataFrame) -> DataFrame:
    """Visits per (scenario, venue, device) with weight, group and zone; devices without weight
    drop out. Baseline and rewired venue come from one pass over the trips."""
    both = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("original_poi_id").alias("venue_id")),
        F.struct(F.lit("rewired").alias("scenario"), F.col("final_poi_id").alias("venue_id")),
    )
    visits = (
        rewired.select("device_aid", F.inline(both))
        .groupBy("scenario", "venue_id", "device_aid")
        .agg(F.count(F.lit(1)).alias("n_visits"))
    )
    known = devices.where(F.col("population_weight").isNotNull())
    return visits.join(known.select("device_aid", "zone_id", "population_weight", "group_variable"), "device_aid")


def venue_visitors(visits: DataFrame, count: str = "visitors") -> DataFrame:
    """Weighted advantaged, disadvantaged and all visitors per venue; ``count='visits'`` counts
    every visit instead of every visitor once."""
    w = F.col("population_weight") * (F.col("n_visits") if count == "visits" else F.lit(1))

    def of(group: str):
        return F.sum(F.when(F.col("group_variable") == group, w).otherwise(0.0))

    return visits.groupBy("scenario", "venue_id").agg(
        of("advantaged").alias("advantaged"), of("disadvantaged").alias("disadvantaged"), F.sum(w).alias("total")
    )


def venue_ice(visitors: DataFrame) -> DataFrame:
    """Index of concentration at the extremes per venue, from -1 to 1."""
    return visitors.withColumn("ice", F.try_divide(F.col("advantaged") - F.col("disadvantaged"), F.col("total")))


def neighborhood_ice(visits: DataFrame, ice: DataFrame) -> DataFrame:
    """Visit-weighted mean of venue ICE per home zone and scenario."""
    per = visits.groupBy("scenario", "zone_id", "venue_id").agg(
        F.sum(F.col("population_weight") * F.col("n_visits")).alias("n")
    )
    joined = per.join(ice.select("scenario", "venue_id", "ice"), ["scenario", "venue_id"]).where(F.col("ice").isNotNull())
    return joined.groupBy("scenario", "zone_id").agg(
        F.try_divide(F.sum(F.col("ice") * F.col("n")), F.sum("n")).alias("ice")
    )


def ice_delta(neighborhoods: DataFrame) -> DataFrame:
    """Baseline and rewired ICE per zone side by side, and the change."""

    def of(name: str):
        return F.max(F.when(F.col("scenario") == name, F.col("ice")))

    out = neighborhoods.groupBy("zone_id").agg(of("baseline").alias("ice_baseline"), of("rewired").alias("ice_rewired"))
    return out.withColumn("delta_ice", F.col("ice_rewired") - F.col("ice_baseline"))


# ---------------------------------------------------------------- localizability
def localizability_trip(trips: DataFrame) -> DataFrame:
    """Localizable share of trips per city and zone. ``trips`` carries city and zone_id."""
    return trips.groupBy("city", "zone_id").agg(
        F.count(F.lit(1)).alias("n_trips"), F.avg(F.col("localizable").cast("double")).alias("localizability_trip")
    )


def zone_categories(trips: DataFrame) -> DataFrame:
    """One row per (city, zone, observed category): can any of its trips be made locally?"""
    return trips.groupBy("city", "zone_id", "category").agg(F.max("localizable").alias("local"))


def localizability_category(categories: DataFrame) -> DataFrame:
    """Share of observed categories with a local venue, and the missing ones in order."""
    return categories.groupBy("city", "zone_id").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.avg(F.col("local").cast("double")).alias("localizability_category"),
        F.sort_array(F.collect_set(F.when(~F.col("local"), F.col("category")))).alias("missing_categories"),
    )


def city_localizability(zones: DataFrame) -> DataFrame:
    """Mean and quantiles of the zone values per city."""
    v = "localizability_trip"
    return zones.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_zones"),
        F.avg(v).alias("mean"),
        *[F.percentile(v, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)],
    )


def category_missingness(categories: DataFrame) -> DataFrame:
    """Per category: share of the zones observing it that lack a local venue."""
    return categories.groupBy("city", "category").agg(
        F.count(F.lit(1)).alias("n_zones"), F.avg((~F.col("local")).cast("double")).alias("missing_share")
    )


def localizability_correlation(zones: DataFrame, attributes: DataFrame, variable: str) -> DataFrame:
    """Pearson correlation of zone localizability with a composition variable, per city."""
    return zones.join(attributes, "zone_id").groupBy("city").agg(
        pearson("localizability_trip", variable).alias("correlation")
    )


def pearson(x: str, y: str) -> Column:
    """Correlation that is null, not an error, where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
