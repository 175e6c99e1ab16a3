"""Buildings, statistical zones and population weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions import geo
from sojourn.operators.clean import in_boxes
from sojourn.operators.spatial import polygon_cells, within_polygons
from sojourn.params import ScenarioParams


def residential_buildings(
    buildings: DataFrame, boxes: Sequence[Sequence[float]], classes: Sequence[str] = ("residential",)
) -> DataFrame:
    """Residential footprints whose centre lies in one of the region's boxes, each once although
    boxes may overlap."""
    inside = in_boxes(boxes, "building_latitude", "building_longitude")
    return buildings.where(F.col("class").isin(list(classes)) & inside).dropDuplicates(["building_id"])


def link_home_buildings(homes: DataFrame, buildings: DataFrame, metres: float = 50.0) -> DataFrame:
    """Nearest footprint within ``metres`` of each home (0 when inside; ties: lower id).

    Homes without one keep their raw coordinate with ``has_building`` false. Distances are planar
    in projected metres; candidates come from an equi-join on cells of twice the radius.
    """
    size = 2 * metres
    x, y = geo.project_xy("home_latitude", "home_longitude")
    spots = homes.select("home_latitude", "home_longitude").na.drop().distinct().withColumns({"_x": x, "_y": y})
    spots = spots.withColumns(
        {"_cx": F.floor(F.col("_x") / size).cast("bigint"), "_cy": F.floor(F.col("_y") / size).cast("bigint")}
    )
    shapes = buildings.select("building_id", geo.project_ring("ring").alias("_ring")).distinct()
    shapes = shapes.withColumn("_shape", F.xxhash64("_ring"))
    # Cells carry ids alone; the ring joins the candidate pairs afterwards.
    cells = polygon_cells(shapes, "_ring", size, metres).select("building_id", "_shape", "_cx", "_cy")
    rings = shapes.select("building_id", "_shape", geo.ring_edges("_ring").alias("_edges"))
    d = F.when(geo.inside_edges("_edges", "_x", "_y"), F.lit(0.0)).otherwise(geo.edge_distance("_edges", "_x", "_y"))
    best = (
        spots.join(cells, ["_cx", "_cy"])
        .join(rings, ["building_id", "_shape"])
        .select("home_latitude", "home_longitude", "building_id", d.alias("distance_m"))
        .where(F.col("distance_m") <= metres)
        .groupBy("home_latitude", "home_longitude")
        .agg(F.min(F.struct("distance_m", "building_id")).alias("_b"))
        .select("home_latitude", "home_longitude", "_b.building_id", "_b.distance_m")
    )
    centres = buildings.select("building_id", "building_latitude", "building_longitude")
    linked = homes.join(best, ["home_latitude", "home_longitude"], "left").join(centres, "building_id", "left")
    return linked.withColumn("has_building", F.col("building_id").isNotNull())


def pivot_zone_attributes(
    rows: DataFrame, values: Sequence[str] = ("sweden", "europe", "other"), name: str = "background",
    amount: str = "persons", prefix: str = "birth_",
) -> DataFrame:
    """Long (zone, value, amount) -> one row per zone; known values make it a single pass."""
    wide = rows.groupBy("zone_id").pivot(name, list(values)).agg(F.sum(amount))
    return wide.select("zone_id", *[F.coalesce(F.col(v), F.lit(0)).alias(prefix + v) for v in values])


def zone_profile(zones: DataFrame, births: DataFrame, income: DataFrame, cars: DataFrame) -> DataFrame:
    """Zones with births, income and cars; shares are null where the base is zero."""
    joined = zones.join(births, "zone_id", "left").join(income, "zone_id", "left").join(cars, "zone_id", "left")
    foreign = F.col("birth_europe") + F.col("birth_other")
    return joined.withColumns(
        {
            "pct_foreign_born": 100 * F.try_divide(foreign, foreign + F.col("birth_sweden")),
            "cars_per_capita": F.try_divide(F.col("cars"), F.col("population")),
        }
    )


def income_quartiles(income: DataFrame) -> DataFrame:
    """Q1 to Q4 per zone from the cut points of the income distribution.

    The cut points are one row over the zones, read back as a scalar subquery.
    """
    cuts = income.select(F.percentile("income", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).scalar()
    x = income.withColumn("_cuts", cuts)
    above = F.size(F.filter("_cuts", lambda c: F.col("income") > c))
    return x.withColumn("income_quartile", F.concat(F.lit("Q"), (above + 1).cast("string"))).drop("_cuts")


def register_groups(
    zones: DataFrame, variable: str, advantaged: Sequence[str], disadvantaged: Sequence[str]
) -> DataFrame:
    """Tier 1: group from the values of a register variable; others get null."""
    v = F.col(variable)
    group = F.when(v.isin(list(advantaged)), "advantaged").when(v.isin(list(disadvantaged)), "disadvantaged")
    return zones.select("zone_id", group.alias("group_variable"), F.lit(1).alias("tier"))


def gridded_groups(grid: DataFrame, value: str = "deprivation", threshold: float = 50.0) -> DataFrame:
    """Tier 3: a gridded deprivation value split in two at a threshold."""
    group = F.when(F.col(value) >= threshold, "disadvantaged").otherwise("advantaged")
    return grid.select("grid_id", group.alias("group_variable"), F.lit(3).alias("tier"))


def home_zone(homes: DataFrame, zones: DataFrame, size_deg: float = 0.02) -> DataFrame:
    """(device_aid, zone_id) of homes inside a zone."""
    points = homes.select(
        "device_aid", F.col("home_latitude").alias("latitude"), F.col("home_longitude").alias("longitude")
    ).na.drop()
    return within_polygons(points, zones, "zone_id", "ring", size_deg).select("device_aid", "zone_id")


def raw_ipw(device_zones: DataFrame, zones: DataFrame) -> DataFrame:
    """Population share over device share for each zone with devices."""
    counts = device_zones.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_devices"))
    total_n = counts.agg(F.sum("n_devices")).scalar()
    total_pop = zones.agg(F.sum("population")).scalar()
    return counts.join(zones.select("zone_id", "population"), "zone_id").select(
        "zone_id",
        "n_devices",
        "population",
        ((F.col("population") / total_pop) / (F.col("n_devices") / total_n)).alias("raw_weight"),
    )


def trimmed_ipw(weights: DataFrame, p: ScenarioParams = ScenarioParams()) -> DataFrame:
    """Van de Kerckhove trimming over zones with devices, then the absolute cap."""
    w = F.col("raw_weight")
    cv = F.coalesce(F.stddev_samp(w), F.lit(0.0)) / F.avg(w)
    limit = weights.select((F.sqrt(cv * cv + 1) * p.trimming_factor * F.median(w)).alias("w0")).scalar()
    return weights.withColumn("trim_limit", limit).withColumn(
        "population_weight", F.least(w, F.col("trim_limit"), F.lit(float(p.max_weight)))
    )


def weighted_devices(
    devices: DataFrame, device_zones: DataFrame, weights: DataFrame, attributes: DataFrame
) -> DataFrame:
    """All devices with zone, weight and zone attributes; excluded ones have nulls."""
    known = device_zones.join(weights.select("zone_id", "population_weight"), "zone_id").join(
        attributes, "zone_id", "left"
    )
    return devices.join(known, "device_aid", "left")
