"""Expected-range checks over the outputs of the steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.scenario import pearson

# Step, metric, lower and upper bound of each rule (None leaves a side open).
RULES: list[tuple[int, str, float | None, float | None]] = [
    (1, "stops_per_device_median", 20.0, 50.0),
    (2, "home_detection_rate", 0.6, 0.8),
    (3, "building_match_rate", 0.9, None),
    (4, "zone_coverage", 1.0, 1.0),
    (5, "weight_median", 0.5, 1.5),
    (5, "weight_max", None, 10.0),
    (6, "poi_match_rate", 0.4, 0.5),
    (7, "isochrone_area_km2", 3.0, 7.0),
    (8, "rewiring_rate", 0.3, 0.6),
    (8, "non_localizable_rate", 0.1, 0.3),
    (9, "ice_change_disadvantaged", None, 0.0),
    (10, "localizability_composition_correlation", None, 0.0),
]


def observed(
    stays: DataFrame, anchors: DataFrame, links: DataFrame, zones: DataFrame, weights: DataFrame,
    visits: DataFrame, areas: DataFrame, rewired: DataFrame, ice: DataFrame, groups: DataFrame,
    localizability: DataFrame, composition: DataFrame,
) -> DataFrame:
    """(metric, observed): one small aggregate per rule. Every input is an output of its step."""

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    per_device = stays.groupBy("device_aid").agg(F.count(F.lit(1)).alias("n"))
    worse = ice.join(groups.where(F.col("group_variable") == "disadvantaged"), "zone_id")
    joined = localizability.join(composition, "zone_id")
    rows = [
        per_device.agg(F.median("n").alias("stops_per_device_median")),
        anchors.agg(share(F.col("home_latitude").isNotNull()).alias("home_detection_rate")),
        links.agg(share(F.col("has_building")).alias("building_match_rate")),
        zones.where(F.col("population") > 0).agg(share(F.size("ring") > 0).alias("zone_coverage")),
        weights.agg(F.median("population_weight").alias("weight_median"), F.max("population_weight").alias("weight_max")),
        visits.agg(share(F.col("match_tier").isNotNull()).alias("poi_match_rate")),
        areas.agg(F.median("area_km2").alias("isochrone_area_km2")),
        rewired.agg(
            share(F.col("rewired")).alias("rewiring_rate"), share(~F.col("localizable")).alias("non_localizable_rate")
        ),
        worse.agg(F.avg("delta_ice").alias("ice_change_disadvantaged")),
        joined.agg(pearson("localizability_trip", "composition").alias("localizability_composition_correlation")),
    ]

    def long(row: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("observed")) for c in row.columns]
        )
        return row.select(F.inline(pairs))

    return reduce(DataFrame.union, [long(r) for r in rows])


def validate_steps(values: DataFrame) -> DataFrame:
    """Each rule with its observed value, bounds and verdict."""
    schema = "step int, metric string, lower double, upper double"
    rules = values.sparkSession.createDataFrame(RULES, schema)
    low = F.coalesce(F.col("observed") >= F.col("lower"), F.col("observed").isNotNull())
    high = F.coalesce(F.col("observed") <= F.col("upper"), F.col("observed").isNotNull())
    return rules.join(values, "metric", "left").select("step", "metric", "observed", "lower", "upper", (low & high).alias("ok"))
