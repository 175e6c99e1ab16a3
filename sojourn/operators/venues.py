"""Venue categories, venue matching, and quality filters on devices and stops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions import categories, geo
from sojourn.operators import graph, spatial
from sojourn.params import VenueParams
from sojourn.session import cut


#: Words of 64 bits in the bitmap of a device's hours: three weeks before two hours share a bit.
MAP_WORDS = 8


# ---------------------------------------------------------------- categories
def _lookup(pairs: Sequence[tuple[str, str]], key: Column) -> Column:
    """Value of a short fixed list as a literal map: no join at all."""
    entries = [F.lit(x) for pair in pairs for x in pair]
    return F.element_at(F.create_map(*entries), key)


def map_poi_category(pois: DataFrame) -> DataFrame:
    """Unified category from the venue type; null when the type has none."""
    pairs = [(t, c) for c, types in categories.INCLUDES.items() for t in types]
    return pois.withColumn("category", _lookup(pairs, F.col("sub_category")))


def map_osm_category(pois: DataFrame, tag_table: Sequence[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """Unified category from a tag map: the matching tag with the lowest priority number wins,
    ties by category name."""
    table = categories.OSM_TAGS if tag_table is None else tag_table
    values = F.create_map(*[
        x for k, v, c, p in table
        for x in (F.lit(f"{k}={v}"), F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")))
    ])
    hits = F.filter(
        F.transform(F.map_entries("tags"), lambda e: F.element_at(values, F.concat(e["key"], F.lit("="), e["value"]))),
        lambda s: s.isNotNull(),
    )
    return pois.withColumn("category", F.when(F.size(hits) > 0, F.array_min(hits)["c"]))


def exclude_poi(pois: DataFrame) -> DataFrame:
    """Venues that have a category and whose type is not excluded by name; a null type is not."""
    excluded = F.coalesce(F.col("sub_category").isin(categories.EXCLUDES), F.lit(False))
    return pois.where(F.col("category").isNotNull() & ~excluded)


# ---------------------------------------------------------------- matching
def non_home_stops(stops: DataFrame, homes: DataFrame, metres: float = 100.0) -> DataFrame:
    """Stops of known devices more than ``metres`` from that device's home."""
    at = homes.select("device_aid", "home_latitude", "home_longitude")
    d = geo.haversine_m("latitude", "longitude", "home_latitude", "home_longitude")
    return stops.join(at, "device_aid").where(d > metres).drop("home_latitude", "home_longitude")


def poi_containment(stops: DataFrame, pois: DataFrame, size_deg: float = 0.001) -> DataFrame:
    """(stop_id, poi_id) with the stop inside the footprint; several footprints: lowest id.

    Venues of one footprint are folded to the lowest id before any stop meets them.
    """
    shapes = pois.groupBy("ring").agg(F.min("poi_id").alias("poi_id"))
    hits = spatial.within_polygons(
        stops.select("latitude", "longitude").distinct(), shapes, "poi_id", "ring", size_deg
    )
    best = hits.groupBy("latitude", "longitude").agg(F.min("poi_id").alias("poi_id"))
    return stops.select("stop_id", "latitude", "longitude").join(best, ["latitude", "longitude"]).select(
        "stop_id", "poi_id"
    )


def poi_within(stops: DataFrame, pois: DataFrame, metres: float = 100.0) -> DataFrame:
    """Nearest venue within ``metres`` of each stop."""
    return spatial.nearest(stops, pois, metres, "stop_id", "poi_id")


def assign_poi(stops: DataFrame, pois: DataFrame, p: VenueParams = VenueParams()) -> DataFrame:
    """First tier that matches wins: footprint, then the distance tiers; unmatched stops stay.

    Work is done per distinct stop coordinate: stays repeat a place many times.
    """
    spots = stops.select("latitude", "longitude").distinct().withColumn("stop_id", F.struct("latitude", "longitude"))
    spots = cut(spots)
    inside = poi_containment(spots, pois).select(
        "stop_id", F.lit(1).alias("match_tier"), F.lit(0.0).alias("distance_to_poi"), "poi_id"
    )
    widest = max(r for _, r in p.tier_radii_m)
    tier = F.lit(None).cast("int")
    for number, radius in sorted(p.tier_radii_m, reverse=True):
        tier = F.when(F.col("distance_m") <= radius, number).otherwise(tier)
    near = poi_within(spots, pois, widest).select(
        "stop_id", tier.alias("match_tier"), F.col("distance_m").alias("distance_to_poi"), "poi_id"
    )
    best = (
        inside.union(near)
        .groupBy("stop_id")
        .agg(F.min(F.struct("match_tier", "distance_to_poi", "poi_id")).alias("_b"))
        .select("stop_id", "_b.*")
    )
    venue = pois.select(
        "poi_id", F.col("category").alias("poi_category"),
        F.col("latitude").alias("poi_latitude"), F.col("longitude").alias("poi_longitude"),
    )
    matched = spots.join(best, "stop_id").drop("stop_id").join(venue, "poi_id")
    return stops.join(matched, ["latitude", "longitude"], "left")


def match_rate(visits: DataFrame) -> DataFrame:
    """Stops and their share per tier; tier 0 stands for unmatched, -1 for matched overall."""
    tiers = visits.groupBy(F.coalesce("match_tier", F.lit(0)).alias("match_tier")).agg(
        F.count(F.lit(1)).alias("n_stops")
    )
    overall = tiers.where(F.col("match_tier") > 0).agg(F.coalesce(F.sum("n_stops"), F.lit(0)).alias("n_stops"))
    total = tiers.agg(F.sum("n_stops")).scalar()
    rows = tiers.union(overall.select(F.lit(-1).alias("match_tier"), "n_stops"))
    return rows.withColumn("share", F.col("n_stops") / total)


# ---------------------------------------------------------------- filters
def valid_devices(stops: DataFrame, homes: DataFrame, p: VenueParams = VenueParams()) -> DataFrame:
    """Devices with enough stops and days and no stop farther from home than the limit."""
    at = homes.select("device_aid", "home_latitude", "home_longitude")
    d = geo.haversine_m("latitude", "longitude", "home_latitude", "home_longitude")
    # One row per device and local day first, so that distinct days need no distinct aggregate.
    daily = (
        stops.join(at, "device_aid", "left")
        .withColumn("day", F.floor(F.col("localtime") / 86400))
        .groupBy("device_aid", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("far"))
    )
    per = daily.groupBy("device_aid").agg(
        F.sum("n").alias("n_stops"), F.count(F.lit(1)).alias("n_days"), F.max("far").alias("far_m")
    )
    return per.where(
        (F.col("n_stops") >= p.min_stops_per_device)
        & (F.col("n_days") >= p.min_days_observed)
        & (F.coalesce("far_m", F.lit(0.0)) <= p.max_home_distance_km * 1000)
    ).select("device_aid")


def filter_devices(stops: DataFrame, homes: DataFrame, p: VenueParams = VenueParams()) -> DataFrame:
    """Stops of valid devices only."""
    return stops.join(valid_devices(stops, homes, p), "device_aid", "left_semi")


def filter_stops(stops: DataFrame, min_minutes: float = 15.0) -> DataFrame:
    """Stops of at least ``min_minutes``."""
    return stops.where((F.col("end") - F.col("start")) >= min_minutes * 60)


def duplicate_pairs(stays: DataFrame, buildings: DataFrame, share: float = 0.8) -> DataFrame:
    """Pairs (src < dst) of devices of one building whose stays overlap for at least ``share`` of
    the shorter total stay time. Stays of one device never overlap each other.

    Candidates come from a prefix filter instead of all pairs of a building: if B overlaps A for
    ``share`` of A's time, B must also be present in one of any set of A's hours that holds more
    than ``1 - share`` of it, and A's set is chosen from the hours with fewest devices. Every row
    carries a bitmap of its device's hours: two devices that meet are a candidate only if B lacks no
    more of A's hours than A's shortest hours within ``1 - share`` of its time. Devices whose own
    stays overlap each other skip that test, as an hour then counts more than once.
    """
    rows = stays.select("device_aid", "start", "end").join(buildings.select("device_aid", "building_id"), "device_aid")
    rows = rows.where(F.col("end") > F.col("start"))
    h = F.col("hour")
    inside = F.least(F.col("end"), (h + 1) * 3600) - F.greatest(F.col("start"), h * 3600)
    pieces = rows.select(
        "building_id", "device_aid", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / 3600), F.floor(F.col("end") / 3600))).alias("hour"),
    ).withColumn("seconds", inside)
    pieces = pieces.where(F.col("seconds") > 0)
    hours = cut(pieces.groupBy("building_id", "device_aid", "hour").agg(F.sum("seconds").alias("seconds")))
    crowd = hours.groupBy("building_id", "hour").agg(F.count(F.lit(1)).alias("crowd"))
    device = cut(_hour_maps(rows, hours, share))
    total = device.select("device_aid", "total")
    ranked = hours.join(crowd, ["building_id", "hour"]).where(F.col("crowd") > 1).join(total, "device_aid")
    # Hours alone in the building count as already passed: nobody can overlap there.
    lonely = hours.join(crowd, ["building_id", "hour"]).where(F.col("crowd") == 1)
    alone = lonely.groupBy("device_aid").agg(F.sum("seconds").alias("alone"))
    ranked = ranked.join(alone, "device_aid", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    before = Window.partitionBy("device_aid").orderBy("crowd", "hour").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("seconds").over(before), F.lit(0)) + F.col("alone")
    prefix = ranked.withColumn("passed", passed).where(
        F.col("passed") <= (1 - share) * F.col("total") + 1e-6
    )
    a = prefix.select("building_id", "hour", "device_aid").join(device, "device_aid").select(
        "building_id", "hour", F.col("device_aid").alias("a"), F.col("total").alias("ta"), "may_lack",
        F.col("heaped").alias("a_heaped"), F.col("map").alias("a_map"),
    )
    b = hours.select("building_id", "hour", "device_aid").join(device, "device_aid").select(
        "building_id", "hour", F.col("device_aid").alias("b"), F.col("total").alias("tb"),
        F.col("heaped").alias("b_heaped"), F.col("map").alias("b_map"),
    )
    shorter = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") != F.col("b")))
    words = [f"w{i}" for i in range(MAP_WORDS)]
    lacks = reduce(add, [F.bit_count(F.col("a_map")[w].bitwiseAND(F.bitwise_not(F.col("b_map")[w]))) for w in words])
    alike = F.col("a_heaped") | F.col("b_heaped") | (lacks <= F.col("may_lack"))
    candidates = a.join(b, ["building_id", "hour"]).where(shorter & alike).select(
        F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.least("ta", "tb").alias("least")
    ).distinct()
    left = pieces.select(F.col("device_aid").alias("src"), "hour", *_piece("s"))
    right = pieces.select(F.col("device_aid").alias("dst"), "hour", *_piece("d"))
    common = F.least("s_end", "d_end") - F.greatest("s_start", "d_start")
    return (
        cut(candidates)
        .join(left, "src")
        .join(right, ["dst", "hour"])
        .where(common > 0)
        .groupBy("src", "dst", "least")
        .agg(F.sum(common).alias("overlap"))
        .where(F.col("overlap") >= share * F.col("least"))
        .select("src", "dst", "overlap", "least")
    )


def _hour_maps(rows: DataFrame, hours: DataFrame, share: float) -> DataFrame:
    """Per device: total seconds, a bitmap of its hours, how many of its hours (the shortest first) may
    be missed within ``1 - share`` of the total, and whether its own stays overlap each other."""
    slot = F.pmod(F.col("hour"), F.lit(64 * MAP_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(hour, {64 * MAP_WORDS}) % 64 as int))")
    words = [
        F.bit_or(F.when(F.floor(slot / 64) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}")
        for i in range(MAP_WORDS)
    ]
    # A device's hours in order of their seconds: few rows, and the same partitioning as the sums.
    per = hours.groupBy("device_aid", "hour").agg(F.sum("seconds").alias("seconds"))
    upto = Window.partitionBy("device_aid").orderBy("seconds", "hour").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns(
        {"run": F.sum("seconds").over(upto), "all": F.sum("seconds").over(Window.partitionBy("device_aid"))}
    )
    lost = F.count_if(F.col("run") <= (1 - share) * F.col("all") + 1e-6)
    maps = per.groupBy("device_aid").agg(F.sum("seconds").alias("total"), lost.alias("may_lack"), *words)
    maps = maps.select("device_aid", "total", "may_lack", F.struct(*[f"w{i}" for i in range(MAP_WORDS)]).alias("map"))
    before = Window.partitionBy("device_aid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    heaped = rows.withColumn("heaped", F.coalesce(F.max("end").over(before) > F.col("start"), F.lit(False)))
    return maps.join(heaped.groupBy("device_aid").agg(F.max("heaped").alias("heaped")), "device_aid")


def _piece(prefix: str) -> list[Column]:
    """Start and end of a stay within its hour."""
    return [
        F.greatest(F.col("start"), F.col("hour") * 3600).alias(f"{prefix}_start"),
        F.least(F.col("end"), (F.col("hour") + 1) * 3600).alias(f"{prefix}_end"),
    ]


def device_copies(stays: DataFrame, buildings: DataFrame) -> DataFrame:
    """(device_aid, first) for devices with exactly the stays, in the same buildings, of a smaller id."""
    rows = stays.select("device_aid", "start", "end").join(buildings.select("device_aid", "building_id"), "device_aid")
    rows = rows.where(F.col("end") > F.col("start"))
    trace = F.sort_array(F.collect_list(F.struct("building_id", "start", "end")))
    one = rows.groupBy("device_aid").agg(trace.alias("trace"), F.count("building_id").alias("placed"))
    one = one.where(F.col("placed") > 0).select("device_aid", F.sha2(F.to_json("trace"), 256).alias("trace"))
    first = one.groupBy("trace").agg(F.min("device_aid").alias("first"))
    return one.join(first, "trace").where(F.col("device_aid") != F.col("first")).select("device_aid", "first")


def consolidate_duplicates(stays: DataFrame, buildings: DataFrame, share: float = 0.8) -> DataFrame:
    """(device_aid, merged_into): duplicate devices, transitively, go to the least id.

    Devices with equal stays are linked to the first of them and only that one is compared with
    others, so that copies are never expanded into pairs.
    """
    copies = device_copies(stays, buildings)
    copies = cut(copies if share <= 1 else copies.limit(0))
    devices = buildings.select(F.col("device_aid").alias("node")).distinct()
    alone = devices.join(copies, F.col("node") == F.col("device_aid"), "left_anti")
    rest = [rows.join(copies, "device_aid", "left_anti") for rows in (stays, buildings)]
    pairs = cut(duplicate_pairs(*rest, share).select("src", "dst"))
    merged = cut(graph.connected_components(alone, pairs))
    merged = merged.select(F.col("node").alias("device_aid"), F.col("component").alias("merged_into"))
    first = merged.select(F.col("device_aid").alias("first"), "merged_into")
    return merged.union(copies.join(first, "first").select("device_aid", "merged_into"))
