"""Walking reach on a street network, and what lies within it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions import geo
from sojourn.operators import spatial
from sojourn.operators.places import stop_hulls
from sojourn.params import ReachParams
from sojourn.session import cut


def home_grid_centroids(homes: DataFrame, size_m: int = 250) -> DataFrame:
    """Distinct home grid cells with their projected centres."""
    parts = F.split("home_grid_id", "_")
    cells = homes.where(F.col("home_grid_id").isNotNull()).select("home_grid_id").distinct()

    def centre(i: int):
        return (parts[i].cast("bigint") + 0.5) * size_m

    return cells.select(F.col("home_grid_id").alias("grid_id"), centre(0).alias("x"), centre(1).alias("y"))


def snap_to_nodes(points: DataFrame, nodes: DataFrame, point_id: str, metres: float = 200.0) -> DataFrame:
    """Nearest street node within ``metres`` of each point; ``unsnapped`` gives the points without one."""
    return spatial.nearest(points, nodes, metres, point_id, "node")


def unsnapped(points: DataFrame, snapped: DataFrame, point_id: str) -> DataFrame:
    """The points that no street node is near enough to, so that their loss can be reported."""
    return points.join(snapped.select(point_id).distinct(), point_id, "left_anti")


def walk_times(edges: DataFrame, origins: DataFrame, p: ReachParams = ReachParams()) -> DataFrame:
    """(grid_id, node, metres, minutes): all nodes within the walking limit of each origin.

    ``edges``: src, dst, length_m (directed). ``origins``: grid_id, node. Every round extends only
    the pairs that got shorter in the last one by one edge and keeps the least length per pair;
    rounds end when nothing got shorter. Each frontier is checkpointed, so neither the plan nor
    the cost of a lost executor grows with the number of rounds.
    """
    limit = p.limit_m
    key = ["grid_id", "node"]
    frontier = cut(origins.select(*key, F.lit(0).cast("bigint").alias("metres")).distinct())
    known = [frontier]
    while True:
        best = _least(reduce(DataFrame.union, known), key)
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(
            "grid_id", F.col("dst").alias("node"), (F.col("metres") + F.col("length_m")).alias("metres")
        )
        step = _least(step.where(F.col("metres") <= limit), key)
        old = best.withColumnRenamed("metres", "_old")
        frontier = cut(
            step.join(old, key, "left")
            .where(F.col("_old").isNull() | (F.col("metres") < F.col("_old")))
            .select(*key, "metres")
        )
        if frontier.isEmpty():
            break
        known.append(frontier)
        if len(known) == 8:
            known = [cut(_least(reduce(DataFrame.union, known), key))]
    per_minute = p.speed_kmh * 1000 / 60
    return best.withColumn("minutes", F.col("metres") / per_minute)


def _least(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("metres").alias("metres"))


def isochrone_polygon(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grid_id, ring): closed hull of the nodes reached from each grid cell."""
    at = reach.join(nodes.select("node", "latitude", "longitude"), "node")
    hulls = stop_hulls(at.select("grid_id", "latitude", "longitude"), ["grid_id"])
    return hulls.select("grid_id", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))


def isochrone_area(polygons: DataFrame, key: str = "grid_id") -> DataFrame:
    """Area in square kilometres and the radius of the circle of that area."""
    edges = geo.ring_edges(geo.project_ring("ring"))
    area = geo.ring_area_m2(edges) / 1e6
    out = polygons.select(key, area.alias("area_km2"))
    return out.withColumn("radius_km", F.sqrt(F.col("area_km2") / F.pi()))


def reachable_pois(reach: DataFrame, poi_nodes: DataFrame) -> DataFrame:
    """(grid_id, poi_id, category, metres) of venues whose street node is reached.

    ``poi_nodes``: poi_id, category, node.
    """
    return reach.join(poi_nodes, "node").select("grid_id", "poi_id", "category", "metres")


def pois_in_isochrones(pois: DataFrame, isochrones: DataFrame, size_deg: float = 0.005) -> DataFrame:
    """(grid_id, poi_id, category) of venues inside each isochrone polygon."""
    points = pois.select("poi_id", "category", "latitude", "longitude")
    return spatial.within_polygons(points, isochrones, "grid_id", "ring", size_deg).select(
        "grid_id", "poi_id", "category"
    )
