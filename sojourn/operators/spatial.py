"""Distance and containment joins as equi-joins on grid cells.

Cells follow latitude bands: every band has its own longitude step, so that a radius never spans
more than the neighbouring cells at any latitude, and cells wrap at the antimeridian. No pass
over the data is needed to choose them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import geo

_MARGIN = 1.001
_MAX_LAT = 89.9


def _lat_step(metres: float) -> float:
    return _MARGIN * metres / geo.METRES_PER_DEGREE


def _band(lat: Column, metres: float) -> Column:
    return F.floor(lat / F.lit(_lat_step(metres))).cast("bigint")


def _band_cells(band: Column, metres: float) -> Column:
    """Number of cells round the globe in a band (so that the step divides 360 evenly)."""
    h = _lat_step(metres)
    edge = F.least(F.greatest(F.abs(band * h), F.abs((band + 1) * h)), F.lit(_MAX_LAT))
    step = F.lit(h) / F.cos(F.radians(edge))
    return F.greatest(F.floor(F.lit(360.0) / step), F.lit(1)).cast("bigint")


def _cell(band: Column, column: Column) -> Column:
    return band * F.lit(1 << 32) + column


def cell_of(lat, lon, metres: float) -> Column:
    """The one cell that holds the point."""
    lat, lon = geo._col(lat), geo._col(lon)
    band = _band(lat, metres)
    cells = _band_cells(band, metres)
    return _cell(band, F.pmod(F.floor((lon + 180.0) * cells / 360.0).cast("bigint"), cells))


def cells_around(lat, lon, metres: float) -> Column:
    """Array of all cells that may hold a point within ``metres``."""
    lat, lon = geo._col(lat), geo._col(lon)
    band = _band(lat, metres)
    own = F.lit(360.0) / _band_cells(band, metres)

    def row(shift: int) -> Column:
        b = band + shift
        cells = _band_cells(b, metres)
        reach = F.greatest(own, F.lit(360.0) / cells)
        lo = F.floor((lon + 180.0 - reach) * cells / 360.0).cast("bigint")
        hi = F.floor((lon + 180.0 + reach) * cells / 360.0).cast("bigint")
        hi = F.least(hi, lo + cells - 1)
        return F.transform(F.sequence(lo, hi), lambda x: _cell(b, F.pmod(x, cells)))

    return F.concat(row(-1), row(0), row(1))


def near(
    left: DataFrame,
    right: DataFrame,
    metres: float,
    keys: Sequence[str] = (),
    left_at: tuple[str, str] = ("latitude", "longitude"),
    right_at: tuple[str, str] = ("latitude", "longitude"),
    out: str = "distance_m",
) -> DataFrame:
    """Pairs within ``metres`` (inclusive), matching on ``keys``. Column names must not clash
    except for the keys.

    The right side is copied into the cells around it, so all partners of a left row meet it in
    one place and a following per-left-row aggregate shrinks the pairs before they move.
    """
    a = left.withColumn("_cell", cell_of(left_at[0], left_at[1], metres))
    b = right.withColumn("_cell", F.explode(cells_around(right_at[0], right_at[1], metres)))
    d = geo.haversine_m(*left_at, *right_at)
    return a.join(b, [*keys, "_cell"]).drop("_cell").withColumn(out, d).where(F.col(out) <= metres)


def nearest(
    left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str, out: str = "distance_m"
) -> DataFrame:
    """For every left row with a partner: the nearest right row (ties: lower id) and its distance.

    Right rows on one spot are folded to the lowest id first, and left rows on one spot are looked
    up once, so crowds of copies cost nothing.
    """
    spots = right.groupBy("latitude", "longitude").agg(F.min(right_id).alias(right_id))
    spots = spots.select(
        right_id, F.col("latitude").alias("_rlat"), F.col("longitude").alias("_rlon")
    )
    asked = left.select("latitude", "longitude").distinct()
    pairs = near(asked, spots, metres, right_at=("_rlat", "_rlon"), out=out)
    best = (
        pairs.groupBy("latitude", "longitude")
        .agg(F.min(F.struct(out, right_id)).alias("_b"))
        .select("latitude", "longitude", f"_b.{out}", f"_b.{right_id}")
    )
    return left.select(left_id, "latitude", "longitude").join(best, ["latitude", "longitude"]).select(
        left_id, right_id, out
    )


# ---------------------------------------------------------------- polygons
def _deg_cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("bigint")


def polygon_cells(polygons: DataFrame, ring: str, size_deg: float, pad: Column | float = 0.0) -> DataFrame:
    """One row per polygon and square cell (side ``size_deg`` in the ring's unit) that its padded
    bounding box touches."""
    west, south, east, north = geo.ring_bounds(ring)
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    # Bounds first: a caller that drops the ring has cells without copies of it.
    boxed = polygons.withColumns(
        {
            "_x": F.struct(_deg_cell(west - pad, size_deg).alias("lo"), _deg_cell(east + pad, size_deg).alias("hi")),
            "_y": F.struct(_deg_cell(south - pad, size_deg).alias("lo"), _deg_cell(north + pad, size_deg).alias("hi")),
        }
    )
    return (
        boxed.withColumn("_cx", F.explode(F.sequence("_x.lo", "_x.hi")))
        .withColumn("_cy", F.explode(F.sequence("_y.lo", "_y.hi")))
        .drop("_x", "_y")
    )


def within_polygons(
    points: DataFrame,
    polygons: DataFrame,
    polygon_id: str,
    ring: str = "ring",
    size_deg: float = 0.01,
) -> DataFrame:
    """All (point, polygon id) pairs with the point inside, by cell equi-join and ray casting.

    Points on one spot are tested once: coordinates are folded before the join and spread back.
    Cells carry ids alone; the ring joins the candidate pairs afterwards. Equal polygons of one id
    count once.
    """
    spots = points.select("latitude", "longitude").distinct()
    spots = spots.withColumn("_cx", _deg_cell(F.col("longitude"), size_deg)).withColumn(
        "_cy", _deg_cell(F.col("latitude"), size_deg)
    )
    shapes = polygons.select(polygon_id, ring).distinct().withColumn("_shape", F.xxhash64(ring))
    cells = polygon_cells(shapes, ring, size_deg).select(polygon_id, "_shape", "_cx", "_cy")
    rings = shapes.select(polygon_id, "_shape", geo.ring_edges(ring).alias("_edges"))
    hits = (
        spots.join(cells, ["_cx", "_cy"])
        .join(rings, [polygon_id, "_shape"])
        .where(geo.inside_edges("_edges", "longitude", "latitude"))
        .select("latitude", "longitude", polygon_id)
    )
    return points.join(hits, ["latitude", "longitude"])
