"""Geographic Column expressions. All of them stay inside whole-stage code generation,
except the ring helpers, which use higher-order functions on edge arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.params import EARTH_RADIUS_M

METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0

# GRS80 ellipsoid and the national transverse-Mercator grid (EPSG:3006).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
TM_LON0 = 15.0
TM_K0 = 0.9996
TM_FALSE_EASTING = 500000.0


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres between two points in degrees."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.pow(F.sin(half_lon), F.lit(2.0)) * F.cos(
        F.radians(lat1)
    ) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def euclidean(x1, y1, x2, y2) -> Column:
    """Planar distance."""
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    return F.hypot(x1 - x2, y1 - y2)


def distance(metric: str, lat1, lon1, lat2, lon2) -> Column:
    """Distance by metric name: 'haversine' or 'euclidean'."""
    if metric == "haversine":
        return haversine_m(lat1, lon1, lat2, lon2)
    if metric == "euclidean":
        return euclidean(lat1, lon1, lat2, lon2)
    raise ValueError(f"unknown metric {metric!r}")


def snap(x, resolution: float) -> Column:
    """Round half to even onto a grid of the given resolution; 0 keeps the value."""
    x = _col(x)
    return F.bround(x / F.lit(resolution)) * F.lit(resolution) if resolution > 0 else x


def tm_coefficients() -> dict[str, object]:
    """Constants of the transverse-Mercator forward series, to third order in n."""
    f = GRS80_F
    n = f / (2 - f)
    e2 = f * (2 - f)
    return {
        "e": math.sqrt(e2),
        "a_hat": GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "beta": (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
            13 * n**2 / 48 - 3 * n**3 / 5,
            61 * n**3 / 240,
        ),
    }


def project_xy(lat, lon) -> tuple[Column, Column]:
    """Degrees -> (easting, northing) metres, transverse Mercator on GRS80."""
    lat, lon = _col(lat), _col(lon)
    c = tm_coefficients()
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(TM_LON0))
    s = F.sin(phi)
    e = F.lit(c["e"])
    # Tangent of the conformal latitude.
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, b in enumerate(c["beta"], start=1):
        x = x + F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    scale = TM_K0 * c["a_hat"]
    return F.lit(TM_FALSE_EASTING) + F.lit(scale) * x, F.lit(scale) * y


def grid_cell_id(x, y, size_m: int = 250) -> Column:
    """Text id of the square grid cell holding a projected point."""
    x, y = _col(x), _col(y)
    gx = F.floor(x / size_m).cast("bigint")
    gy = F.floor(y / size_m).cast("bigint")
    return F.concat_ws("_", gx.cast("string"), gy.cast("string"))


def ring_edges(ring) -> Column:
    """Closed ring (array of struct<lon,lat>) -> array of struct<x1,y1,x2,y2>."""
    ring = _col(ring)
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.element_at(ring, i)["lon"].alias("x1"),
            F.element_at(ring, i)["lat"].alias("y1"),
            F.element_at(ring, i + 1)["lon"].alias("x2"),
            F.element_at(ring, i + 1)["lat"].alias("y2"),
        ),
    )


def inside_edges(edges, x, y) -> Column:
    """Even-odd test of a point against an edge array from :func:`ring_edges`."""
    edges, x, y = map(_col, (edges, x, y))
    crossing = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y))
        & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossing) % 2 == 1


def edge_distance(edges, x, y) -> Column:
    """Smallest planar distance from a point to any edge of the array."""
    edges, x, y = map(_col, (edges, x, y))

    def one(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / len2).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - (e["x1"] + t * dx), y - (e["y1"] + t * dy))

    return F.array_min(F.transform(edges, one))


def ring_area_m2(edges) -> Column:
    """Shoelace area of a projected edge array."""
    edges = _col(edges)
    # Coordinates are taken relative to the first vertex so that large eastings do not cost digits.
    x0 = F.element_at(edges, 1)["x1"]
    y0 = F.element_at(edges, 1)["y1"]
    twice = F.aggregate(
        edges,
        F.lit(0.0),
        lambda acc, e: acc
        + (e["x1"] - x0) * (e["y2"] - y0)
        - (e["x2"] - x0) * (e["y1"] - y0),
    )
    return F.abs(twice) / 2


def ring_bounds(ring) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a ring."""
    ring = _col(ring)
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def project_ring(ring) -> Column:
    """Ring in degrees -> ring of projected metres in the same struct shape (lon=x, lat=y)."""
    ring = _col(ring)

    def one(p):
        x, y = project_xy(p["lat"], p["lon"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(ring, one)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
