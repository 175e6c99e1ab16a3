"""Row-level cleaning of pings and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.ordered import with_next

PING_KEY = ["device_aid", "latitude", "longitude", "timestamp"]


def drop_null_pings(pings: DataFrame) -> DataFrame:
    """Rows with a device and both coordinates; the time may still be null."""
    return pings.na.drop(subset=["device_aid", "latitude", "longitude"])


def is_valid_coordinate() -> Column:
    return F.col("latitude").between(-80.0, 84.0) & F.col("longitude").between(-180.0, 180.0)


def valid_coordinates(pings: DataFrame) -> DataFrame:
    """Latitude within [-80, 84] and longitude within [-180, 180]."""
    return pings.where(is_valid_coordinate())


def dedupe_pings(pings: DataFrame) -> DataFrame:
    """Distinct (place, time) per device, then complete rows only."""
    return pings.dropDuplicates(PING_KEY).na.drop(subset=PING_KEY)


def one_per_second(pings: DataFrame, chunk: str | None = None) -> DataFrame:
    """The last place (by latitude, longitude) of each device and second.

    Duplicates and same-second rows fold in the map-side aggregate, so a hot device shrinks to at
    most 86,400 rows a day before any sort by time. ``chunk`` names a column that follows from the
    timestamp and is kept: rows that were dealt by device and chunk fold where they are.
    """
    keys = ["device_aid", *([chunk] if chunk else []), "timestamp"]
    return (
        pings.groupBy(*keys)
        .agg(F.max(F.struct("latitude", "longitude")).alias("_p"))
        .select(*keys, "_p.latitude", "_p.longitude")
    )


def in_boxes(boxes: Sequence[Sequence[float]], lat: str = "latitude", lon: str = "longitude") -> Column:
    """Inside any (west, south, east, north) box of a short list; a plain pushed-down filter."""
    hit = F.lit(False)
    for west, south, east, north in boxes:
        hit = hit | (F.col(lon).between(west, east) & F.col(lat).between(south, north))
    return hit


def city_filter(
    rows: DataFrame,
    bbox: Sequence[float] | None = None,
    municipality_codes: Sequence[str] | None = None,
    code_column: str = "municipality_code",
) -> DataFrame:
    """Rows inside the city box and, when codes are given, in one of its municipalities."""
    out = rows
    if bbox is not None:
        out = out.where(in_boxes([bbox]))
    if municipality_codes is not None:
        out = out.where(F.col(code_column).isin(list(municipality_codes)))
    return out


def trace_checks(pings: DataFrame, sequence: str = "seq", metric: str = "haversine") -> DataFrame:
    """Per device: rows, missing values, steps back in time along ``sequence``, and coordinates
    outside the open ranges; ``ok`` tells whether the trace may be clustered."""
    ordered = with_next(
        pings.select("device_aid", sequence, "timestamp", "latitude", "longitude"),
        ["device_aid"],
        [sequence, "timestamp"],
        chunk=1_000_000,
    )
    missing = (
        F.col("timestamp").isNull()
        | F.col("latitude").isNull()
        | F.col("longitude").isNull()
        | F.isnan("latitude")
        | F.isnan("longitude")
    )
    outside = F.lit(False)
    if metric == "haversine":
        outside = F.coalesce(
            (F.abs("latitude") >= 90.0) | (F.abs("longitude") >= 180.0), F.lit(False)
        ) & ~missing
    back = F.coalesce(F.col("next.timestamp") < F.col("timestamp"), F.lit(False))
    return (
        ordered.groupBy("device_aid")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(missing).alias("n_missing"),
            F.count_if(back).alias("n_unordered"),
            F.count_if(outside).alias("n_outside"),
        )
        .withColumn("ok", (F.col("n_missing") + F.col("n_unordered") + F.col("n_outside")) == 0)
    )
