"""The composed plan: pings -> stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.operators import clean, places, trace
from sojourn.params import UTC_OFFSET_SECONDS, StayParams
from sojourn.session import cut


def prepared(pings: DataFrame, p: StayParams = StayParams()) -> DataFrame:
    """Complete pings at usable coordinates. Exactly +-180 degrees is dropped as well (clustering
    needs open ranges); ``trace_checks`` reports such rows."""
    rows = pings.select("device_aid", "timestamp", "latitude", "longitude").na.drop()
    if p.distance_metric != "haversine":
        return rows
    return clean.valid_coordinates(rows).where(F.abs("longitude") < 180.0)


def labelled_pings(pings: DataFrame, p: StayParams = StayParams()) -> DataFrame:
    """Every ping (gap copies included) with event, label, stop location and interval number."""
    # Written once: the rows feed the labels, the intervals and their numbering.
    trace_rows = cut(trace.stationary_pings(clean.one_per_second(prepared(pings, p)), p, fill=True))
    events = trace_rows.where(F.col("event_start").isNotNull()).groupBy("device_aid", "event_start").agg(
        F.max("event_latitude").alias("latitude"), F.max("event_longitude").alias("longitude")
    )
    events = events.withColumn("start", F.col("event_start"))
    labels = places.label_runs(events, p)
    return trace.interval_segments(trace.label_pings(trace_rows, labels), p.max_time_between)


def detect_stays(
    pings: DataFrame,
    p: StayParams = StayParams(),
    utc_offset: int = UTC_OFFSET_SECONDS,
    drop_first_singleton: bool = False,
) -> DataFrame:
    """Raw pings -> stays (device_aid, loc, start, end, latitude, longitude, size, localtime,
    l_localtime, duration_min).

    Only event runs, never labelled pings, leave the first kernel: a run per stationary event is
    all that labels, intervals and stays need. ``drop_first_singleton`` loses the first stop of a
    device whose stops are all lone points, as label 0 once did.
    """
    weeks = trace.by_week(prepared(pings, p))
    runs = trace.event_runs(clean.one_per_second(weeks, "_week"), p, fill=True)
    labelled = places.label_runs(runs, p)
    if drop_first_singleton:
        labelled = _without_label_zero(labelled)
    return stay_columns(merge_runs(labelled, p.max_time_between), utc_offset)


def merge_runs(labelled: DataFrame, max_time_between: int) -> DataFrame:
    """Join touching runs of one place into stays."""
    # Events last at least min_staying_time, so the runs of one device are few per day.
    w = Window.partitionBy("device_aid").orderBy("start")
    touches = (
        (F.lag("loc").over(w) == F.col("loc"))
        & (F.lag("next_time").over(w) == F.col("start"))
        & (F.col("start") - F.lag("end").over(w) < max_time_between)
    )
    stay = F.sum(F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1)).over(w)
    return (
        labelled.withColumn("_stay", stay)
        .where(F.col("loc") != -1)
        .groupBy("device_aid", "_stay")
        .agg(
            F.max("loc").alias("loc"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max("stop_latitude").alias("latitude"),
            F.max("stop_longitude").alias("longitude"),
            F.sum("size").alias("size"),
        )
        .drop("_stay")
    )


def stay_columns(stays: DataFrame, utc_offset: int = UTC_OFFSET_SECONDS) -> DataFrame:
    return trace.stay_duration(trace.local_time(stays, utc_offset))


def _without_label_zero(labelled: DataFrame) -> DataFrame:
    points = F.count_distinct(F.struct("latitude", "longitude"))
    device = labelled.groupBy("device_aid").agg(
        (points == F.max("loc")).alias("_lone"),
    )
    return (
        labelled.join(device, "device_aid")
        .withColumn("loc", F.when(F.col("_lone") & (F.col("loc") == 1), -1).otherwise(F.col("loc")))
        .drop("_lone")
    )
