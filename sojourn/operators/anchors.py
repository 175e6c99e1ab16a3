"""Home and work anchors from stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions import geo
from sojourn.params import AnchorParams


def stay_days(stays: DataFrame) -> DataFrame:
    """Seconds per device, location, local day (number since 1970) and hour of the day."""
    h = F.col("_h")
    hours = F.sequence(F.floor(F.col("localtime") / 3600), F.floor(F.col("l_localtime") / 3600))
    seconds = F.least(F.col("l_localtime"), (h + 1) * 3600) - F.greatest(F.col("localtime"), h * 3600)
    return (
        stays.select("device_aid", "loc", "localtime", "l_localtime", F.explode(hours).alias("_h"))
        .select("device_aid", "loc", F.floor(h / 24).alias("day"), (h % 24).alias("hour"), seconds.alias("_s"))
        .where(F.col("_s") > 0)
        .groupBy("device_aid", "loc", "day", "hour")
        .agg(F.sum("_s").alias("seconds"))
    )


def observed_days(days: DataFrame) -> DataFrame:
    return days.select("device_aid", "day").distinct()


def _top(rows: DataFrame, by: list[str], measure: str) -> DataFrame:
    """The location with the largest measure per key; ties go to the lower location."""
    best = F.max(F.struct(F.col(measure), (-F.col("loc")).alias("_l"))).alias("_b")
    return rows.groupBy(*by).agg(best).select(*by, (-F.col("_b._l")).alias("loc"), F.col(f"_b.{measure}").alias(measure))


def home_candidates_daily(days: DataFrame, p: AnchorParams = AnchorParams()) -> DataFrame:
    """Location with most night time per device and night; a night belongs to the local day on
    which it starts."""
    hour = F.col("hour")
    night = days.where((hour >= p.night_start) | (hour < p.night_end))
    night = night.withColumn("night", F.when(hour >= p.night_start, F.col("day")).otherwise(F.col("day") - 1))
    per = night.groupBy("device_aid", "night", "loc").agg(F.sum("seconds").alias("seconds"))
    return _top(per, ["device_aid", "night"], "seconds")


def _windowed(rows: DataFrame, day: str, observed: DataFrame, span: int, value: Column) -> DataFrame:
    """Total of each location over the trailing window of every observed day.

    A row adds its value on its day and takes it back ``span`` days later: two rows per day row, none
    per day of the window. Their running sum is the total from one change to the next. The observed
    days meet it as one list per device, so that all keys begin with the device and rows that are
    partitioned by it stay where they are.
    """
    comes = F.struct(F.col(day).alias("_from"), value.alias("_v"))
    goes = F.struct((F.col(day) + span).alias("_from"), (-value).alias("_v"))
    changes = rows.select("device_aid", "loc", F.inline(F.array(comes, goes)))
    changes = changes.groupBy("device_aid", "loc", "_from").agg(F.sum("_v").alias("_v")).where("_v != 0")
    w = Window.partitionBy("device_aid", "loc").orderBy("_from")
    steps = changes.select(
        "device_aid", "loc", "_from",
        F.lead("_from").over(w).alias("_until"),
        F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("amount"),
    ).where("amount > 0")
    seen = observed.groupBy("device_aid").agg(F.collect_set("day").alias("_days"))
    inside = F.filter("_days", lambda d: (d >= F.col("_from")) & (d < F.col("_until")))
    return steps.join(seen, "device_aid").select("device_aid", "loc", "amount", F.explode(inside).alias("day"))


def home_by_window(candidates: DataFrame, observed: DataFrame, p: AnchorParams = AnchorParams()) -> DataFrame:
    """Home at every observed day: the location that won most nights of the trailing window."""
    totals = _windowed(candidates, "night", observed, p.range_window_home, F.lit(1))
    enough = totals.where(F.col("amount") >= p.min_days_home)
    return _top(enough, ["device_aid", "day"], "amount").withColumnRenamed("amount", "n_days")


def work_by_window(
    days: DataFrame, homes: DataFrame, observed: DataFrame, p: AnchorParams = AnchorParams()
) -> DataFrame:
    """Work at every observed day: most weekday business time in the window, other than home."""
    weekday = F.pmod(F.col("day") + 3, F.lit(7)) < 5
    business = days.where(weekday & (F.col("hour") >= p.work_start) & (F.col("hour") < p.work_end))
    daily = business.groupBy("device_aid", "day", "loc").agg(F.sum("seconds").alias("_d"))
    totals = _windowed(daily.withColumnRenamed("day", "_day"), "_day", observed, p.range_window_work, F.col("_d"))
    away = totals.join(homes.select("device_aid", "day", "loc"), ["device_aid", "day", "loc"], "left_anti")
    return _top(away, ["device_aid", "day"], "amount").withColumnRenamed("amount", "seconds")


def home_work_locations(
    homes: DataFrame, works: DataFrame, stays: DataFrame, p: AnchorParams = AnchorParams()
) -> DataFrame:
    """One row per device: the location most often home and most often work, and where they are."""

    def modal(rows: DataFrame, kind: str) -> DataFrame:
        counts = rows.groupBy("device_aid", "loc").agg(F.count(F.lit(1)).alias("n"))
        best = _top(counts, ["device_aid"], "n")
        at = best.join(places, ["device_aid", "loc"])
        return at.select(
            "device_aid",
            F.col("latitude").alias(f"{kind}_latitude"),
            F.col("longitude").alias(f"{kind}_longitude"),
            F.col("n").alias(f"n_{kind}_days"),
        )

    places = stays.groupBy("device_aid", "loc").agg(
        F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude")
    )
    both = modal(homes, "home").join(modal(works, "work"), "device_aid", "full_outer")
    x, y = geo.project_xy("home_latitude", "home_longitude")
    grid = F.when(F.col("home_latitude").isNotNull(), geo.grid_cell_id(x, y, p.grid_m))
    return both.select(
        "device_aid", "home_latitude", "home_longitude", grid.alias("home_grid_id"),
        "work_latitude", "work_longitude",
        F.coalesce("n_home_days", F.lit(0)).alias("n_home_days"),
        F.coalesce("n_work_days", F.lit(0)).alias("n_work_days"),
    )


def detect_home_work(stays: DataFrame, p: AnchorParams = AnchorParams()) -> DataFrame:
    """Stays -> one home/work row per device.

    Stays are partitioned by device once; every window and total below starts with the device. Only
    the removal of homes from work and the final join by location shuffle again, on daily rows.
    """
    days = stay_days(stays.select("device_aid", "loc", "localtime", "l_localtime").repartition("device_aid"))
    seen = observed_days(days)
    homes = home_by_window(home_candidates_daily(days, p), seen, p)
    return home_work_locations(homes, work_by_window(days, homes, seen, p), stays, p)
