"""Many devices of one building: copies are folded, chance meetings are no candidates."""

import random

from pyspark.sql import functions as F

from sojourn.operators import venues


def traces(n, seed, events=12):
    rng, rows = random.Random(seed), []
    for k in range(n):
        hours = rng.sample(range(480), events)
        rows += [(f"d{k:03d}", h * 3600 + 60 * (k % 7), h * 3600 + 60 * (k % 7) + 1500) for h in hours]
    return rows


def tables(spark, stays, building=1):
    df = spark.createDataFrame(stays, "device_aid string, start bigint, end bigint")
    at = df.select("device_aid", F.lit(building).cast("bigint").alias("building_id")).distinct()
    return df, at


def test_copies_are_folded_before_pairs(spark):
    stays = traces(6, 1)
    copies = [(f"e{i}-{d}", a, b) for i in range(5) for d, a, b in stays]
    late = [(f"z-{d}", a + 60, b + 60) for d, a, b in stays]
    df, at = tables(spark, stays + copies + late)
    folded = {r["device_aid"]: r["first"] for r in venues.device_copies(df, at).collect()}
    assert folded == {f"e{i}-{d}": d for i in range(5) for d, _, _ in stays}
    got = {r["device_aid"]: r["merged_into"] for r in venues.consolidate_duplicates(df, at).collect()}
    assert len(got) == 42 and all(into == name.split("-")[-1] for name, into in got.items())


def test_devices_of_no_building_are_no_copies(spark):
    df, _ = tables(spark, [("a", 0, 900), ("b", 0, 900)])
    at = spark.createDataFrame([("a", None), ("b", None), ("c", 1)], "device_aid string, building_id bigint")
    got = {r["device_aid"]: r["merged_into"] for r in venues.consolidate_duplicates(df, at).collect()}
    assert got == {"a": "a", "b": "b", "c": "c"}


def test_a_repeated_building_row_counts_twice_as_before(spark):
    df, at = tables(spark, [("a", 0, 1800), ("b", 0, 800), ("b", 7200, 8200)])
    once = venues.duplicate_pairs(df, at).collect()
    twice = venues.duplicate_pairs(df, at.union(at)).collect()
    assert not once and [(r["src"], r["dst"], r["overlap"], r["least"]) for r in twice] == [("a", "b", 3200, 3600)]


def test_bitmap_counts_missing_hours(spark):
    df, at = tables(spark, [("a", 0, 1000), ("a", 3600, 4600), ("a", 7200, 7500), ("b", 0, 1000)])
    rows = df.join(at, "device_aid")
    hours = rows.select("building_id", "device_aid", F.floor(F.col("start") / 3600).alias("hour"), (F.col("end") - F.col("start")).alias("seconds"))
    got = {r["device_aid"]: r for r in venues._hour_maps(rows, hours, 0.8).collect()}
    assert got["a"]["may_lack"] == 1 and got["b"]["may_lack"] == 0
    assert got["a"]["map"]["w0"] == 7 and got["a"]["total"] == 2300 and not got["a"]["heaped"]
