"""Reports with a row per pair: whole, and in an order that files in columns store in little space."""

import pytest
from pyspark.sql import functions as F

from sojourn.operators import scenario

VENUES, DEVICES = 5001, 60


@pytest.fixture(autouse=True)
def large(spark):
    """Joins as of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


FOOD = "concat('food', if(id < 0, 'x', '')) AS category"


def reach_of(spark):
    near = spark.range(VENUES).selectExpr("id - id + 1 AS grid_id", "id AS poi_id", FOOD)
    return near.union(near.limit(5)).union(spark.sql("SELECT 1L, NULL, 'food'")).union(spark.sql("SELECT 1L, 9L, NULL"))


def bytes_a_row(rows, path):
    rows.coalesce(1).write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / (VENUES * DEVICES)


def test_candidates_of_many_trips(spark):
    flagged = spark.range(DEVICES + 3).selectExpr(
        "id AS stop_id", "concat('d', id) AS device_aid", "id - id + 1 AS grid_id", "if(id = 61, null, 'food') AS category",
        "id = 60 AS within_isochrone",
    ).where("stop_id != 62")
    found = scenario.rewire_candidates(flagged, reach_of(spark))
    assert found.columns == ["grid_id", "category", "stop_id", "device_aid", "candidate_id"]
    row = found.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stop_id", "candidate_id").alias("pairs"),
        F.count_if(F.col("candidate_id").isNull()).alias("unnamed"), F.max("stop_id").alias("last"),
    ).first()
    assert (row.n, row.pairs, row.unnamed, row["last"]) == ((VENUES + 1) * DEVICES, VENUES * DEVICES, DEVICES, 59)


def test_tiles_keep_every_item_in_order(spark):
    rows = spark.range(2).selectExpr("id AS key", "transform(sequence(1, 600), i -> i * 10) AS items")
    tiles = scenario._tiles(rows, ["key"], "items", lambda c: c + 1).collect()
    for key in (0, 1):
        own = [r._tile for r in tiles if r.key == key]
        assert [len(t) for t in own] == [256, 256, 88]
        assert sum(own, []) == [10 * i + 1 for i in range(1, 601)]


def test_weights_of_many_devices(spark, tmp_path):
    homes = spark.range(DEVICES).selectExpr(
        "concat('d', id) AS device_aid", "id - id + 1 AS grid_id", "55.0D + (id - id) AS home_latitude",
        "13.0D + (id - id) AS home_longitude",
    )
    wanted = spark.range(DEVICES).selectExpr("concat('d', id) AS device_aid", FOOD)
    pois = spark.range(VENUES).selectExpr("id AS poi_id", "55 + id / 1e6 AS latitude", "13 + id / 2e6 AS longitude")
    found = scenario.decay_weights(wanted, reach_of(spark), homes, pois, digits=(6, 4, 6))
    assert found.columns == ["device_aid", "category", "poi_id", "km", "weight", "share"]
    row = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("device_aid", "poi_id").alias("pairs")).first()
    assert row.n == row.pairs == VENUES * DEVICES
    shares = found.groupBy("device_aid").agg(F.sum("share").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(shares[0] - 1) < 0.002 and abs(shares[1] - 1) < 0.002
    assert bytes_a_row(found, tmp_path / "out") < 2
