"""Work that is done once: hulls of many small keys, shared events, shares per home spot, run numbers."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sojourn.functions import kernels
from sojourn.operators import places, scenario, trace
from sojourn.plans import catalog_scenario

HULL = ["device_aid", "loc"]


def _rows(device, loc, lat, lon):
    n = len(lat)
    return pa.table({
        "device_aid": device, "loc": loc, "n": np.ones(n, dtype=np.int64), "sum_lat": lat, "sum_lon": lon,
        "latitude": lat, "longitude": lon,
    })


def test_a_key_per_point_costs_no_step_per_key():
    n = 60_000
    x = np.arange(n) / 1e5
    table = _rows(pa.array([f"d{i}" for i in range(n)]), pa.array(np.ones(n, dtype=np.int64)), x, x)
    start = time.perf_counter()
    for final in (False, True):
        out = list(places._hull_kernel(HULL, final)(iter(table.to_batches(10_000))))
        assert sum(b.num_rows for b in out) == n
    assert time.perf_counter() - start < 6  # a step per key took 20 s and more


def test_hulls_of_keys_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b)) for k in range(40) for a, b in rng.integers(0, 6, (1 + k % 9, 2)) / 1000]
    rows += [(None, 0.001 * i, 0.002 * i) for i in range(4)]  # a line, under a null key
    df = spark.createDataFrame(rows, "loc long, latitude double, longitude double")
    got = {r.loc: r for r in places.stop_hulls(df.repartition(5), ["loc"]).collect()}
    assert len(got) == 41
    for key, r in got.items():
        lat, lon = np.array(sorted({(a, b) for k, a, b in rows if k == key})).T
        corner = kernels.hull_indices(lon, lat)
        assert r.n_points == len(lat)
        ring = [(p.lon, p.lat) for p in r.ring]
        if len(corner) >= 3:
            assert ring == [(lon[i], lat[i]) for i in corner]
        else:
            a, z = corner[0], corner[-1]
            h = (5e-5 if len(lat) == 1 else np.hypot(lat[a] - lat[z], lon[a] - lon[z])) / 2
            square = [(lon.mean() + dx * h, lat.mean() + dy * h) for dy, dx in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            assert np.allclose(ring, square, rtol=0, atol=1e-12)


def test_shared_places_compute_their_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"d{i}", i, 55.0 + (i % 7) * 0.01, 13.0) for i in range(70)]
    schema = "device_aid string, event_start long, latitude double, longitude double"
    events = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    shared = places.shared_stop_locations(events, resolution=1e-5).collect()
    assert len(shared) == 70 and len({r["loc"] for r in shared}) == 7
    assert seen.value == 70


def test_decay_weights_round_once_per_home_spot(spark):
    wanted = spark.createDataFrame([("a", "food"), ("b", "food")], "device_aid string, category string")
    near = spark.createDataFrame([(1, 10, "food"), (1, 11, "food")], "grid_id long, poi_id long, category string")
    homes = spark.createDataFrame(
        [("a", 1, 55.0, 13.0), ("b", 1, 55.0, 13.0)],
        "device_aid string, grid_id long, home_latitude double, home_longitude double",
    )
    pois = spark.createDataFrame([(10, 55.001, 13.0), (11, 55.003, 13.001)], "poi_id long, latitude double, longitude double")
    plain = scenario.decay_weights(wanted, near, homes, pois)
    after = plain.select(
        "device_aid", "category", "poi_id", F.round("km", 6).alias("km"), F.round("weight", 4).alias("weight"),
        F.round("share", 6).alias("share"),
    )
    before = scenario.decay_weights(wanted, near, homes, pois, digits=(6, 4, 6))
    assert before.columns == plain.columns
    assert sorted(before.collect()) == sorted(after.collect()) and before.count() == 4


def test_intervals_are_numbered_without_a_second_pass_over_the_runs(spark):
    week = 7 * 86400
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 5 * week, 400))
    rows = [(d, int(t), int(v), 1.0, 2.0) for d in ("a", "b") for t, v in zip(times, rng.integers(0, 2, 400))]
    rows += [("c", 5, 1, 1.0, 2.0), ("c", 5, 1, 1.0, 2.0), ("c", 6, 2, 1.0, 2.0), ("c", 3 * week, 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "device_aid string, timestamp long, loc long, latitude double, longitude double")
    found = trace.interval_segments(df)
    expected = []
    for d in "abc":
        n, last = 0, None
        for r in sorted(r for r in rows if r[0] == d):
            if last is None or r[2] != last[2] or r[1] - last[1] >= 10800:
                n += 1
            last = r
            expected.append((*r[:3], n))
    assert sorted(tuple(r) for r in found.select("device_aid", "timestamp", "loc", "interval").collect()) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the rows meet the summary of their chunk, and nothing else


def test_rewiring_makes_its_trips_once(spark, monkeypatch, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    made = catalog_scenario.trips

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def counting(spark, sf_dir):
        rows = made(spark, sf_dir)
        return rows.mapInArrow(counted, rows.schema)

    stamp = "timestamp'2024-01-02 00:00:00' + make_dt_interval(0, cast(id % 24 as int), cast(id % 60 as int))"
    events = spark.range(300).selectExpr("id AS event_id", f"{stamp} AS ts", "id % 12 AS user_id")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(200).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(catalog_scenario, "trips", counting)
    rewired = catalog_scenario.rewired_table(spark, str(tmp_path)).collect()
    assert len(rewired) > 0 and seen.value == len(rewired)
