"""Events are found where a week of a device was sorted; venues of one footprint are tested once."""

import numpy as np
import pyarrow as pa
import pytest

from sojourn.operators import spatial, trace, venues
from sojourn.params import StayParams

WEEK = 7 * 86400
SCHEMA = "device_aid string, timestamp long, latitude double, longitude double"


def _trace(seed, repeats):
    """Stops, trips and gaps over five weeks, one device that stays for weeks and one that skips some."""
    rng = np.random.default_rng(seed)
    rows = []
    for d, steps in (("a", [60, 300, 899, 900, 3599, 10800, 10801, 40000]), ("b", [300, 3000]), ("c", [5000, 2 * WEEK])):
        t, place = int(rng.integers(-WEEK, WEEK)), 0
        for _ in range(400 if d != "c" else 30):
            t += int(rng.choice(steps))
            place = place if d == "b" or rng.random() < 0.8 else int(rng.integers(0, 4))
            lat, lon = 55.0 + place * 4e-4 + int(rng.integers(0, 3)) * 1e-4, 13.0
            rows += [(d, t, lat, lon)] * (1 + (repeats and int(rng.integers(0, 2))))
    return rows


def _found(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in trace.RUNS_OUT.split(", ")]).collect())


@pytest.mark.parametrize("timed, fill", [(True, True), (True, False), (False, False)])
def test_runs_equal_those_of_one_pass_over_the_trace(spark, timed, fill):
    p = StayParams()
    df = spark.createDataFrame(_trace(1, repeats=not fill) + [("d", 5, 1.0, 2.0), (None, 5, 1.0, 2.0)], SCHEMA).repartition(5)
    whole = trace._segmented(df, p, timed, fill).mapInArrow(trace._event_kernel(p, timed, True), trace.RUNS_OUT)
    got = trace.event_runs(df, p, timed, fill)
    assert len(_found(got)) > 40 and _found(got) == _found(whole)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan  # each was a pass over all rows


@pytest.mark.parametrize("waiting, size", [(3, 7), (100_000, 7), (3, 1), (50, 10_000)])
def test_long_segments_move_on_without_waiting(monkeypatch, waiting, size):
    monkeypatch.setattr(trace, "WAITING_ROWS", waiting)
    p = StayParams()

    def runs(rest, rows):
        table = pa.table(dict(zip(("device_aid", "timestamp", "latitude", "longitude"), zip(*sorted(rows)), strict=True)))
        week = pa.array([t // rest for t in table.column("timestamp").to_pylist()])
        out = pa.Table.from_batches(
            list(trace._week_kernel(p, True, True)(iter(table.append_column("_week", week).to_batches(size))))
        ).sort_by([(c, "ascending") for c in ("device_aid", "start", "latitude", "longitude", "end")])
        done = pa.Table.from_batches(list(trace._edge_kernel(p, True, True)(iter(out.combine_chunks().to_batches(size)))))
        return sorted(tuple(r.values()) for r in done.select([c.split()[0] for c in trace.RUNS_OUT.split(", ")]).to_pylist())

    rows = _trace(2, repeats=False)
    got = runs(WEEK, rows)
    assert len(got) > 40 and got == runs(100 * WEEK, rows) == runs(3600, rows)


def test_venues_of_one_footprint_meet_a_stop_once(spark, monkeypatch):
    ring = [(0.0, 0.0), (1e-4, 0.0), (1e-4, 1e-4), (0.0, 1e-4), (0.0, 0.0)]
    wide = [(0.0, 0.0), (3e-4, 0.0), (3e-4, 3e-4), (0.0, 3e-4), (0.0, 0.0)]
    shapes = [(i, ring) for i in range(50, 90)] + [(7, wide), (None, ring), (3, None)]
    pois = spark.createDataFrame(shapes, "poi_id long, ring array<struct<lon: double, lat: double>>")
    rows = [("s", 5e-5, 5e-5), ("t", 2e-4, 2e-4), ("u", 9e-4, 9e-4)]
    stops = spark.createDataFrame(rows, "stop_id string, latitude double, longitude double")
    asked, within = [], spatial.within_polygons

    def counted(points, polygons, *args, **kwargs):
        asked.append(polygons.where("ring is not null").count())
        return within(points, polygons, *args, **kwargs)

    monkeypatch.setattr(spatial, "within_polygons", counted)
    assert sorted(tuple(r) for r in venues.poi_containment(stops, pois).collect()) == [("s", 7), ("t", 7)]
    only = pois.where("poi_id >= 50 or poi_id is null")
    assert [tuple(r) for r in venues.poi_containment(stops, only).collect()] == [("s", 50)]
    assert asked == [2, 1]
