import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import clean, trace
from sojourn.operators.ordered import number_runs, with_next
from sojourn.params import StayParams
from sojourn.plans import stays as st
from tests.reference_model import events, fill

SCHEMA = "device_aid string, timestamp bigint, latitude double, longitude double"
P = StayParams()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, n=400, devices=3, hot=0.6):
    rng = random.Random(seed)
    rows = []
    for d in range(devices):
        t, lat, lon = 1_700_000_000 + d, 55.5, 13.0
        for _ in range(int(n * (hot if d == 0 else (1 - hot) / (devices - 1)))):
            t += rng.choice([0, 1, 300, 600, 900, 5000, 10799, 10800, 10801, 21599, 21600, 21601, 40000, 200000])
            if rng.random() < 0.3:
                lat, lon = 55.5 + rng.randrange(4) * 3e-4, 13.0 + rng.randrange(4) * 3e-4
            rows.append((f"d{d}", t, lat + rng.randrange(4) * 1e-4, lon + rng.randrange(4) * 1e-4))
    return rows


def per_device(rows):
    out = {}
    for d, t, a, b in rows:
        out.setdefault(d, []).append((t, a, b))
    return out


@pytest.mark.parametrize("gap,expected", [(10799, 2), (10800, 3), (21599, 3), (21600, 3)])
def test_gap_copies_begin_at_the_limit(spark, gap, expected):
    rows = [("d", 1000, 55.0, 13.0), ("d", 1000 + gap, 55.0, 13.0)]
    got = sorted(r.timestamp for r in trace.fill_gaps(frame(spark, rows)).collect())
    assert len(got) == expected
    if expected == 3:
        assert got[1] == 1000 + 10799


def test_same_second_keeps_the_last_place_and_one_ping_gets_no_copy(spark):
    rows = [("d", 5, 55.0, 13.0), ("d", 5, 55.1, 13.0), ("e", 7, 1.0, 1.0)]
    got = {(r.device_aid, r.timestamp, r.latitude) for r in trace.fill_gaps(frame(spark, rows)).collect()}
    assert got == {("d", 5, 55.1), ("e", 7, 1.0)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filling_and_events_match_the_plain_model_over_many_weeks(spark, seed):
    rows = random_rows(seed)
    df = frame(spark, rows)
    filled = {(r.device_aid, r.timestamp, r.latitude, r.longitude) for r in trace.fill_gaps(df).collect()}
    want_filled, want_events = set(), set()
    for d, trace_rows in per_device(rows).items():
        f = fill(trace_rows, P.max_time_between)
        want_filled |= {(d, *x) for x in f}
        found, _ = events(f, P.r1, P.min_size, P.min_staying_time, P.max_time_between)
        want_events |= {(d, f[a][0], f[b][0], b - a + 1, round(y, 9), round(x, 9)) for a, b, y, x in found}
    assert filled == want_filled
    one = clean.one_per_second(df)
    for got in (trace.stationary_events(one, P, fill=True), trace.stationary_events(trace.fill_gaps(df), P)):
        rows_ = {
            (r.device_aid, r.event_start, r.event_end, r.n_pings, round(r.latitude, 9), round(r.longitude, 9))
            for r in got.collect()
        }
        assert rows_ == want_events


def test_untimed_events_ignore_gaps(spark):
    rows = random_rows(9)
    got = trace.stationary_events(clean.one_per_second(frame(spark, rows)), P, timed=False).collect()
    want = set()
    for d, trace_rows in per_device(rows).items():
        f = [(t, *p) for t, p in sorted({t: (a, b) for t, a, b in sorted(trace_rows)}.items())]
        found, _ = events(f, P.r1, P.min_size, 0, 10**12, timed=False)
        want |= {(d, f[a][0], b - a + 1) for a, b, _, _ in found}
    assert {(r.device_aid, r.event_start, r.n_pings) for r in got} == want


@pytest.mark.parametrize("seed", [4, 5])
def test_run_path_and_ping_path_give_the_same_stays(spark, seed):
    df = frame(spark, random_rows(seed))
    short = st.detect_stays(df).select("device_aid", "start", "end", "size", F.round("latitude", 9), F.round("longitude", 9))
    long = trace.aggregate_stays(st.labelled_pings(df)).select(
        "device_aid", "start", "end", "size", F.round("latitude", 9), F.round("longitude", 9)
    )
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))


def test_result_does_not_depend_on_partitioning(spark):
    df = frame(spark, random_rows(6))
    a = sorted(map(tuple, st.detect_stays(df.repartition(1)).collect()))
    b = sorted(map(tuple, st.detect_stays(df.repartition(13).orderBy(F.rand(3))).collect()))
    assert a == b


def test_first_singleton_option_drops_label_zero(spark):
    rows = [("d", 0, 55.0, 13.0), ("d", 1000, 55.0, 13.0), ("d", 5000, 56.0, 13.0), ("d", 6000, 56.0, 13.0)]
    assert st.detect_stays(frame(spark, rows)).count() == 2
    assert st.detect_stays(frame(spark, rows), drop_first_singleton=True).count() == 1


def test_longitude_180_is_dropped_and_reported(spark):
    rows = [("d", 0, 55.0, 180.0), ("d", 1, 55.0, 13.0), ("d", 2000, 55.0, 13.0)]
    assert st.detect_stays(frame(spark, rows)).count() == 1
    seq = frame(spark, rows).withColumn("seq", F.col("timestamp"))
    row = clean.trace_checks(seq).first()
    assert row.n_outside == 1 and not row.ok


def test_runs_cross_chunk_edges(spark):
    rows = [("d", t, 1.0, float(t // 50 % 2)) for t in range(0, 400, 3)]
    df = frame(spark, rows)
    ends = lambda a, b: a["longitude"] != b["longitude"]
    for chunk in (7, 10, 64, 10_000):
        x = with_next(df, ["device_aid"], ["timestamp", "longitude"], ends_run=ends, chunk=chunk)
        runs = x.groupBy("device_aid", "run_start").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
        got = sorted((r.a, r.b) for r in runs.collect())
        want, cur = [], [rows[0]]
        for r in rows[1:]:
            if r[3] != cur[-1][3]:
                want.append((cur[0][1], cur[-1][1]))
                cur = []
            cur.append(r)
        want.append((cur[0][1], cur[-1][1]))
        assert got == want
        numbered = number_runs(runs, ["device_aid"], "a", "n").orderBy("a").collect()
        assert [r.n for r in numbered] == list(range(1, len(want) + 1))
        assert x.where("next is null").count() == 1


def test_legacy_tail_drops_the_last_run_unless_moving(spark):
    rows = spark.createDataFrame(
        [("a", 0, 1), ("a", 5, 2), ("b", 0, 1), ("b", 5, -1)], "device_aid string, timestamp bigint, loc int"
    )
    assert trace.label_intervals(rows).count() == 4
    kept = {(r.device_aid, r.label) for r in trace.label_intervals(rows, legacy_tail=True).collect()}
    assert kept == {("a", 1), ("b", 1), ("b", -1)}


def test_local_time_by_zone_knows_summer(spark):
    rows = spark.createDataFrame([(1720000000, 1720000600), (1704067200, 1704067200)], "start bigint, end bigint")
    got = trace.local_time(rows, tz="Europe/Stockholm").collect()
    assert [r.localtime - r.start for r in got] == [7200, 3600]
    assert [r.localtime - r.start for r in trace.local_time(rows).collect()] == [3600, 3600]


@pytest.mark.parametrize("bad", [{"r1": 0}, {"min_size": 1}, {"min_staying_time": 20000}, {"resolution": 2}, {"distance_metric": "x"}])
def test_bad_parameters_are_refused(bad):
    with pytest.raises(ValueError):
        StayParams(**bad)
