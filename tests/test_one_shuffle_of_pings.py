"""The pings of a device and week are gathered once: seconds fold where events are then found."""

import random
import re

from pyspark.sql import functions as F

from sojourn.operators import clean, trace
from sojourn.params import StayParams
from sojourn.plans import stays

SCHEMA = "device_aid string, timestamp long, latitude double, longitude double"


def pings(spark):
    rng, rows = random.Random(11), []
    for d in ("a", "b", "c"):
        t = 0
        for _ in range(700):
            t += rng.choice([0, 300, 300, 300, 600, 11000])
            place = (t // 40000) % 4
            rows.append((d, t, 55.6 + place * 0.01 + rng.randrange(3) * 1e-5, 13.0 + place * 0.01))
    rows += rows[:50] + [(None, 5, 55.0, 13.0), ("a", None, 55.0, 13.0), ("a", 7, None, 13.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_pings_are_shuffled_once_before_their_events(spark):
    plan = stays.detect_stays(pings(spark))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert sum("_week" in k for k in keys) == 1
    assert not [k for k in keys if "timestamp" in k]


def test_seconds_fold_alike_before_and_after_the_shuffle(spark):
    rows, p = stays.prepared(pings(spark)), StayParams()
    folded = clean.one_per_second(trace.by_week(rows), "_week")
    assert folded.columns == ["device_aid", "_week", "timestamp", "latitude", "longitude"]
    plain = clean.one_per_second(rows).where(F.col("device_aid").isNotNull())
    assert sorted(folded.drop("_week").collect()) == sorted(plain.collect())
    found = sorted(trace.event_runs(folded, p, fill=True).collect())
    assert len(found) > 50 and found == sorted(trace.event_runs(plain, p, fill=True).collect())
