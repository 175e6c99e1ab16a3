import random

import pytest
from pyspark.sql import functions as F

from sojourn.functions.hashing import uniform_draw
from sojourn.operators import anchors, reach, scenario, venues, zones
from sojourn.params import AnchorParams, ScenarioParams


def city(spark, seed=1, n_trips=300):
    rng = random.Random(seed)
    cats = ["food", "shop", "bank"]
    pois = [(i, cats[i % 3] if i < 40 else "rare", 55.5 + rng.random() * 0.02, 13.0 + rng.random() * 0.02) for i in range(43)]
    homes = [(f"d{k}", k % 4, 55.5 + rng.random() * 0.02, 13.0 + rng.random() * 0.02) for k in range(12)]
    near = [(g, p[0], p[1]) for g in range(4) for p in pois if p[1] != "rare" and rng.random() < 0.3]
    trips = []
    for s in range(n_trips):
        p = rng.choice(pois)
        device = "d0" if rng.random() < 0.4 else f"d{rng.randrange(12)}"  # one device holds a large share
        trips.append((s, device, p[0], p[1], "c"))
    return (
        spark.createDataFrame(trips, "stop_id bigint, device_aid string, poi_id bigint, category string, city string"),
        spark.createDataFrame(homes, "device_aid string, grid_id bigint, home_latitude double, home_longitude double"),
        spark.createDataFrame(near, "grid_id bigint, poi_id bigint, category string"),
        spark.createDataFrame(pois, "poi_id bigint, category string, latitude double, longitude double"),
    )


def run(trips, homes, near, pois, p=ScenarioParams()):
    flagged = scenario.within_isochrone(trips, homes, near)
    away = flagged.where("not within_isochrone")
    runs = scenario.running_shares(away, near, homes, pois, p)
    shares = scenario.decay_weights(away, near, homes, pois, p)
    return flagged, shares, scenario.rewire_trips(flagged, runs, homes, pois, p)


@pytest.mark.parametrize("decay", ["power", "exponential"])
def test_every_trip_has_one_allowed_final_venue(spark, decay):
    trips, homes, near, pois = city(spark)
    flagged, shares, out = run(trips, homes, near, pois, ScenarioParams(decay=decay))
    rows = {r.stop_id: r for r in out.collect()}
    assert len(rows) == out.count() == trips.count()
    grid = {r.device_aid: r.grid_id for r in homes.collect()}
    reachable = {(r.grid_id, r.category): set() for r in near.collect()}
    for r in near.collect():
        reachable[(r.grid_id, r.category)].add(r.poi_id)
    for r in rows.values():
        local = reachable.get((grid[r.device_aid], r.category), set())
        if r.original_poi_id in local:
            assert r.within_isochrone and not r.rewired and r.final_poi_id == r.original_poi_id and r.localizable
        elif local:
            assert r.rewired and r.localizable and r.final_poi_id in local
        else:
            assert not r.rewired and not r.localizable and r.final_poi_id == r.original_poi_id
    total = shares.groupBy("device_aid", "category").agg(F.sum("share").alias("s")).collect()
    assert all(abs(t.s - 1) < 1e-9 for t in total)


def test_draws_equal_the_running_sums_taken_one_by_one(spark):
    trips, homes, near, pois = city(spark, 5, 1500)
    _, shares, out = run(trips, homes, near, pois)
    by = {}
    for r in sorted(shares.collect(), key=lambda r: r.poi_id):
        by.setdefault((r.device_aid, r.category), []).append((r.poi_id, r.share))
    assert max(map(len, by.values())) > 4
    draws = {r.stop_id: r.u for r in trips.select("stop_id", uniform_draw(ScenarioParams().seed, F.col("stop_id")).alias("u")).collect()}
    wrong = 0
    for r in out.where("rewired").collect():
        total, want = 0.0, None
        for venue, share in by[(r.device_aid, r.category)]:
            total, want = total + share, venue
            if total >= draws[r.stop_id]:
                break
        wrong += want != r.final_poi_id
    assert wrong == 0


def test_trips_meet_no_venue_rows_and_homes_without_place_stay(spark):
    trips, homes, near, pois = city(spark, 6)
    lost = homes.withColumn("home_latitude", F.when(F.col("device_aid") != "d1", F.col("home_latitude")))
    flagged, _, out = run(trips, lost, near, pois)
    assert out.where("device_aid = 'd1' and rewired").count() == 0 and out.count() == trips.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_u#" in plan and not [line for line in plan.splitlines() if "Join" in line and "_u#" in line]


def test_draws_do_not_depend_on_partitioning_and_follow_the_shares(spark):
    trips, homes, near, pois = city(spark, 2, 4000)
    a = sorted(map(str, run(trips.repartition(1), homes, near, pois)[2].select("stop_id", "final_poi_id").collect()))
    flagged, shares, out = run(trips.repartition(11), homes, near, pois)
    b = sorted(map(str, out.select("stop_id", "final_poi_id").collect()))
    assert a == b
    share = {(r.device_aid, r.category, r.poi_id): r.share for r in shares.collect()}
    drawn = out.where("rewired and device_aid = 'd0'").groupBy("category", "final_poi_id").count().collect()
    totals = {}
    for r in drawn:
        totals[r.category] = totals.get(r.category, 0) + r["count"]
    for r in drawn:
        n, s = totals[r.category], share[("d0", r.category, r.final_poi_id)]
        assert abs(r["count"] / n - s) < 5 * (s * (1 - s) / n) ** 0.5 + 0.02


def test_ice_stays_in_range_and_visits_may_be_counted(spark):
    trips, homes, near, pois = city(spark, 3)
    out = run(trips, homes, near, pois)[2]
    devices = homes.select(
        "device_aid", F.col("grid_id").alias("zone_id"), F.lit(1.5).alias("population_weight"),
        F.when(F.col("grid_id") > 1, "advantaged").otherwise("disadvantaged").alias("group_variable"),
    )
    visits = scenario.scenario_visits(out, devices)
    ice = scenario.venue_ice(scenario.venue_visitors(visits))
    assert ice.where("ice < -1 or ice > 1 or ice is null").count() == 0
    counted = scenario.venue_visitors(visits, "visits").groupBy("scenario").agg(F.sum("total").alias("t")).collect()
    assert all(abs(r.t - 1.5 * trips.count()) < 1e-6 for r in counted)
    delta = scenario.ice_delta(scenario.neighborhood_ice(visits, ice))
    assert delta.count() == 4


def test_missing_categories_are_named(spark):
    trips, homes, near, pois = city(spark, 4)
    out = run(trips, homes, near, pois)[2].join(homes.select("device_aid", F.col("grid_id").alias("zone_id")), "device_aid")
    rows = scenario.localizability_category(scenario.zone_categories(out)).collect()
    assert all("rare" in r.missing_categories and 0 <= r.localizability_category < 1 for r in rows)


def brute_pairs(stays, building, share):
    by = {}
    for d, a, b in stays:
        by.setdefault(d, []).append((a, b))
    out = set()
    for x in by:
        for y in by:
            if x < y and building[x] == building[y]:
                least = min(sum(b - a for a, b in by[x]), sum(b - a for a, b in by[y]))
                over = sum(max(0, min(b, d) - max(a, c)) for a, b in by[x] for c, d in by[y])
                if least > 0 and over >= share * least:
                    out.add((x, y))
    return out


@pytest.mark.parametrize("share", [0.8, 0.5, 1.0])
def test_duplicate_pairs_equal_brute_force_in_a_crowded_building(spark, share):
    rng = random.Random(11)
    stays, building = [], {}
    for k in range(40):
        name = f"d{k:02d}"
        building[name] = 1 if k < 30 else k % 3
        if k % 5 == 1:  # nearly the trace of the device before
            base = [s for s in stays if s[0] == f"d{k - 1:02d}"]
            stays += [(name, a + rng.choice([0, 60, 900]), b + rng.choice([0, 60])) for _, a, b in base if rng.random() < 0.95]
            continue
        t = rng.randrange(0, 20000)
        for _ in range(rng.randrange(1, 12)):
            length = rng.choice([900, 3600, 7200, 40000])
            stays.append((name, t, t + length))
            t += length + rng.choice([0, 600, 10000])
    df = spark.createDataFrame(stays, "device_aid string, start bigint, end bigint")
    at = spark.createDataFrame(list(building.items()), "device_aid string, building_id bigint")
    got = {(r.src, r.dst) for r in venues.duplicate_pairs(df, at, share).collect()}
    assert got == brute_pairs(stays, building, share)


def test_walks_take_the_shortest_way_and_stop_at_the_limit(spark):
    edges = [(1, 2, 500), (2, 3, 500), (1, 3, 900), (3, 4, 350), (4, 5, 1), (1, 6, 1251)]
    both = spark.createDataFrame(edges + [(b, a, m) for a, b, m in edges], "src bigint, dst bigint, length_m bigint")
    origins = spark.createDataFrame([("g", 1)], "grid_id string, node bigint")
    got = {r.node: r.metres for r in reach.walk_times(both, origins).collect()}
    assert got == {1: 0, 2: 500, 3: 900, 4: 1250}


def test_home_needs_enough_nights(spark):
    day = 19700
    rows = [("d", 1, (day + k) * 86400 + 23 * 3600, (day + k) * 86400 + 23 * 3600 + 1800) for k in range(2)]
    rows += [("d", 2, (day + k) * 86400 + 3 * 3600, (day + k) * 86400 + 3 * 3600 + 600) for k in range(10)]
    df = spark.createDataFrame(rows, "device_aid string, loc bigint, localtime bigint, l_localtime bigint")
    days = anchors.stay_days(df)
    nights = anchors.home_candidates_daily(days)
    homes = anchors.home_by_window(nights, anchors.observed_days(days))
    assert {r.loc for r in homes.collect()} == {2}
    assert anchors.home_by_window(nights, anchors.observed_days(days), AnchorParams(min_days_home=15)).count() == 0


def test_weights_survive_one_zone(spark):
    z = spark.createDataFrame([(1, 100), (2, 0)], "zone_id bigint, population bigint")
    d = spark.createDataFrame([("a", 1), ("b", 1)], "device_aid string, zone_id bigint")
    row = zones.trimmed_ipw(zones.raw_ipw(d, z)).first()
    assert row.raw_weight == 1.0 and row.population_weight == 1.0


def test_osm_priority(spark):
    df = spark.createDataFrame([(1, {"shop": "bakery", "amenity": "cinema"}), (2, {"x": "y"})], "poi_id bigint, tags map<string,string>")
    got = {r.poi_id: r.category for r in venues.map_osm_category(df).collect()}
    assert got == {1: "entertainment_recreation", 2: None}
