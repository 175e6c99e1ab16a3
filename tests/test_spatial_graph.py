import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from sojourn.functions import geo
from sojourn.functions import kernels
from sojourn.operators import graph, places, spatial
from tests.reference_model import dist


def points(spark, rows, names="id bigint, latitude double, longitude double"):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("lat0,lon0,metres", [(0.0, 0.0, 50), (55.5, 13.0, 30), (-70.0, 179.9995, 120), (84.0, -179.999, 900)])
def test_near_finds_exactly_the_pairs_in_range(spark, lat0, lon0, metres):
    rng = random.Random(int(metres))
    span = metres * 3 / 111_000

    def make(n):
        out = []
        for i in range(n):
            lon = lon0 + rng.uniform(-span, span) * 4
            out.append((i, lat0 + rng.uniform(-span, span), (lon + 180) % 360 - 180))
        return out

    a, b = make(150), make(150)
    left = points(spark, a)
    right = points(spark, b, "rid bigint, rlat double, rlon double")
    got = {(r.id, r.rid) for r in spatial.near(left, right, metres, right_at=("rlat", "rlon")).collect()}
    want = {(i, j) for i, *p in a for j, *q in b if dist(p, q) <= metres}
    assert got == want and want


def test_nearest_breaks_ties_by_id_and_copies_cost_nothing(spark):
    left = points(spark, [(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 50.0, 50.0)])
    right = points(spark, [(9, 10.0001, 10.0), (4, 10.0001, 10.0), (7, 9.9, 10.0)], "rid bigint, latitude double, longitude double")
    got = {(r.id, r.rid) for r in spatial.nearest(left, right, 100, "id", "rid").collect()}
    assert got == {(1, 4), (2, 4)}


def test_within_polygons_on_a_concave_ring(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    shape = spark.createDataFrame(
        [(1, [(float(x), float(y)) for x, y in ring])], "pid bigint, ring array<struct<lon:double,lat:double>>"
    )
    rows = [(1, 0.5, 2.0), (2, 3.0, 2.0), (3, 2.0, 0.5), (4, 5.0, 5.0), (5, 2.0, 3.5)]
    got = {r.id for r in spatial.within_polygons(points(spark, rows), shape, "pid", size_deg=0.7).collect()}
    assert got == {1, 3, 5}


def test_polygons_that_share_an_id_are_told_apart_and_equal_ones_count_once(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    shift = [(x + 5, y) for x, y in ring]
    names = "pid bigint, ring array<struct<lon:double,lat:double>>"
    shapes = spark.createDataFrame([(1, ring), (1, ring), (1, shift)], names)
    rows = [(1, 0.5, 0.5), (2, 0.5, 5.5), (3, 0.5, 3.0)]
    got = sorted((r.id, r.pid) for r in spatial.within_polygons(points(spark, rows), shapes, "pid", size_deg=0.1).collect())
    assert got == [(1, 1), (2, 1)]


def test_unsnapped_points_are_reported(spark):
    from sojourn.operators import reach

    at = points(spark, [(1, 10.0, 10.0), (2, 20.0, 10.0)])
    nodes = points(spark, [(7, 10.0001, 10.0)], "node bigint, latitude double, longitude double")
    assert [r.id for r in reach.unsnapped(at, reach.snap_to_nodes(at, nodes, "id"), "id").collect()] == [2]


def test_ring_area_and_projection(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(geo.project_xy(F.lit(59.0), F.lit(18.0)), "xy")]).first()
    # Published control values for this grid at 59 N, 18 E lie near these metres.
    assert abs(row.x - 672_000) < 1_000 and abs(row.y - 6_543_000) < 2_000
    square = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in
                       [(0, 0), (3, 0), (3, 2), (0, 2), (0, 0)]])
    edges = geo.ring_edges(square)
    out = spark.range(1).select(geo.ring_area_m2(edges).alias("a"), geo.edge_distance(edges, F.lit(5.0), F.lit(1.0)).alias("d")).first()
    assert (out.a, out.d) == (6.0, 2.0)


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_connected_components_on_a_star_a_chain_and_random_edges(spark):
    rng = random.Random(2)
    nodes = list(range(300))
    edges = [(0, i) for i in range(1, 120)] + [(i, i + 1) for i in range(130, 190)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(45)]
    n = spark.createDataFrame([(i,) for i in nodes], "node bigint")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.node: r.component for r in graph.connected_components(n, e).collect()}
    assert got == brute_components(nodes, edges)


def clusters(rows):
    out = {}
    for r in rows:
        out.setdefault(r.loc, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_distributed_communities_equal_the_kernel_on_separate_cliques(spark):
    rng = random.Random(8)
    rows = []
    for c in range(6):
        for i in range(rng.randrange(1, 7)):
            rows.append((len(rows), 55.0 + c * 0.01 + rng.randrange(9) * 1e-5, 13.0 + rng.randrange(9) * 1e-5))
    df = points(spark, rows)
    small = clusters(places.cluster_points(df, 30.0).collect())
    large = clusters(places.cluster_points(df, 30.0, task_edges=0).collect())
    assert small == large and len(small) == 6


def test_distributed_communities_split_two_groups_with_a_weak_bridge(spark):
    edges = [(a, b, 5.0) for block in (range(5), range(5, 10)) for a in block for b in block if a < b] + [(4, 5, 1.0)]
    e = spark.createDataFrame([(0, *x) for x in edges], "component bigint, src bigint, dst bigint, weight double")
    got = {r.node: r.module for r in graph.map_equation_communities(e).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def both_forms(spark, graphs):
    """Modules of every graph (edges a < b, weight) in memory and by distributed rounds."""
    apart = [(g, a + 1000 * g, b + 1000 * g, float(w)) for g, edges in enumerate(graphs) for a, b, w in edges]
    memory = {}
    for g in range(len(graphs)):
        _, src, dst, w = zip(*[x for x in apart if x[0] == g], strict=True)
        nodes, module = kernels.merged_modules(np.array(src), np.array(dst), np.array(w))
        memory |= dict(zip(nodes.tolist(), module.tolist(), strict=True))
    e = spark.createDataFrame(apart, "component bigint, src bigint, dst bigint, weight double")
    rounds = {r.node: r.module for r in graph.map_equation_communities(e).collect()}
    return memory, rounds


def test_both_forms_of_communities_agree(spark):
    rng = random.Random(12)
    graphs = [[(i, i + 1, 1) for i in range(30)], [(i, i + d, 2) for i in range(20) for d in (1, 2, 3)]]
    for _ in range(50):
        size = rng.randrange(4, 14)
        tree = {(rng.randrange(i), i) for i in range(1, size)}
        more = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randrange(2 * size))}
        graphs.append([(a, b, rng.randrange(1, 9)) for a, b in sorted(tree | more)])
    memory, rounds = both_forms(spark, graphs)
    assert memory == rounds
    assert 4 <= len({m for i, m in memory.items() if i < 1000}) <= 9  # a chain falls into short pieces


def test_size_of_a_component_does_not_change_its_places(spark):
    df = points(spark, [(i, 55.0 + i * 0.00018, 13.0) for i in range(16)])
    small, large = (clusters(places.cluster_points(df, 30.0, task_edges=n).collect()) for n in (1_000_000, 0))
    assert small == large and len(small) > 1


def test_lone_points_may_stay_unlabelled(spark):
    df = points(spark, [(1, 10.0, 10.0), (2, 20.0, 10.0), (3, 20.0, 10.0001)])
    got = {r.id: r.loc for r in places.cluster_points(df, 30.0, label_singleton=False).collect()}
    assert got[1] == -1 and got[2] == got[3] != -1


def test_hulls_do_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    rows = [("d", 1, rng.random(), rng.random()) for _ in range(500)] + [("d", 2, 1.0, 1.0), ("d", 3, 0.0, 0.0), ("d", 3, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "device_aid string, loc int, latitude double, longitude double")
    a = {r.loc: (r.n_points, tuple(map(tuple, r.ring))) for r in places.stop_hulls(df.repartition(1)).collect()}
    b = {r.loc: (r.n_points, tuple(map(tuple, r.ring))) for r in places.stop_hulls(df.repartition(9)).collect()}
    assert {k: v[0] for k, v in a.items()} == {1: 500, 2: 1, 3: 2}
    assert {k: set(v[1]) for k, v in a.items()} == {k: set(v[1]) for k, v in b.items()}
    assert sorted(a[2][1])[0] == pytest.approx((1.0 - 2.5e-5, 1.0 - 2.5e-5))
    assert max(p[0] for p in a[3][1]) == pytest.approx(3.0)


def test_euclidean_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 50), rng.uniform(-50, 0), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "node bigint, latitude double, longitude double, n_events bigint")
    got = {(r.src, r.dst) for r in places.radius_neighbors(df, 6.0, (), "euclidean").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 36.0}
    assert got == want
