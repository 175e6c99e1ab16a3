import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sojourn.functions import kernels
from sojourn.operators.trace import _event_kernel
from sojourn.params import StayParams
from tests.reference_model import events


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=60), st.integers(1, 400))
def test_cuts_follow_the_running_median(cells, radius):
    lat = np.array([55.5 + c[0] * 1e-5 for c in cells])
    lon = np.array([13.0 + c[1] * 1e-5 for c in cells])
    cut = kernels.stationary_cuts(lat, lon, np.array([0]), radius / 10, "haversine")
    trace = [(i, a, b) for i, (a, b) in enumerate(zip(lat.tolist(), lon.tolist()))]
    found, _ = events(trace, radius / 10, 1, 0, 10**9)
    assert np.flatnonzero(cut).tolist() == [f[0] for f in found]
    medians = kernels.grouped_median(lat, np.flatnonzero(cut))
    assert np.allclose(medians, [f[2] for f in found], atol=1e-12, rtol=0)


def test_distance_of_exactly_r1_still_belongs():
    lat, lon = np.array([0.0, 3.0]), np.array([0.0, 4.0])
    assert kernels.stationary_cuts(lat, lon, np.array([0]), 5.0, "euclidean").tolist() == [True, False]
    assert kernels.stationary_cuts(lat, lon, np.array([0]), 4.999, "euclidean").tolist() == [True, True]


def codelength(graph, modules):
    total = sum(sum(d.values()) for d in graph)
    plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
    flow = [sum(d.values()) / total for d in graph]
    q = {}
    p = {}
    for i, d in enumerate(graph):
        p[modules[i]] = p.get(modules[i], 0) + flow[i]
        q.setdefault(modules[i], 0.0)
        for j, w in d.items():
            if modules[j] != modules[i]:
                q[modules[i]] += w / total
    return (
        plogp(sum(q.values())) - 2 * sum(map(plogp, q.values())) - sum(map(plogp, flow))
        + sum(plogp(q[m] + p[m]) for m in p)
    )


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 14), st.integers(0, 10**6))
def test_modules_never_describe_worse_than_trivial_partitions(n, seed):
    rng = np.random.default_rng(seed)
    graph = [{} for _ in range(n)]
    for i in range(n - 1):
        for j in range(i + 1, n):
            if j == i + 1 or rng.random() < 0.3:
                graph[i][j] = graph[j][i] = float(rng.integers(1, 9))
    found = kernels.map_equation_modules(graph)
    best = codelength(graph, found.tolist())
    assert best <= codelength(graph, list(range(n))) + 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=16))
def test_a_complete_graph_is_one_module(counts):
    graph = [
        {j: float(max(a, b)) for j, b in enumerate(counts) if j != i} for i, a in enumerate(counts)
    ]
    assert len(set(kernels.map_equation_modules(graph).tolist())) == 1


def test_two_cliques_with_a_weak_bridge_are_two_modules():
    graph = [{} for _ in range(10)]
    for block in (range(5), range(5, 10)):
        for i in block:
            for j in block:
                if i != j:
                    graph[i][j] = 5.0
    graph[4][5] = graph[5][4] = 1.0
    m = kernels.map_equation_modules(graph)
    assert len(set(m[:5])) == 1 and len(set(m[5:])) == 1 and m[0] != m[9]


def test_dense_and_searched_labels_agree(monkeypatch):
    rng = np.random.default_rng(5)
    lat = 55.5 + rng.integers(0, 40, 120) * 1e-4
    lon = 13.0 + rng.integers(0, 40, 120) * 1e-4
    points = np.unique(np.stack([lat, lon], axis=1), axis=0)
    count = rng.integers(1, 9, len(points)).astype(float)
    args = (points[:, 0], points[:, 1], count, 30.0)
    dense = kernels.place_labels(*args)
    monkeypatch.setattr(kernels, "_DENSE", 0)
    assert (kernels.place_labels(*args) == dense).all()


def test_lone_points_come_last_or_get_no_label():
    lat = np.array([10.0, 20.0, 20.0001, 30.0])
    lon = np.zeros(4)
    count = np.ones(4)
    assert kernels.place_labels(lat, lon, count, 30.0).tolist() == [2, 1, 1, 3]
    assert kernels.place_labels(lat, lon, count, 30.0, label_singleton=False).tolist() == [-1, 1, 1, -1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_hull_contains_all_points_and_is_convex(points):
    x = np.array([p[0] for p in points], dtype=float)
    y = np.array([p[1] for p in points], dtype=float)
    h = kernels.hull_indices(x, y)
    hx, hy = x[h], y[h]
    assert len(set(zip(hx, hy))) == len(h)
    if len(h) < 3:
        return
    for i in range(len(h)):
        j = (i + 1) % len(h)
        side = (hx[j] - hx[i]) * (y - hy[i]) - (hy[j] - hy[i]) * (x - hx[i])
        assert (side >= -1e-9).all()


def event_rows(seed, n):
    """Sorted rows as the event kernel gets them: slow drifts, jumps, steps at the limit, ends of segments."""
    rng = np.random.default_rng(seed)
    step = rng.choice([1, 60, 600, 10800], n, p=[0.3, 0.4, 0.2, 0.1])
    end = rng.random(n) < rng.choice([0.0, 0.05, 0.5])
    end[-1] = True
    wide = rng.choice([0.0, 2e-5, 1.5e-4])
    drift = np.cumsum(rng.normal(0, wide / 4 + 1e-7, n))
    return pa.RecordBatch.from_pydict(
        {
            "device_aid": pa.array([f"d{k}" for k in np.cumsum(np.append(0, end[:-1]))]),
            "timestamp": 1_700_000_000 + np.cumsum(step),
            "next_time": 1_700_000_000 + np.cumsum(np.append(step, 1))[1:],
            "is_end": end,
            "latitude": 55.5 + drift + rng.integers(0, 3, n) * wide,
            "longitude": 13.0 + rng.integers(0, 3, n) * wide,
        }
    )


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.lists(st.integers(1, 40), min_size=1), st.booleans(), st.booleans())
def test_groups_do_not_depend_on_the_batches(seed, n, sizes, timed, as_runs):
    rows = event_rows(seed, n)
    cuts, at = [], 0
    while at < n:
        cuts.append(rows.slice(at, sizes[len(cuts) % len(sizes)]))
        at += cuts[-1].num_rows
    kernel = _event_kernel(StayParams(), timed, as_runs)
    one, many = (sorted(str(r) for b in kernel(x) for r in b.to_pylist()) for x in ([rows], cuts))
    assert one == many


def test_a_long_segment_leaves_only_its_medians_and_runs_behind():
    n, size = 400_000, 10_000
    rng = np.random.default_rng(7)

    def batches(spread, peak):
        for at in range(0, n, size):
            t = np.arange(at, at + size, dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "device_aid": pa.array(["d"] * size),
                    "timestamp": t,
                    "next_time": t + 1,
                    "is_end": t == n - 1,
                    "latitude": 55.5 + rng.random(size) * spread,
                    "longitude": 13.0 + rng.random(size) * spread,
                }
            )
            peak.append(pa.total_allocated_bytes())

    for spread in (1e-5, 2.5e-4):
        peak = []
        (out,) = _event_kernel(StayParams(), False, True)(batches(spread, peak))
        assert out.to_pylist()[0]["size"] == n
        assert max(peak[5:]) < 2 * max(peak[:5])  # no batch is held
