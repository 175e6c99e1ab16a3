"""Small numpy kernels for the few steps that are truly sequential.

They run inside Spark tasks over Arrow batches whose rows Spark has already partitioned and
sorted; none of them knows about Spark.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from sojourn.params import EARTH_RADIUS_M


# ---------------------------------------------------------------- runs of rows
def group_starts(end_flags: np.ndarray) -> np.ndarray:
    """Start offsets of the groups whose last rows are flagged."""
    starts = np.concatenate(([0], np.flatnonzero(end_flags[:-1]) + 1)).astype(np.int64)
    return starts


def key_ends(*keys: np.ndarray) -> np.ndarray:
    """True on the last row of each run of equal keys."""
    n = len(keys[0])
    out = np.zeros(n, dtype=bool)
    if n:
        out[-1] = True
        for k in keys:
            out[:-1] |= k[1:] != k[:-1]
    return out


# ---------------------------------------------------------------- distances
def haversine(lat1, lon1, lat2, lon2):
    """Vectorised great-circle metres."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.sin(np.radians(lon2 - lon1) / 2) ** 2 * np.cos(p1) * np.cos(p2)
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def distance(metric: str, lat1, lon1, lat2, lon2):
    if metric == "haversine":
        return haversine(lat1, lon1, lat2, lon2)
    return np.hypot(lat1 - lat2, lon1 - lon2)


def _box_diameter(metric: str, lat_lo, lon_lo, lat_hi, lon_hi):
    """Upper bound of the distance between any two points of a box."""
    if metric != "haversine":
        return np.hypot(lat_hi - lat_lo, lon_hi - lon_lo)
    crosses = (lat_lo <= 0) & (lat_hi >= 0)
    nearest = np.where(crosses, 0.0, np.minimum(np.abs(lat_lo), np.abs(lat_hi)))
    c = np.cos(np.radians(nearest))
    a = np.sin(np.radians(lat_hi - lat_lo) / 2) ** 2 + (
        c * np.sin(np.minimum(np.radians(lon_hi - lon_lo), math.pi) / 2)
    ) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


# ---------------------------------------------------------------- stationary groups
class _RunningMedian:
    """Median of a growing set: a max-heap of the lower half and a min-heap of the upper."""

    __slots__ = ("low", "high", "value")

    def __init__(self, x: float) -> None:
        self.low = [-x]
        self.high: list[float] = []
        self.value = x

    def add(self, x: float) -> None:
        low, high = self.low, self.high
        if len(low) == len(high):
            heapq.heappush(low, -heapq.heappushpop(high, x))
            self.value = -low[0]
        else:
            heapq.heappush(high, -heapq.heappushpop(low, -x))
            self.value = 0.5 * (-low[0] + high[0])

    @classmethod
    def of(cls, values: np.ndarray) -> _RunningMedian:
        """The state after all of ``values``: sorted halves are heaps already."""
        x = np.sort(values)
        half = (len(x) + 1) // 2
        out = cls(0.0)
        out.low, out.high = (-x[:half][::-1]).tolist(), x[half:].tolist()
        out.value = -out.low[0] if len(x) % 2 else 0.5 * (-out.low[0] + out.high[0])
        return out


def _walk(
    la: list[float], lo: list[float], i: int, mlat: _RunningMedian, mlon: _RunningMedian, r1: float, metric: str
) -> int:
    """Add points from the ``i``-th on to the medians; the first that lies farther than ``r1`` from them."""
    radians, sin, cos, asin, sqrt = math.radians, math.sin, math.cos, math.asin, math.sqrt
    spherical = metric == "haversine"
    for i in range(i, len(la)):
        y, x = la[i], lo[i]
        if spherical:
            p1, p2 = radians(y), radians(mlat.value)
            h = sin((p2 - p1) / 2) ** 2 + sin(radians(mlon.value - x) / 2) ** 2 * cos(p1) * cos(p2)
            d = 2 * EARTH_RADIUS_M * asin(sqrt(h if h < 1.0 else 1.0))
        else:
            d = math.hypot(y - mlat.value, x - mlon.value)
        if not d <= r1:
            return i
        mlat.add(y)
        mlon.add(x)
    return len(la)


def stationary_cuts(
    lat: np.ndarray, lon: np.ndarray, starts: np.ndarray, r1: float, metric: str
) -> np.ndarray:
    """True where a new group begins: at every segment start, and wherever a point lies farther
    than ``r1`` from the running median (per coordinate) of the group so far.

    A segment whose bounding box is no wider than ``r1`` cannot break, so only the others are
    walked point by point.
    """
    n = len(lat)
    cut = np.zeros(n, dtype=bool)
    cut[starts] = True
    ends = np.append(starts[1:], n)
    width = _box_diameter(
        metric,
        np.minimum.reduceat(lat, starts),
        np.minimum.reduceat(lon, starts),
        np.maximum.reduceat(lat, starts),
        np.maximum.reduceat(lon, starts),
    )
    for s in np.flatnonzero(~(width <= r1 * (1 - 1e-9))):
        a, b = int(starts[s]), int(ends[s])
        la, lo = lat[a:b].tolist(), lon[a:b].tolist()
        i = 0
        while i < b - a:
            cut[a + i] = True
            i = _walk(la, lo, i + 1, _RunningMedian(la[i]), _RunningMedian(lo[i]), r1, metric)
    return cut


def grouped_median(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Median of each consecutive group."""
    n = len(values)
    sizes = np.diff(np.append(starts, n))
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(starts)), sizes)))]
    return 0.5 * (ordered[starts + (sizes - 1) // 2] + ordered[starts + sizes // 2])


class StationaryGroup:
    """A group that goes on over batches of rows: its running median, not its rows.

    While its bounding box is no wider than ``r1`` it cannot break and its coordinates are only kept
    (two doubles a point); then two heaps take their place.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, r1: float, metric: str) -> None:
        self.r1, self.metric = r1, metric
        self.box = (math.inf, math.inf, -math.inf, -math.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.medians: tuple[_RunningMedian, _RunningMedian] | None = None
        self._widen(lat, lon)
        self._keep(lat, lon)
        if not self._narrow():
            self._to_heaps()

    def _widen(self, lat: np.ndarray, lon: np.ndarray) -> None:
        a, b, c, d = self.box
        self.box = min(a, lat.min()), min(b, lon.min()), max(c, lat.max()), max(d, lon.max())

    def _keep(self, lat: np.ndarray, lon: np.ndarray) -> None:
        self.kept.append((lat.copy(), lon.copy()))

    def _narrow(self) -> bool:
        return bool(_box_diameter(self.metric, *self.box) <= self.r1 * (1 - 1e-9))

    def _values(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([k[0] for k in self.kept]), np.concatenate([k[1] for k in self.kept])

    def _to_heaps(self) -> None:
        lat, lon = self._values()
        self.medians = _RunningMedian.of(lat), _RunningMedian.of(lon)
        self.kept = []

    def take(self, lat: np.ndarray, lon: np.ndarray) -> int:
        """Add the rows that follow as far as they belong to the group; their number."""
        if not len(lat):
            return 0
        if self.medians is None:
            self._widen(lat, lon)
            if self._narrow():
                self._keep(lat, lon)
                return len(lat)
            self._to_heaps()
        return _walk(lat.tolist(), lon.tolist(), 0, *self.medians, self.r1, self.metric)

    def median(self) -> tuple[float, float]:
        if self.medians is not None:
            return self.medians[0].value, self.medians[1].value
        lat, lon = self._values()
        return float(np.median(lat)), float(np.median(lon))


# ---------------------------------------------------------------- map equation
def _plogp(x: float) -> float:
    return x * math.log2(x) if x > 0.0 else 0.0


def map_equation_modules(neighbours: list[dict[int, float]]) -> np.ndarray:
    """Two-level map-equation partition of an undirected weighted graph (no self loops).

    Follows the published formula of Rosvall and Bergstrom: node flow is strength over twice the
    total weight and the codelength is
    ``plogp(sum q) - 2 sum plogp(q) - sum plogp(p) + sum plogp(q + p)``. Nodes move greedily in
    index order, modules are then merged as nodes, until nothing improves. Deterministic.
    """
    n = len(neighbours)
    total = sum(sum(d.values()) for d in neighbours)
    if n == 0 or total <= 0:
        return np.arange(n)
    links = [{j: w / total for j, w in d.items()} for d in neighbours]
    flow = [sum(d.values()) for d in links]
    leaving = list(flow)
    member = np.arange(n)
    while True:
        module = _local_moves(links, flow, leaving)
        ids, module = np.unique(module, return_inverse=True)
        if len(ids) == len(links):
            return member
        member = module[member]
        merged: list[dict[int, float]] = [{} for _ in ids]
        merged_flow = [0.0] * len(ids)
        for i, d in enumerate(links):
            m = int(module[i])
            merged_flow[m] += flow[i]
            for j, w in d.items():
                k = int(module[j])
                if k != m:
                    merged[m][k] = merged[m].get(k, 0.0) + w
        links, flow = merged, merged_flow
        leaving = [sum(d.values()) for d in links]
        if len(links) == 1:
            return member


def _local_moves(links, flow, leaving) -> np.ndarray:
    n = len(links)
    module = list(range(n))
    p, q = list(flow), list(leaving)
    q_sum = sum(q)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            a = module[i]
            to: dict[int, float] = {}
            for j, w in links[i].items():
                to[module[j]] = to.get(module[j], 0.0) + w
            qa = q[a] - leaving[i] + 2 * to.get(a, 0.0)
            pa_ = p[a] - flow[i]
            best, best_gain, best_q = a, -1e-10, 0.0
            for b in sorted(to):
                if b == a:
                    continue
                qb = q[b] + leaving[i] - 2 * to[b]
                s = q_sum - q[a] - q[b] + qa + qb
                gain = (
                    _plogp(s)
                    - _plogp(q_sum)
                    - 2 * (_plogp(qa) + _plogp(qb) - _plogp(q[a]) - _plogp(q[b]))
                    + _plogp(qa + pa_)
                    + _plogp(qb + p[b] + flow[i])
                    - _plogp(q[a] + p[a])
                    - _plogp(q[b] + p[b])
                )
                if gain < best_gain:
                    best, best_gain, best_q = b, gain, qb
            if best != a:
                q_sum += qa + best_q - q[a] - q[best]
                q[a], q[best] = max(qa, 0.0), max(best_q, 0.0)
                p[a], p[best] = pa_, p[best] + flow[i]
                module[i] = best
                moved = True
    return np.array(module)


#: Numbers that break ties between equal mergers: bounded, so that no product leaves a long.
TIE = (1_000_003, 7_919, 104_729, 2_147_483_647)


def _plogps(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    some = x > 0
    out[some] = x[some] * (np.log(x[some]) / math.log(2.0))
    return out


def merged_modules(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, module) of one component by the map equation: rounds of mergers of modules.

    Each pair of nodes comes once. In a round every module chooses the linked module whose merger
    shortens the description most, and pairs that choose each other merge; a module is named by its
    least node. ``graph.map_equation_communities`` makes the same mergers for components of any size.
    """
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(nodes)
    a, b = np.minimum(ends[: len(src)], ends[len(src) :]), np.maximum(ends[: len(src)], ends[len(src) :])
    w = weight.astype(float)
    p = np.bincount(a, w, n) + np.bincount(b, w, n)
    total, short = p.sum(), nodes % TIE[0]
    module = np.arange(n)
    turn = 0
    while len(a):
        q = np.bincount(a, w, n) + np.bincount(b, w, n)
        qs = q.sum()
        both = np.maximum((q[a] + q[b] - 2 * w) / total, 0.0)
        qa, qb, pa, pb = q[a] / total, q[b] / total, p[a] / total, p[b] / total
        gain = (
            _plogps(np.maximum((qs - 2 * w) / total, 0.0))
            - _plogps(np.full(len(a), qs / total))
            - 2 * (_plogps(both) - _plogps(qa) - _plogps(qb))
            + _plogps(both + pa + pb)
            - _plogps(qa + pa)
            - _plogps(qb + pb)
        )
        tie = (short[a] * TIE[1] + short[b] * TIE[2] + turn * short[a] * short[b]) % TIE[3]
        gain = np.round(gain, 10)
        good = np.flatnonzero(gain < 0)
        if not len(good):
            break
        order = good[np.lexsort((b[good], a[good], tie[good], gain[good]))]
        best = np.full(n, -1)
        sides = np.concatenate([a[order], b[order]])
        rank = np.concatenate([np.arange(len(order))] * 2)
        first = np.full(n, len(order))
        np.minimum.at(first, sides, rank)
        chosen = np.flatnonzero(first < len(order))
        best[chosen] = order[first[chosen]]
        pair = order[(best[a[order]] == order) & (best[b[order]] == order)]
        into = np.arange(n)
        into[b[pair]] = a[pair]
        p[a[pair]] += p[b[pair]]
        module = into[module]
        a, b = into[a], into[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        keep = a != b
        key, at = np.unique(a[keep] * n + b[keep], return_inverse=True)
        w = np.bincount(at, w[keep], len(key))
        a, b = key // n, key % n
        turn += 1
    return nodes, nodes[module]


def edge_weight(c1, c2, dist, weighted: bool, exponent: float):
    """max(count, count), divided by distance**exponent when weighted."""
    w = np.maximum(c1, c2).astype(float)
    return w * np.power(np.maximum(dist, 1e-9), -exponent) if weighted else w


_DENSE = 512  # up to so many points a square distance matrix is cheaper than a search


def place_labels(
    lat: np.ndarray,
    lon: np.ndarray,
    count: np.ndarray,
    r2: float,
    metric: str = "haversine",
    weighted: bool = False,
    exponent: float = 1.0,
    label_singleton: bool = True,
) -> np.ndarray:
    """Labels of unique points, from 1: modules by descending count, then lone points in
    coordinate order (or -1 for those). Points within ``r2`` of each other are linked."""
    n = len(lat)
    order = np.lexsort((lon, lat))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    slat, slon, scount = lat[order], lon[order], count[order]
    band = (r2 / (math.pi * EARTH_RADIUS_M / 180.0)) * 1.001 if metric == "haversine" else r2

    def around(i: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.searchsorted(slat, slat[i] - band, "left")
        hi = np.searchsorted(slat, slat[i] + band, "right")
        d = distance(metric, slat[i], slon[i], slat[lo:hi], slon[lo:hi])
        near = np.flatnonzero(d <= r2)
        near = near[near + lo != i]
        return near + lo, d[near]

    component = np.full(n, -1, dtype=np.int64)
    degree = np.zeros(n, dtype=np.int64)
    n_comp = 0
    if n <= _DENSE:
        apart = distance(metric, slat[:, None], slon[:, None], slat[None, :], slon[None, :])
        linked = apart <= r2
        np.fill_diagonal(linked, True)
        degree = linked.sum(axis=1) - 1
        for root in range(n):
            if component[root] >= 0:
                continue
            inside = linked[root]
            size = 0
            while inside.sum() > size:
                size = inside.sum()
                inside = linked[inside].any(axis=0)
            component[inside] = n_comp
            n_comp += 1
    else:
        # Breadth first search; every point is expanded once and no pair is kept.
        for root in range(n):
            if component[root] >= 0:
                continue
            component[root] = n_comp
            queue = [root]
            while queue:
                i = queue.pop()
                js, _ = around(i)
                degree[i] = len(js)
                fresh = js[component[js] < 0]
                component[fresh] = n_comp
                queue.extend(fresh.tolist())
            n_comp += 1
    sizes = np.bincount(component, minlength=n_comp)
    full = np.bincount(component, weights=degree, minlength=n_comp) == sizes * (sizes - 1)

    if weighted:
        full &= sizes <= 2  # unequal weights can split a complete graph
    # Else a component that is a complete graph is one module; the others share one optimisation,
    # because the codelength couples them through the total exit flow.
    module = component.copy()
    open_nodes = np.flatnonzero(~full[component])
    if len(open_nodes):
        position = {int(i): k for k, i in enumerate(open_nodes)}
        graph = []
        for i in open_nodes:
            js, d = around(int(i))
            w = edge_weight(scount[i], scount[js], d, weighted, exponent)
            graph.append({position[int(j)]: float(x) for j, x in zip(js, w)})
        module[open_nodes] = n_comp + map_equation_modules(graph)

    ids, module, msizes = np.unique(module, return_inverse=True, return_counts=True)
    lone = (msizes == 1) & (np.bincount(module, weights=degree) == 0)
    visits = np.bincount(module, weights=scount)
    first = np.full(len(ids), n)
    np.minimum.at(first, module, np.arange(n))
    ranked = np.lexsort((first, np.where(lone, 0.0, -visits), lone))
    label = np.empty(len(ids), dtype=np.int64)
    label[ranked] = np.arange(1, len(ids) + 1)
    if not label_singleton:
        label[lone] = -1
    return label[module][rank]


# ---------------------------------------------------------------- convex hull
def hull_indices(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the strict convex hull, counter-clockwise from the lowest (x, y).

    A set on one line gives its two ends, one point gives itself.
    """
    order = np.lexsort((y, x))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    order = order[keep].tolist()
    if len(order) <= 2:
        return np.array(order)

    def half(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                o, a = out[-2], out[-1]
                if (x[a] - x[o]) * (y[i] - y[o]) - (y[a] - y[o]) * (x[i] - x[o]) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    return np.array(half(order)[:-1] + half(reversed(order))[:-1])
