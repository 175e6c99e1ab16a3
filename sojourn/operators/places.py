"""Stop locations: unique event points, their neighbour graph and its communities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions import geo, kernels
from sojourn.operators import graph, spatial
from sojourn.params import StayParams
from sojourn.session import cut, kernel_shuffle

POINT = ["latitude", "longitude"]


def snapped(rows: DataFrame, resolution: float) -> DataFrame:
    """Round coordinates half-even onto a grid (0 keeps them)."""
    if resolution <= 0:
        return rows
    return rows.withColumns({c: geo.snap(c, resolution) for c in POINT})


def unique_points(events: DataFrame, by: Sequence[str] = ("device_aid",), resolution: float = 0.0) -> DataFrame:
    """Distinct event points with how often each occurs; ``node`` numbers them per key."""
    by = list(by)
    out = snapped(events, resolution).groupBy(*by, *POINT).agg(F.count(F.lit(1)).alias("n_events"))
    if by:
        # A device has at most one event per min_staying_time, so its points stay few.
        return out.withColumn("node", F.row_number().over(Window.partitionBy(*by).orderBy(*POINT)))
    # Without a key an id from the coordinates needs no global order.
    return out.withColumn("node", point_id(resolution))


def point_id(resolution: float) -> Column:
    """Number of a place in degrees: exact on a grid of 1e-7 degrees or coarser, else a hash."""
    if resolution < 1e-7:
        return F.xxhash64(*POINT)
    row, column = (F.bround(F.col(c) / F.lit(resolution)).cast("bigint") for c in POINT)
    return row * F.lit(1 << 32) + column


def radius_neighbors(
    points: DataFrame, r2: float = 30.0, by: Sequence[str] = ("device_aid",), metric: str = "haversine"
) -> DataFrame:
    """Pairs (src < dst) of points within ``r2``, with their distance."""
    by = list(by)
    a = points.select(
        *by, F.col("node").alias("src"), F.col("n_events").alias("src_n"), *[F.col(c).alias(f"_a{c}") for c in POINT]
    )
    b = points.select(
        *by, F.col("node").alias("dst"), F.col("n_events").alias("dst_n"), *[F.col(c).alias(f"_b{c}") for c in POINT]
    )
    if metric == "haversine":
        pairs = spatial.near(
            a, b, r2, by, ("_alatitude", "_alongitude"), ("_blatitude", "_blongitude"), out="distance"
        )
    else:
        step = F.lit(float(r2))

        def cell(c: str, shift: int = 0):
            return F.floor(F.col(c) / step).cast("bigint") + shift

        a = a.withColumns({"_cy": cell("_alatitude"), "_cx": cell("_alongitude")})
        for axis, c in (("_cy", "_blatitude"), ("_cx", "_blongitude")):
            b = b.withColumn(axis, F.explode(F.array(*[cell(c, s) for s in (-1, 0, 1)])))
        d = geo.euclidean("_alatitude", "_alongitude", "_blatitude", "_blongitude")
        pairs = a.join(b, [*by, "_cy", "_cx"]).withColumn("distance", d).where(F.col("distance") <= r2)
    return pairs.where(F.col("src") < F.col("dst")).select(*by, "src", "dst", "src_n", "dst_n", "distance")


def edge_weights(edges: DataFrame, weighted: bool = False, exponent: float = 1.0) -> DataFrame:
    """weight = max(count, count), divided by distance**exponent when ``weighted``."""
    w = F.greatest("src_n", "dst_n").cast("double")
    if weighted:
        w = w * F.pow(F.greatest(F.col("distance"), F.lit(1e-9)), F.lit(-float(exponent)))
    return edges.withColumn("weight", w)


# ---------------------------------------------------------------- labels per key
def _device_slices(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole devices with group offsets, from batches sorted by device."""
    pending: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if pending is not None:
            table = pa.concat_tables([pending, table])
        keys = table.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        if len(starts) > 1:
            head = table.slice(0, int(starts[-1]))
            pending = table.slice(int(starts[-1]))
            yield head, starts[:-1]
        else:
            pending = table
    if pending is not None and pending.num_rows:
        keys = pending.column(key).to_numpy(zero_copy_only=False)
        yield pending, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _label_kernel(p: StayParams, key: str, count: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _device_slices(batches, key):
            lat, lon = (table.column(c).to_numpy() for c in POINT)
            weights = table.column(count).to_numpy() if count else None
            first = None if count else _first_of_event(table)
            n = len(lat)
            loc = np.empty(n, dtype=np.int32)
            stop_lat, stop_lon = np.full(n, np.nan), np.full(n, np.nan)
            for a, b in zip(starts, np.append(starts[1:], n)):
                s = slice(int(a), int(b))
                new = np.ones(b - a, dtype=bool)
                new[1:] = (np.diff(lat[s]) != 0) | (np.diff(lon[s]) != 0)
                at = np.flatnonzero(new)
                counts = np.add.reduceat(weights[s] if count else first[s].astype(float), at)
                labels = kernels.place_labels(
                    lat[s][at], lon[s][at], counts, p.r2, p.distance_metric, p.weighted,
                    p.weight_exponent, p.label_singleton,
                )
                by = np.argsort(labels, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], np.diff(labels[by]) != 0)))
                which = np.searchsorted(labels[by][edges], labels)
                mid_lat = kernels.grouped_median(lat[s][at][by], edges)[which]
                mid_lon = kernels.grouped_median(lon[s][at][by], edges)[which]
                back = np.cumsum(new) - 1
                loc[s] = labels[back]
                stop_lat[s] = np.where(labels == -1, np.nan, mid_lat)[back]
                stop_lon[s] = np.where(labels == -1, np.nan, mid_lon)[back]
            out = (
                table.append_column("loc", pa.array(loc))
                .append_column("stop_latitude", pa.array(stop_lat, from_pandas=True))
                .append_column("stop_longitude", pa.array(stop_lon, from_pandas=True))
            )
            yield from out.to_batches()

    return run


def _first_of_event(table: pa.Table) -> np.ndarray:
    event = table.column("event_start").to_numpy()
    lat, lon = (table.column(c).to_numpy() for c in POINT)
    first = np.ones(len(event), dtype=bool)
    first[1:] = (event[1:] != event[:-1]) | (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])
    return first


def _labelled(rows: DataFrame, p: StayParams, key: str, order: Sequence[str], count: str | None) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{fields}, loc int, stop_latitude double, stop_longitude double"
    return kernel_shuffle(rows, key).sortWithinPartitions(key, *POINT, *order).mapInArrow(
        _label_kernel(p, key, count), schema
    )


def label_runs(runs: DataFrame, p: StayParams = StayParams()) -> DataFrame:
    """Give each event run the label and median of its stop location.

    One device holds at most one event per ``min_staying_time``, which bounds the group.
    """
    return _labelled(snapped(runs, p.resolution), p, "device_aid", ["event_start", "start"], None)


def stop_locations(points: DataFrame, p: StayParams = StayParams(), key: str = "device_aid") -> DataFrame:
    """Label unique points (key, latitude, longitude, n_events) of each key separately."""
    return _labelled(points, p, key, [], "n_events")


def label_medians(labelled_points: DataFrame, by: Sequence[str] = ("device_aid",)) -> DataFrame:
    """Median place of each label over its unique points (every point once)."""
    return (
        labelled_points.where(F.col("loc") != -1)
        .groupBy(*by, "loc")
        .agg(F.median("latitude").alias("stop_latitude"), F.median("longitude").alias("stop_longitude"))
    )


# ---------------------------------------------------------------- shared places
def _merge_kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in _device_slices(batches, "component"):
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        found = [
            kernels.merged_modules(src[i:j], dst[i:j], weight[i:j])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(src)], strict=True)
        ]
        nodes, modules = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.record_batch({"node": nodes, "module": modules})


def cluster_points(
    points: DataFrame,
    r2: float = 30.0,
    resolution: float = 0.0,
    metric: str = "haversine",
    weighted: bool = False,
    exponent: float = 1.0,
    label_singleton: bool = True,
    task_edges: int = 1_000_000,
) -> DataFrame:
    """Cluster places of a whole population: points in, the same rows with ``loc`` out.

    ``loc`` is the least node id of the community, or -1 for lone points when ``label_singleton`` is
    off and for rows without coordinates. A component in which all are neighbours is one community
    (when weighted, up to two points). Others are split by the map equation, each on its own, by
    rounds of mergers: in memory up to ``task_edges`` edges, as joins beyond. Both make the same
    mergers, so the size of a component decides where it is solved and not what comes out.
    A ``resolution`` (in degrees) bounds how many unique points can share a neighbourhood.
    """
    rows = snapped(points, resolution) if resolution > 0 else points
    exact = resolution if metric == "haversine" else 0.0
    complete = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = rows.withColumn("node", F.when(complete, point_id(exact)))
    nodes = cut(unique_points(points.where(complete), (), resolution).withColumn("node", point_id(exact)))
    edges = cut(edge_weights(radius_neighbors(nodes, r2, (), metric), weighted, exponent))
    component = cut(graph.connected_components(nodes, edges))
    inner = edges.join(component.select(F.col("node").alias("src"), "component"), "src")
    inner = cut(inner.select("component", "src", "dst", "weight"))
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).join(
        inner.groupBy("component").agg(F.count(F.lit(1)).alias("_m")), "component", "left"
    )
    whole = 2 * F.coalesce("_m", F.lit(0)) == F.col("_n") * (F.col("_n") - 1)
    sizes = cut(sizes.withColumn("_whole", whole & (F.col("_n") <= 2) if weighted else whole))
    lone = F.lit(label_singleton) | (F.col("_n") > 1)
    labels = component.join(sizes.where("_whole"), "component").select(
        "node", F.when(lone, F.col("component")).otherwise(F.lit(-1)).alias("module")
    )
    small = inner.join(sizes.where(~F.col("_whole") & (F.col("_m") <= task_edges)).select("component"), "component")
    solved = kernel_shuffle(small, "component").sortWithinPartitions("component", "src", "dst")
    labels = labels.unionByName(solved.mapInArrow(_merge_kernel, "node long, module long"))
    large = sizes.where(~F.col("_whole") & (F.col("_m") > task_edges)).select("component")
    if not large.isEmpty():
        labels = labels.unionByName(graph.map_equation_communities(inner.join(large, "component")))
    labelled = rows.join(labels.select("node", F.col("module").alias("loc")), "node", "left")
    return labelled.withColumn("loc", F.coalesce("loc", F.lit(-1).cast("long"))).drop("node")


def shared_stop_locations(events: DataFrame, p: StayParams = StayParams(), **options) -> DataFrame:
    """Label stationary events of all devices together, so that labels are shared.

    The events are written once: the places and the labelled rows are both made from them.
    """
    return cluster_points(
        cut(events),
        r2=p.r2,
        metric=p.distance_metric,
        weighted=p.weighted,
        exponent=p.weight_exponent,
        label_singleton=p.label_singleton,
        **({"resolution": p.resolution} | options),
    )


# ---------------------------------------------------------------- hulls
_HULL = "n bigint, sum_lat double, sum_lon double, latitude double, longitude double"


def stop_hulls(points: DataFrame, by: Sequence[str] = ("device_aid", "loc")) -> DataFrame:
    """Ring (open, corner points) round the distinct points of each key.

    Points on one line or spot give a square: its side is the largest distance between two of
    them in degrees (5e-5 for one point), its centre their mean. Hulls of hulls are hulls, so every
    task first shrinks its own share of a key and only corners are shuffled.
    """
    by = list(by)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in by)
    distinct = points.select(*by, *POINT).dropDuplicates()
    partial = distinct.select(
        *by,
        F.lit(1).cast("bigint").alias("n"),
        F.col("latitude").alias("sum_lat"),
        F.col("longitude").alias("sum_lon"),
        *POINT,
    ).mapInArrow(_hull_kernel(by, final=False), f"{keys}, {_HULL}")
    return (
        partial.repartition(*by)
        .sortWithinPartitions(*by)
        .mapInArrow(
            _hull_kernel(by, final=True),
            f"{keys}, n_points bigint, ring array<struct<lon:double,lat:double>>",
        )
    )


def _hull_kernel(by: list[str], final: bool):
    def grouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the rows by key, and where each key starts and ends in it."""
        key = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        return order, starts, np.append(starts[1:], len(order))

    def shrink(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        order, starts, ends = grouped(table)
        lon, lat = (table.column(c).to_numpy()[order] for c in ("longitude", "latitude"))
        # One or two points are their own corners, once each; only larger keys need a hull.
        keep = np.ones(len(order), dtype=bool)
        two = starts[ends - starts == 2]
        keep[two + 1] = (lon[two] != lon[two + 1]) | (lat[two] != lat[two + 1])
        more = ends - starts > 2
        for a, z in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            keep[a:z] = False
            keep[a + kernels.hull_indices(lon[a:z], lat[a:z])] = True
        kept = np.flatnonzero(keep)
        out = table.take(pa.array(order[kept]))
        # Totals ride on the first corner; the others carry zero.
        first = np.searchsorted(kept, starts)
        for c in ("n", "sum_lat", "sum_lon"):
            values = table.column(c).to_numpy()[order]
            total = np.zeros(len(kept), dtype=values.dtype)
            total[first] = np.add.reduceat(values, starts)
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(total))
        return out

    def finish(table: pa.Table) -> pa.Table:
        order, starts, ends = grouped(table)
        lon, lat = (table.column(c).to_numpy()[order] for c in ("longitude", "latitude"))
        n, sum_lat, sum_lon = (
            np.add.reduceat(table.column(c).to_numpy()[order], starts) for c in ("n", "sum_lat", "sum_lon")
        )
        one, other = starts.copy(), ends - 1  # the ends of a line
        polygons: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(ends - starts > 2).tolist():
            a, z = int(starts[i]), int(ends[i])
            corner = a + kernels.hull_indices(lon[a:z], lat[a:z])
            if len(corner) >= 3:
                polygons[i] = corner
            else:
                one[i], other[i] = corner[0], corner[-1]
        half = np.where(n == 1, 5e-5, np.hypot(lat[one] - lat[other], lon[one] - lon[other])) / 2
        sizes = np.full(len(starts), 4, dtype=np.int64)
        sizes[list(polygons)] = [len(c) for c in polygons.values()]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        ring_lon, ring_lat = np.empty(offsets[-1]), np.empty(offsets[-1])
        square = np.ones(len(starts), dtype=bool)
        square[list(polygons)] = False
        at = offsets[:-1][square]
        for k, (dy, dx) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
            ring_lon[at + k] = (sum_lon / n + dx * half)[square]
            ring_lat[at + k] = (sum_lat / n + dy * half)[square]
        for i, corner in polygons.items():
            ring_lon[offsets[i] : offsets[i + 1]] = lon[corner]
            ring_lat[offsets[i] : offsets[i + 1]] = lat[corner]
        points = pa.StructArray.from_arrays([pa.array(ring_lon), pa.array(ring_lat)], ["lon", "lat"])
        rings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)
        out = table.select(by).take(pa.array(order[starts]))
        return out.append_column("n_points", pa.array(n, pa.int64())).append_column("ring", rings)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not final:
            for batch in batches:
                if batch.num_rows:
                    yield from shrink(pa.Table.from_batches([batch])).to_batches()
            return
        # Sorted by key: hold back the last key until the next one appears, shrinking it so that
        # a key spread over many batches never grows beyond its corners.
        pending: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if pending is not None:
                table = pa.concat_tables([pending, table])
            keys = [table.column(k).to_numpy(zero_copy_only=False) for k in by]
            ends = np.flatnonzero(kernels.key_ends(*keys))
            split = int(ends[-2]) + 1 if len(ends) > 1 else 0
            if split:
                yield from finish(table.slice(0, split)).to_batches()
            pending = shrink(table.slice(split))
        if pending is not None:
            yield from finish(pending).to_batches()

    return run
