"""A plain, slow model of the trace rules, for comparison on small random inputs."""

import math
import statistics

R = 6371000.0


def dist(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.sin(math.radians(b[1] - a[1]) / 2) ** 2 * math.cos(p1) * math.cos(p2)
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def fill(rows, limit):
    """rows: sorted unique (t, lat, lon) -> with gap copies, last of each second kept."""
    last = {}
    for t, lat, lon in sorted(rows):
        last[t] = (lat, lon)
    times = sorted(last)
    out = []
    for i, t in enumerate(times):
        out.append((t, *last[t]))
        if i + 1 < len(times) and times[i + 1] - t >= limit:
            out.append((t + limit - 1, *last[t]))
    return out


def events(trace, r1, min_size, min_stay, limit, timed=True):
    """-> list of (first index, last index, median lat, median lon) and the trace's event starts."""
    found, start = [], 0
    mark = [None] * len(trace)

    def close(a, b):
        group = trace[a:b]
        if len(group) >= min_size and (not timed or group[-1][0] - group[0][0] >= min_stay):
            lat = statistics.median(g[1] for g in group)
            lon = statistics.median(g[2] for g in group)
            found.append((a, b - 1, lat, lon))
            for i in range(a, b):
                mark[i] = group[0][0]

    for i in range(1, len(trace)):
        group = trace[start:i]
        mid = (statistics.median(g[1] for g in group), statistics.median(g[2] for g in group))
        far = dist(trace[i][1:], mid) > r1
        late = timed and trace[i][0] - trace[i - 1][0] > limit
        if far or late:
            close(start, i)
            start = i
    if trace:
        close(start, len(trace))
    return found, mark
