"""Independent DuckDB SQL for the registered queries, built from shared CTE texts."""

from __future__ import annotations

# ---------------------------------------------------------------- fixture twins
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    CTE[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """``WITH`` all CTEs reachable from ``needs``, then the body."""
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for d in CTE[n][0]:
            add(d)
        ordered.append(n)

    for n in needs:
        add(n)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered) + "\n" + body



def deg(e5: str) -> str:
    return f"(CAST({e5} AS DOUBLE) / CAST(100000 AS DOUBLE))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, "
        f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + "
        f"pow(sin(radians(({lon2}) - ({lon1})) / 2), 2) * cos(radians({lat1})) * cos(radians({lat2}))))))"
    )


cte("users", (), "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
cte(
    "slots",
    ("users",),
    """SELECT user_id, slot, 'dev_' || user_id AS device_aid,
  (user_id * 37 + slot * 211) % 110 AS gy, (user_id * 53 + slot * 97) % 110 AS gx
  FROM users, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS slot)""",
)
cte(
    "truth",
    (),
    f"""SELECT t0 + 300 * k AS timestamp, 'dev_' || user_id AS device_aid, user_id, place, event_id * 6 + k AS seq,
  {deg('5553000 + gy * 100 + 2 * ((event_id + k) % 5)')} AS latitude,
  {deg('1290000 + gx * 200 + 2 * ((event_id * 3 + k) % 5)')} AS longitude
  FROM (SELECT *, (user_id * 37 + slot * 211) % 110 AS gy, (user_id * 53 + slot * 97) % 110 AS gx, gy * 110 + gx AS place
    FROM (SELECT *, CASE WHEN hr >= 22 OR hr < 7 THEN 0
        WHEN dow BETWEEN 1 AND 5 AND hr BETWEEN 9 AND 16 THEN 1 ELSE 2 + event_id % 3 END AS slot
      FROM (SELECT event_id, user_id, t0, (t0 // 3600) % 24 AS hr, (t0 // 86400 + 4) % 7 AS dow
        FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t0 FROM events WHERE user_id IS NOT NULL)))),
  (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS k)""",
)
cte("pings", ("truth",), "SELECT timestamp, device_aid, latitude, longitude, seq, place FROM truth")
cte(
    "dirty_pings",
    ("pings",),
    """SELECT timestamp, device_aid, latitude, longitude FROM pings
  UNION ALL SELECT timestamp, device_aid, latitude, longitude FROM pings WHERE seq % 50 = 0
  UNION ALL SELECT timestamp, device_aid, NULL, longitude FROM pings WHERE seq % 70 = 0
  UNION ALL SELECT timestamp, device_aid, 85.0::DOUBLE, longitude FROM pings WHERE seq % 90 = 0
  UNION ALL SELECT timestamp, device_aid, latitude, 180.0::DOUBLE FROM pings WHERE seq % 110 = 0""",
)


# ---------------------------------------------------------------- closed form of the stay chain
def stay_chain(prefix: str, source: str) -> None:
    """CTEs {prefix}filled, ..., {prefix}stays over a ping CTE that carries the true place."""
    cte(
        f"{prefix}filled",
        (source,),
        f"""SELECT device_aid, unnest(CASE WHEN nx - timestamp >= 10800 THEN [timestamp, timestamp + 10799]
    WHEN nx = timestamp THEN [] ELSE [timestamp] END) AS timestamp, latitude, longitude, place
  FROM (SELECT *, lead(timestamp) OVER (PARTITION BY device_aid ORDER BY timestamp, latitude, longitude) AS nx
    FROM (SELECT DISTINCT device_aid, timestamp, latitude, longitude, place FROM {source}))""",
    )
    cte(
        f"{prefix}grouped",
        (f"{prefix}filled",),
        f"""SELECT *, sum(brk) OVER (PARTITION BY device_aid ORDER BY timestamp) AS ev
  FROM (SELECT *, CASE WHEN lag(place) OVER w = place AND timestamp - lag(timestamp) OVER w <= 10800 THEN 0 ELSE 1 END AS brk
    FROM {prefix}filled WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp))""",
    )
    cte(
        f"{prefix}stops",
        (f"{prefix}grouped",),
        f"""SELECT device_aid, ev, place, min(timestamp) AS event_start, max(timestamp) AS event_end, count(*) AS n_pings,
    median(latitude) AS latitude, median(longitude) AS longitude
  FROM {prefix}grouped GROUP BY device_aid, ev, place HAVING count(*) >= 2 AND max(timestamp) - min(timestamp) >= 900""",
    )
    cte(
        f"{prefix}points",
        (f"{prefix}stops",),
        f"SELECT device_aid, place, latitude, longitude, count(*) AS n_events FROM {prefix}stops GROUP BY ALL",
    )
    cte(
        f"{prefix}medians",
        (f"{prefix}points",),
        f"""SELECT device_aid, place, median(latitude) AS stop_latitude, median(longitude) AS stop_longitude
  FROM {prefix}points GROUP BY ALL""",
    )
    cte(
        f"{prefix}labelled",
        (f"{prefix}grouped", f"{prefix}stops", f"{prefix}medians"),
        f"""SELECT g.device_aid, g.timestamp, g.latitude, g.longitude, e.event_start, e.latitude AS event_latitude,
    e.longitude AS event_longitude, CASE WHEN e.ev IS NULL THEN -1 ELSE g.place END AS loc, m.stop_latitude, m.stop_longitude
  FROM {prefix}grouped g LEFT JOIN {prefix}stops e ON g.device_aid = e.device_aid AND g.ev = e.ev
  LEFT JOIN {prefix}medians m ON e.device_aid = m.device_aid AND e.place = m.place""",
    )
    cte(
        f"{prefix}intervals",
        (f"{prefix}labelled",),
        f"""SELECT *, sum(brk) OVER (PARTITION BY device_aid ORDER BY timestamp) AS interval
  FROM (SELECT *, CASE WHEN lag(loc) OVER w = loc AND timestamp - lag(timestamp) OVER w < 10800 THEN 0 ELSE 1 END AS brk
    FROM {prefix}labelled WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp))""",
    )
    cte(
        f"{prefix}stays",
        (f"{prefix}intervals",),
        f"""SELECT device_aid, loc AS place, min(timestamp) AS start, max(timestamp) AS "end", stop_latitude AS latitude,
    stop_longitude AS longitude, count(*) AS size, interval
  FROM {prefix}intervals WHERE loc <> -1 GROUP BY device_aid, interval, loc, stop_latitude, stop_longitude""",
    )


stay_chain("", "pings")
