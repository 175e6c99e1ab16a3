"""Default parameters of every step, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass

# The parameter defaults users of the original pipeline rely on.
N_GROUPS = 50
EARTH_RADIUS_M = 6371000.0
UTC_OFFSET_SECONDS = 3600


@dataclass(frozen=True)
class StayParams:
    """Stay detection. Times in seconds, distances in metres (or map units when euclidean)."""

    r1: float = 30.0
    r2: float = 30.0
    min_staying_time: int = 900
    max_time_between: int = 10800
    min_size: int = 2
    resolution: float = 0.0
    distance_metric: str = "haversine"
    label_singleton: bool = True
    weighted: bool = False
    weight_exponent: float = 1.0

    def __post_init__(self) -> None:
        if self.r1 <= 0 or self.r2 <= 0:
            raise ValueError("r1 and r2 must be > 0")
        if self.min_staying_time <= 0 or self.max_time_between <= self.min_staying_time:
            raise ValueError("need 0 < min_staying_time < max_time_between")
        if self.min_size < 2:
            raise ValueError("min_size must be > 1")
        if not 0 <= self.resolution <= 1:
            raise ValueError("resolution must be within [0, 1]")
        if self.distance_metric not in ("haversine", "euclidean"):
            raise ValueError("distance_metric is 'haversine' or 'euclidean'")


@dataclass(frozen=True)
class AnchorParams:
    """Home and work detection."""

    min_days_home: int = 3
    night_start: int = 22
    night_end: int = 7
    work_start: int = 9
    work_end: int = 17
    range_window_home: int = 14
    range_window_work: int = 28
    grid_m: int = 250


@dataclass(frozen=True)
class VenueParams:
    """Device filters and the tiers of venue matching (tier 1 is footprint containment)."""

    min_stops_per_device: int = 10
    min_days_observed: int = 7
    max_home_distance_km: float = 200.0
    building_link_m: float = 50.0
    home_exclusion_m: float = 100.0
    tier_radii_m: tuple[tuple[int, float], ...] = ((2, 20.0), (3, 50.0), (4, 100.0))
    duplicate_overlap: float = 0.8


@dataclass(frozen=True)
class ReachParams:
    """Walking reach: speed times threshold gives the network length limit."""

    speed_kmh: float = 5.0
    threshold_minutes: float = 15.0

    @property
    def limit_m(self) -> int:
        return int(round(self.speed_kmh * 1000 / 60 * self.threshold_minutes))


@dataclass(frozen=True)
class ScenarioParams:
    """Rewiring by distance decay, and weight trimming."""

    decay: str = "power"
    beta: float = 1.5
    seed: int = 42
    floor_km: float = 0.01
    trimming_factor: float = 3.5
    max_weight: float = 10.0
