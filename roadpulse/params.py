"""Tunable thresholds.  Defaults are the values the analysed workload uses on its
six-million-row input; every operator takes them as arguments so small fixtures
can pass smaller values without touching operator code."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the analysed workload's for identical results.
# ---------------------------------------------------------------------------
AM_HOURS = (7, 8, 9)
PM_HOURS = (17, 18, 19)
NEAR_ZERO_VELOCITY = 0.1
SLOW_VELOCITY = 1.0
MAX_ABS_LONGITUDE = 180.0
MAX_ABS_LATITUDE = 90.0
COORDINATE_PATTERN = r"^\s*([^,]+),\s*([^,]+)\s*$"
RAW_COLUMNS = ("Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID")
#: Texts that the analysed reader takes for a missing value.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BEHAVIOURAL_FEATURES = (
    "median_velocity",
    "velocity_std",
    "am_relative_slowdown",
    "pm_relative_slowdown",
    "am_slowdown_frequency",
    "pm_slowdown_frequency",
)
LABEL_MORNING = "Severe Morning-Peak Bottlenecks"
LABEL_EVENING = "Severe Evening-Peak Bottlenecks"
LABEL_FREE_FLOW = "High-Speed Free-Flow Corridors"
LABEL_DUAL_PEAK = "Dual-Peak Rush-Hour Sensitive"
LABEL_STEADY = "Steady Moderate-Speed Flow"
THRESHOLD_GRID_OBSERVATIONS = (50, 100, 200, 500)
THRESHOLD_GRID_ACTIVE_DAYS = (5, 10, 20, 30)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class PeakHours:
    am: tuple[int, ...] = AM_HOURS
    pm: tuple[int, ...] = PM_HOURS


@dataclass(frozen=True)
class Thresholds:
    """Support thresholds of the ranking and feature operators."""

    min_daily_obs: int = 5  # daily segment-hour summary (HAVING COUNT(*) >= 5)
    low_velocity_min_obs: int = 5000  # absolute low-velocity screen
    segment_hour_min_obs: int = 100  # relative slowdowns
    recurring_min_days: int = 5  # recurring daily slowdowns
    day_type_min_days: int = 10  # weekday / weekend contrast
    bottleneck_min_days: int = 30  # candidate bottlenecks
    bottleneck_min_obs: int = 200
    feature_min_obs: int = 100  # segment feature qualification
    feature_min_active_days: int = 10
    moving_velocity: float = NEAR_ZERO_VELOCITY
    low_confidence_days: int = 100  # severity ranking confidence flag


@dataclass(frozen=True)
class ClusterParams:
    k: int = 5
    restarts: int = 20
    seed: int = 42
    max_iter: int = 300
    tol: float = 1e-4
    sweep_k: tuple[int, ...] = tuple(range(2, 11))
    sweep_restarts: int = 10
    #: "hash": D-squared sampling by hashes, the same on any cluster; "mllib": MLlib's k-means|| with random seeds
    seeding: str = "hash"
    features: tuple[str, ...] = field(default=BEHAVIOURAL_FEATURES)
