"""Thresholds and weights of the dispatch rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values -----------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
HARD_MAX_DISTANCE_KM = 60.0
MISSING_DISTANCE_KM = 9999.0
TRAVEL_BASE_COST = 0.5
TRAVEL_PENALTY_THRESHOLD_KM = 20.0
TRAVEL_PENALTY_MULTIPLIER = 2.0
UNDERUTIL_THRESHOLD = 0.4
OVERUTIL_THRESHOLD = 0.9
UNDERUTIL_PENALTY = 8.0
OVERUTIL_PENALTY = 15.0
SUCCESS_WEIGHT = 0.7
FTF_WEIGHT = 0.3
RISK_COST_MULTIPLIER = 10.0
DURATION_COST_FACTOR = 0.01
CONSTRAINT_PENALTY = 100.0
PRIORITY_WEIGHTS = {"Critical": 3.0, "High": 2.0, "Normal": 1.0, "Low": 0.5}
CONSTRAINT_LEVELS = (
    "ALL_CONSTRAINTS_MET",
    "FAILED_DISTANCE",
    "FAILED_AVAILABILITY",
    "FAILED_CAPACITY",
    "FAILED_SKILL",
    "NO_DATE_MATCH",
)
FIRST_FREE_ID = 200_000_000
LIGHT_SPEED_KM_S = 299792.458
VELOCITY_GRID_KM_S = 10
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearScorer:
    """Fixed coefficients of the deterministic pair scorer (intercept first)."""

    productive: tuple[float, ...] = (0.4, 0.9, 0.0, -0.01, -0.5)
    first_time_fix: tuple[float, ...] = (0.1, 0.7, 0.2, -0.008, -0.3)


@dataclass(frozen=True)
class DispatchRules:
    hard_max_km: float = HARD_MAX_DISTANCE_KM
    date_floor: str = "1995-06-01"
    scorer: LinearScorer = field(default_factory=LinearScorer)
    # Pools of up to this many technicians are searched whole.
    small_pool: int = 256
    # Search radii are powers of two, in km, from 1 to this one; beyond it the whole pool is searched.
    widest_level: int = 10
    # A date with more dispatches than this is split over several join keys.
    rows_per_salt: int = 250_000


DEFAULT_RULES = DispatchRules()
