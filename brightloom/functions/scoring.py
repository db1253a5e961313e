"""Constraint flags, soft costs and scores of a (dispatch, technician) pair.

Every rule is one SQL expression over named columns. ``score_pairs`` stacks them in a few
projections, which Spark runs inside one codegen span: no join, no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brightloom import config as C
from brightloom.functions.geo import haversine_km

Scorer = Callable[[DataFrame], DataFrame]


def flag(condition: str) -> str:
    """1 when true, 0 when false or unknown."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def pair_distance(missing: str = f"{C.MISSING_DISTANCE_KM}D") -> str:
    """Pair distance; ``missing`` stands in when a latitude is NULL."""
    km = haversine_km("latitude", "longitude", "customer_latitude", "customer_longitude")
    return f"CASE WHEN latitude IS NOT NULL AND customer_latitude IS NOT NULL THEN {km} ELSE {missing} END"


CONSTRAINT_FLAGS = {
    "has_date": flag("date IS NOT NULL"),
    "skill_match": flag("required_skill = primary_skill"),
    "capacity_available": flag("current_assignments < workload_capacity"),
    "calendar_available": flag("available = 1"),
    "distance_km": pair_distance(),
}

CONSTRAINT_LEVEL = """CASE WHEN has_date = 0 THEN 'NO_DATE_MATCH'
  WHEN skill_match = 0 THEN 'FAILED_SKILL'
  WHEN capacity_available = 0 THEN 'FAILED_CAPACITY'
  WHEN calendar_available = 0 THEN 'FAILED_AVAILABILITY'
  WHEN distance_ok = 0 THEN 'FAILED_DISTANCE'
  ELSE 'ALL_CONSTRAINTS_MET' END"""

CONSTRAINTS_PASSED = "has_date + skill_match + capacity_available + calendar_available + distance_ok"

UTILIZATION = "CASE WHEN workload_capacity > 0 THEN current_assignments / workload_capacity ELSE 0D END"


def level_rank(column: str = "constraint_level") -> str:
    cases = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(C.CONSTRAINT_LEVELS, 1))
    return f"CASE {column} {cases} ELSE {len(C.CONSTRAINT_LEVELS)} END"


def travel_cost(km: str = "distance_km") -> str:
    return (
        f"{C.TRAVEL_BASE_COST}D * {km} + "
        f"{C.TRAVEL_PENALTY_MULTIPLIER}D * greatest(0D, {km} - {C.TRAVEL_PENALTY_THRESHOLD_KM}D)"
    )


def least_travel_cost(km: float) -> float:
    """What any technician farther away than ``km`` costs in travel, at the least."""
    return C.TRAVEL_BASE_COST * km + C.TRAVEL_PENALTY_MULTIPLIER * max(0.0, km - C.TRAVEL_PENALTY_THRESHOLD_KM)


def reach_of(cost: str) -> str:
    """The distance in km beyond which travel alone costs more than ``cost``."""
    base, steep = C.TRAVEL_BASE_COST, C.TRAVEL_BASE_COST + C.TRAVEL_PENALTY_MULTIPLIER
    bend, knee = C.TRAVEL_PENALTY_THRESHOLD_KM, C.TRAVEL_BASE_COST * C.TRAVEL_PENALTY_THRESHOLD_KM
    return f"CASE WHEN {cost} <= {knee}D THEN greatest(0D, {cost} / {base}D) ELSE {bend}D + ({cost} - {knee}D) / {steep}D END"


def workload_cost(u: str = "utilization") -> str:
    return (
        f"CASE WHEN {u} < {C.UNDERUTIL_THRESHOLD}D THEN {C.UNDERUTIL_PENALTY}D * ({C.UNDERUTIL_THRESHOLD}D - {u}) "
        f"WHEN {u} > {C.OVERUTIL_THRESHOLD}D THEN {C.OVERUTIL_PENALTY}D * ({u} - {C.OVERUTIL_THRESHOLD}D) ELSE 0D END"
    )


QUALITY_SCORE = f"{C.SUCCESS_WEIGHT}D * p_productive + {C.FTF_WEIGHT}D * p_ftf"
RISK_COST = f"{C.RISK_COST_MULTIPLIER}D * (1 - quality_score)"


def duration_cost(minutes: str = "duration_min") -> str:
    return f"{C.DURATION_COST_FACTOR}D * {minutes}"


def priority_weight(priority: str = "priority") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in C.PRIORITY_WEIGHTS.items())
    return f"CASE {priority} {cases} ELSE 1D END"


def sigmoid(s: str) -> str:
    return f"1 / (1 + exp(-({s})))"


def linear_scorer(coefficients: C.LinearScorer = C.LinearScorer()) -> Scorer:
    """Deterministic success scorer with fixed coefficients; takes the slot of a trained model."""
    km = f"CASE WHEN distance_km = {C.MISSING_DISTANCE_KM}D THEN -1D ELSE distance_km END"
    inputs = ("skill_match", flag("city = tech_city"), km, UTILIZATION)

    def p(w: tuple[float, ...]) -> str:
        terms = [f"{w[0]}D"] + [f"({weight}D) * ({x})" for weight, x in zip(w[1:], inputs) if weight]
        return sigmoid(" + ".join(terms))

    def score(pairs: DataFrame) -> DataFrame:
        return pairs.selectExpr(
            "*", f"{p(coefficients.productive)} AS p_productive", f"{p(coefficients.first_time_fix)} AS p_ftf"
        )

    # skill, city, distance and utilization decide, a match never harms and distance never helps
    score.by_profile = all(w[1] >= 0 and w[2] >= 0 and w[3] <= 0 for w in (coefficients.productive, coefficients.first_time_fix))
    return score


def default_scores(pairs: DataFrame) -> DataFrame:
    """Missing probabilities count as 0.5."""
    return pairs.fillna(0.5, ["p_productive", "p_ftf"])


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def with_constraint_flags(pairs: DataFrame, hard_max_km: float = C.HARD_MAX_DISTANCE_KM) -> DataFrame:
    """has_date, skill, capacity, calendar and distance flags from calendar and technician columns."""
    return add(add(pairs, CONSTRAINT_FLAGS), {"distance_ok": flag(f"distance_km <= {hard_max_km}D")})


def with_levels(flagged: DataFrame) -> DataFrame:
    return add(flagged, {"constraint_level": CONSTRAINT_LEVEL, "constraints_passed": CONSTRAINTS_PASSED})


def with_costs(pairs: DataFrame) -> DataFrame:
    """Travel, workload, risk and duration costs, priority weight and the final scores."""
    pairs = add(pairs, {"utilization": UTILIZATION, "quality_score": QUALITY_SCORE})
    pairs = add(
        pairs,
        {
            "travel_cost": travel_cost(),
            "workload_cost": workload_cost(),
            "success_risk_cost": RISK_COST,
            "duration_cost": duration_cost(),
            "priority_weight": priority_weight(),
        },
    )
    pairs = add(pairs, {"base_job_cost": "travel_cost + workload_cost + success_risk_cost + duration_cost"})
    pairs = add(
        pairs,
        {
            "final_cost": "base_job_cost * priority_weight",
            "constraint_penalty": f"(5 - constraints_passed) * {C.CONSTRAINT_PENALTY}D",
        },
    )
    return add(
        pairs,
        {"final_score": "-final_cost", "final_score_with_penalty": "-(final_cost + constraint_penalty)"},
    )


def profile_cost(technicians: DataFrame, scorer: Scorer, name: str, skill_match: int = 1, city_match: int = 1, km: float = 0.0) -> DataFrame:
    """Add ``name``: what each technician costs besides travel and duration, for a job with these matches and distance.

    With the defaults no job costs less, if the scorer decides by profile; success counts as
    certain for any other scorer.
    """
    columns = technicians.columns
    if not getattr(scorer, "by_profile", False):
        return add(add(technicians, {"utilization": UTILIZATION}), {name: workload_cost()}).select(*columns, name)
    given = add(technicians, {"skill_match": str(skill_match), "city": "tech_city" if city_match else "CAST(NULL AS STRING)", "distance_km": f"{km}D"})
    scored = add(default_scores(scorer(given)), {"utilization": UTILIZATION, "quality_score": QUALITY_SCORE})
    return add(scored, {name: f"{workload_cost()} + {RISK_COST}"}).select(*columns, name)


def score_pairs(pairs: DataFrame, scorer: Scorer, hard_max_km: float = C.HARD_MAX_DISTANCE_KM) -> DataFrame:
    """Flags, level, probabilities, costs and scores of each pair row."""
    return with_costs(default_scores(scorer(with_levels(with_constraint_flags(pairs, hard_max_km)))))
