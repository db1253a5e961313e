"""Training rows, categorical codes and the 19-column feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.geo import haversine_km
from brightloom.functions.scoring import flag
from brightloom.session import broadcast_if_small

# Bin edges, labels, categorical columns and the order of the feature columns.
DURATION_BINS = ((0, 60, "short"), (60, 90, "medium"), (90, 120, "long"), (120, 999, "extra_long"))
DISTANCE_BINS = ((0, 10, "very_close"), (10, 25, "close"), (25, 50, "medium"), (50, 100, "far"), (100, 999, "very_far"))
CATEGORICAL = (
    "ticket_type", "order_type", "priority", "required_skill", "technician_skill", "dispatch_city", "technician_city",
    "duration_category", "distance_category",
)
FEATURES = (
    "distance_km", "skill_match", "city_match", "state_match", "workload_utilization", "appointment_hour",
    "appointment_day_of_week", "duration_min", "technician_workload_capacity", "technician_current_assignments",
    "ticket_type_encoded", "order_type_encoded", "priority_encoded", "required_skill_encoded", "technician_skill_encoded",
    "dispatch_city_encoded", "technician_city_encoded", "duration_category_encoded", "distance_category_encoded",
)
MISSING = "MISSING"
UNSEEN = -1

Encoders = dict[str, list[str]]


def technician_columns(technicians: DataFrame) -> DataFrame:
    return technicians.selectExpr(
        "technician_id AS tech_id", "name AS technician_name", "primary_skill AS technician_skill", "city AS technician_city",
        "state AS technician_state", "latitude AS technician_latitude", "longitude AS technician_longitude",
        "workload_capacity AS technician_workload_capacity", "current_assignments AS technician_current_assignments",
    )


def training_rows(history: DataFrame, technicians: DataFrame) -> DataFrame:
    """Labelled history with its technician; rows without both labels are left out."""
    labelled = history.dropna(subset=["productive_dispatch", "first_time_fix"])
    tech = broadcast_if_small(technician_columns(technicians))
    return labelled.join(tech, F.col("assigned_technician_id") == F.col("tech_id")).withColumnRenamed(
        "tech_id", "technician_id"
    ).drop("assigned_technician_id")


def binned(column: str, bins: tuple) -> str:
    """Right-closed bins; anything outside becomes the text ``nan``."""
    cases = " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{name}'" for lo, hi, name in bins)
    return f"CASE {cases} ELSE 'nan' END"


def with_raw_features(rows: DataFrame) -> DataFrame:
    km = haversine_km("technician_latitude", "technician_longitude", "customer_latitude", "customer_longitude")
    return rows.selectExpr(
        "*",
        f"{km} AS distance_km",
        f"{flag('required_skill = technician_skill')} AS skill_match",
        f"{flag('dispatch_city = technician_city')} AS city_match",
        f"{flag('dispatch_state = technician_state')} AS state_match",
        "try_divide(technician_current_assignments, technician_workload_capacity) AS workload_utilization",
        "hour(appointment_start) AS appointment_hour",
        "weekday(appointment_start) AS appointment_day_of_week",
        f"{binned('duration_min', DURATION_BINS)} AS duration_category",
    ).selectExpr("*", f"{binned('distance_km', DISTANCE_BINS)} AS distance_category")


def fit_encoders(rows: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> Encoders:
    """Sorted categories of every column, from one aggregate; they are model state, like a label indexer's."""
    found = rows.agg(*[F.expr(f"sort_array(collect_set(coalesce({c}, '{MISSING}'))) AS {c}") for c in columns]).first()
    return {c: list(found[c]) for c in columns}


def encoded(column: str, categories: list[str]) -> str:
    """0-based code; an unseen category gets -1."""
    if not categories:
        return str(UNSEEN)
    pairs = ", ".join("'{}', {}".format(v.replace("\\", "\\\\").replace("'", "\\'"), i) for i, v in enumerate(categories))
    return f"coalesce(try_element_at(map({pairs}), coalesce({column}, '{MISSING}')), {UNSEEN})"


def with_encoded(rows: DataFrame, encoders: Encoders) -> DataFrame:
    return rows.selectExpr("*", *[f"{encoded(c, v)} AS {c}_encoded" for c, v in encoders.items()])


def feature_matrix(rows: DataFrame, encoders: Encoders, keep: list[str]) -> DataFrame:
    """``keep`` plus the 19 features as doubles; missing numbers become -1."""
    raw = with_encoded(with_raw_features(rows), encoders)
    return raw.selectExpr(
        *keep, *[f"coalesce(nanvl(CAST({c} AS DOUBLE), -1D), -1D) AS {c}" for c in FEATURES if c not in keep]
    )


def feature_stats(matrix: DataFrame) -> DataFrame:
    """(feature, mean, std, min, max) from one aggregate, turned into rows."""
    stats = matrix.agg(
        *[
            F.expr(f"struct(avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max) AS {c}")
            for c in FEATURES
        ]
    )
    pairs = ", ".join(f"'{c}', {c}" for c in FEATURES)
    return stats.selectExpr(f"stack({len(FEATURES)}, {pairs}) AS (feature, s)").selectExpr(
        "feature", "s.mean AS mean", "s.std AS std", "s.min AS min", "s.max AS max"
    )
