"""Typed dispatch rows from raw ticket text, with validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _S, _D, _TS, _I, _B = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.BooleanType()

# Names, order and types of the dispatch table's 42 fields.
DISPATCH_FIELDS = (
    ("Dispatch_id", _L), ("Ticket_type", _S), ("Order_type", _S), ("Priority", _S), ("Required_skill", _S), ("Status", _S),
    ("Street", _S), ("City", _S), ("County", _S), ("State", _S), ("Postal_code", _L), ("Customer_latitude", _D),
    ("Customer_longitude", _D), ("Appointment_start_datetime", _TS), ("Appointment_end_datetime", _TS), ("Duration_min", _L),
    ("Assigned_technician_id", _S), ("Resolution_type", _S), ("Optimized_technician_id", _S), ("Optimized_technician_name", _S),
    ("Optimization_constraint_status", _S), ("Optimization_constraints_passed", _I), ("Optimized_score", _D),
    ("Optimized_distance_km", _D), ("Optimized_utilization", _D), ("Optimized_p_productive", _D), ("Optimized_p_ftf", _D),
    ("Optimized_quality_score", _D), ("Optimized_travel_cost", _D), ("Optimized_workload_cost", _D),
    ("Optimized_success_risk_cost", _D), ("Optimized_duration_cost", _D), ("Optimized_priority_weight", _D),
    ("Optimization_skill_match", _I), ("Optimization_capacity_available", _I), ("Optimization_calendar_available", _I),
    ("Optimization_distance_ok", _I), ("Optimization_status", _S), ("Optimization_timestamp", _TS),
    ("Optimization_confidence", _S), ("Optimization_reason", _S), ("All_constraints_met", _B),
)
DISPATCH_SCHEMA = T.StructType([T.StructField(n, t, n != "Dispatch_id") for n, t in DISPATCH_FIELDS])
TIME_FORMAT = "yyyy-MM-dd''T''HH:mm"
NEW_TICKET = {
    "Status": "'pending'",
    "County": "''",
    "Optimization_status": "'Pending'",
    "Optimization_reason": "'Pending'",
    "All_constraints_met": "false",
}
ERRORS = {
    "Street is required": "trim(coalesce(street, '')) = ''",
    "City is required": "trim(coalesce(city, '')) = ''",
    "Postal code is required": "trim(coalesce(postal_code, '')) = ''",
    "Invalid latitude/longitude": "try_cast(customer_latitude AS DOUBLE) IS NULL OR try_cast(customer_longitude AS DOUBLE) IS NULL",
    "Invalid date/time format (use YYYY-MM-DDTHH:MM)": "{start} IS NULL OR {end} IS NULL",
}


def parse_time(column: str) -> str:
    """``2025-11-12T08:30`` to a timestamp; anything else to NULL."""
    return f"try_to_timestamp({column}, '{TIME_FORMAT}')".replace("''T''", "\\'T\\'")


def with_errors(raw: DataFrame) -> DataFrame:
    """All validation errors of each raw ticket, in form order, as an array."""
    when = {m: c.format(start=parse_time("appointment_start"), end=parse_time("appointment_end")) for m, c in ERRORS.items()}
    items = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in when.items())
    return raw.selectExpr("*", f"array_compact(array({items})) AS errors")


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_errors(raw)
    return checked.filter("size(errors) = 0").drop("errors"), checked.filter("size(errors) > 0")


def typed_tickets(raw: DataFrame, id_column: str) -> DataFrame:
    """Raw text tickets as dispatch rows: casts, pending defaults, NULL results."""
    given = {
        "Dispatch_id": id_column,
        "Appointment_start_datetime": parse_time("appointment_start"),
        "Appointment_end_datetime": parse_time("appointment_end"),
        **NEW_TICKET,
    }
    have = {c.lower(): c for c in raw.columns}
    out = []
    for name, kind in DISPATCH_FIELDS:
        source = given.get(name) or have.get(name.lower(), "NULL")
        out.append(f"CAST({source} AS {kind.simpleString()}) AS {name}")
    return raw.selectExpr(*out)
