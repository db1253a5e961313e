"""Aggregates over the optimized table: shortages, hours, staffing, failures, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bands and rates of the reports.
TIME_WINDOW = """CASE WHEN hour(appointment_start) < 8 THEN 'Early (6-8 AM)' WHEN hour(appointment_start) < 12 THEN 'Morning (8-12 PM)'
  WHEN hour(appointment_start) < 16 THEN 'Afternoon (12-4 PM)' WHEN hour(appointment_start) < 20 THEN 'Evening (4-8 PM)'
  ELSE 'Late (8+ PM)' END"""
UTILIZATION_BAND = """CASE WHEN utilization < 0.4D THEN 'Under-utilized (<40%)' WHEN utilization < 0.7D THEN 'Well-balanced (40-70%)'
  WHEN utilization < 0.9D THEN 'High (70-90%)' ELSE 'Over-utilized (>90%)' END"""
HIGH_KM = 40
_FALLBACK = "sum(CASE WHEN all_constraints_met = false THEN 1 ELSE 0 END)"


def exprs(**named: str) -> list:
    return [F.expr(f"{sql} AS {name}") for name, sql in named.items()]


def skill_shortage(optimized: DataFrame) -> DataFrame:
    """Per city and skill: load, unassigned, fallbacks, distance, utilisation and the problem score."""
    grouped = optimized.groupBy("city", "required_skill").agg(
        *exprs(
            total_dispatches="count(*)",
            unassigned="sum(CASE WHEN optimized_technician_id IS NULL THEN 1 ELSE 0 END)",
            fallback_assignments=_FALLBACK,
            avg_distance_km="avg(optimized_distance_km)",
            max_distance_km="max(optimized_distance_km)",
            avg_tech_utilization="avg(optimized_utilization)",
        )
    )
    return grouped.selectExpr(
        "*", "try_divide(unassigned, total_dispatches) AS unassigned_rate",
        "try_divide(fallback_assignments, total_dispatches) AS fallback_rate",
    ).selectExpr(
        "*", "unassigned_rate * 3 + fallback_rate * 2 + CASE WHEN avg_distance_km > 30 THEN 1 ELSE 0 END AS problem_score"
    )


def time_of_day(optimized: DataFrame, exact: bool = False) -> DataFrame:
    """Per time window and hour; the 90th percentile is approximate unless ``exact``."""
    p90 = "percentile(optimized_distance_km, 0.9)" if exact else "percentile_approx(optimized_distance_km, 0.9D, 10000)"
    return (
        optimized.selectExpr("*", f"{TIME_WINDOW} AS time_window", "hour(appointment_start) AS appointment_hour")
        .groupBy("time_window", "appointment_hour")
        .agg(
            *exprs(
                total_dispatches="count(*)",
                avg_distance_km="avg(optimized_distance_km)",
                p90_distance_km=p90,
                fallback_count=_FALLBACK,
                avg_productivity="avg(p_productive)",
                avg_utilization="avg(optimized_utilization)",
            )
        )
        .orderBy("appointment_hour")
    )


def technician_utilization(optimized: DataFrame, technicians: DataFrame) -> DataFrame:
    """Per assigned technician, with details and band. The aggregate shrinks the data before the join."""
    per_tech = (
        optimized.filter("optimized_technician_id IS NOT NULL AND optimized_technician_id <> ''")
        .groupBy("optimized_technician_id")
        .agg(
            *exprs(
                assignments="count(*)",
                avg_distance="avg(optimized_distance_km)",
                total_duration_min="sum(duration_min)",
                avg_productivity="avg(p_productive)",
                utilization="min_by(optimized_utilization, dispatch_id)",
            )
        )
    )
    details = technicians.selectExpr(
        "CAST(technician_id AS STRING) AS optimized_technician_id", "name AS technician_name", "primary_skill AS skill",
        "city", "workload_capacity AS capacity",
    )
    return per_tech.join(details, "optimized_technician_id", "left").selectExpr(
        "optimized_technician_id", "technician_name", "skill", "city", "assignments", "capacity", "utilization",
        "avg_distance", "total_duration_min", "avg_productivity", f"{UTILIZATION_BAND} AS utilization_category",
    )


def constraint_failures(optimized: DataFrame) -> DataFrame:
    return (
        optimized.filter("all_constraints_met = false")
        .groupBy("city", "required_skill", "constraint_status")
        .agg(F.expr("count(*) AS failure_count"))
        .orderBy(F.desc("failure_count"), "city", "required_skill", "constraint_status")
    )


def cost_opportunity(optimized: DataFrame) -> DataFrame:
    """All cost figures in one pass."""
    return optimized.agg(
        *exprs(
            current_avg_distance_km="avg(optimized_distance_km)",
            current_avg_travel_cost="avg(travel_cost)",
            high_distance_count=f"count_if(optimized_distance_km > {HIGH_KM})",
            fallback_count="count_if(all_constraints_met = false)",
            total_dispatches="count(*)",
            improvement_potential_pct=f"try_divide(count_if(optimized_distance_km > {HIGH_KM}), count(*)) * 100",
        )
    )


def run_summary(optimized: DataFrame) -> DataFrame:
    """Totals and shares of a run in one conditional aggregate."""
    counts = optimized.agg(
        *exprs(
            total="count(*)",
            complete="count_if(optimization_status = 'Complete')",
            all_met="count_if(all_constraints_met)",
        )
    )
    return counts.selectExpr("*", "complete - all_met AS fallback", "total - complete AS pending").selectExpr(
        "*", *[f"try_divide({c}, total) * 100 AS {c}_pct" for c in ("complete", "all_met", "fallback", "pending")]
    )


def top_shortages(shortage: DataFrame, k: int = 10) -> DataFrame:
    return shortage.orderBy(F.desc_nulls_last("problem_score"), "city", "required_skill").limit(k)


def shortage_action() -> str:
    """Which recommendation a shortage row gets, if any."""
    return """CASE WHEN problem_score <= 1 THEN NULL WHEN unassigned_rate * 100 > 20 THEN 'add'
      WHEN avg_distance_km > 35 THEN 'relocate' WHEN fallback_rate * 100 > 30 THEN 'capacity' END"""


def peak_hours(hours: DataFrame, k: int = 3) -> DataFrame:
    return (
        hours.orderBy(F.desc_nulls_last("avg_distance_km"), "appointment_hour")
        .limit(k)
        .selectExpr(
            "*", "CAST(fallback_count / 20 AS INT) + 1 AS extra_technicians",
            "try_divide(avg_distance_km - 20, avg_distance_km) * 100 AS improvement_pct",
        )
    )


def over_utilized(utilization: DataFrame, k: int = 5) -> DataFrame:
    return (
        utilization.filter("utilization > 0.9D")
        .orderBy(F.desc("utilization"), "optimized_technician_id")
        .limit(k)
        .selectExpr("*", "CAST(assignments * 0.2D AS INT) AS redistribute")
    )


def staffing_summary(utilization: DataFrame) -> DataFrame:
    over, under = "utilization > 0.9D", "utilization < 0.4D"
    return utilization.agg(
        *exprs(
            active="count(*)",
            over_count=f"count_if({over})",
            under_count=f"count_if({under})",
            balanced_count=f"count(*) - count_if({over}) - count_if({under})",
            spare_capacity=f"coalesce(sum(CASE WHEN {under} THEN capacity - assignments END), 0)",
            redistribute_15=f"CAST(coalesce(sum(CASE WHEN {over} THEN assignments END), 0) * 0.15D AS INT)",
            redistribute_20=f"coalesce(sum(CASE WHEN {over} THEN CAST(assignments * 0.2D AS INT) END), 0)",
        )
    )


def savings_estimate(cost: DataFrame) -> DataFrame:
    return cost.selectExpr(
        "*", "high_distance_count * (current_avg_distance_km - 25) * 0.5D AS saved_minutes"
    ).selectExpr("*", "saved_minutes / 60 AS saved_hours", "saved_minutes * 0.75D AS saved_cost")
