"""Insight queries over the optimized table, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import adapters as A
from brightloom.operators import insights as I
from brightloom.plans.report import strategy_report, write_report
from brightloom.queries.base import optimized, query
from brightloom.queries.dispatch import num_sql, r4, r4s
from brightloom.queries.views_sql import view, with_views
from brightloom.session import fresh_path

REPORT_DATE = "2025-11-12"

view("shortage", "optimized", """
SELECT *, unassigned_rate * 3 + fallback_rate * 2 + CASE WHEN avg_distance_km > 30 THEN 1 ELSE 0 END AS problem_score FROM (
SELECT *, unassigned / CAST(total_dispatches AS DOUBLE) AS unassigned_rate, fallback_assignments / CAST(total_dispatches AS DOUBLE) AS fallback_rate FROM (
SELECT city, required_skill, count(*) AS total_dispatches, sum(CASE WHEN optimized_technician_id IS NULL THEN 1 ELSE 0 END) AS unassigned,
  sum(CASE WHEN all_constraints_met = FALSE THEN 1 ELSE 0 END) AS fallback_assignments, avg(optimized_distance_km) AS avg_distance_km,
  max(optimized_distance_km) AS max_distance_km, avg(optimized_utilization) AS avg_tech_utilization FROM optimized GROUP BY city, required_skill) a) b""")

WINDOW_SQL = """CASE WHEN hour(appointment_start) < 8 THEN 'Early (6-8 AM)' WHEN hour(appointment_start) < 12 THEN 'Morning (8-12 PM)'
  WHEN hour(appointment_start) < 16 THEN 'Afternoon (12-4 PM)' WHEN hour(appointment_start) < 20 THEN 'Evening (4-8 PM)' ELSE 'Late (8+ PM)' END"""
BAND_SQL = """CASE WHEN utilization < 0.4 THEN 'Under-utilized (<40%)' WHEN utilization < 0.7 THEN 'Well-balanced (40-70%)'
  WHEN utilization < 0.9 THEN 'High (70-90%)' ELSE 'Over-utilized (>90%)' END"""

view("hours", "optimized", f"""
SELECT {WINDOW_SQL} AS time_window, CAST(hour(appointment_start) AS INT) AS appointment_hour, count(*) AS total_dispatches,
  avg(optimized_distance_km) AS avg_distance_km, quantile_cont(optimized_distance_km, 0.9) AS p90_distance_km,
  sum(CASE WHEN all_constraints_met = FALSE THEN 1 ELSE 0 END) AS fallback_count, avg(p_productive) AS avg_productivity,
  avg(optimized_utilization) AS avg_utilization FROM optimized GROUP BY 1, 2""")

view("staff", "optimized technicians", f"""
SELECT a.*, t.name AS technician_name, t.primary_skill AS skill, t.city, t.workload_capacity AS capacity, {BAND_SQL} AS utilization_category FROM (
SELECT optimized_technician_id, count(*) AS assignments, avg(optimized_distance_km) AS avg_distance, sum(duration_min) AS total_duration_min,
  avg(p_productive) AS avg_productivity,
  arg_min_null(optimized_utilization, dispatch_id) AS utilization
  FROM optimized WHERE optimized_technician_id IS NOT NULL AND optimized_technician_id <> '' GROUP BY 1) a
LEFT JOIN technicians t ON a.optimized_technician_id = CAST(t.technician_id AS VARCHAR)""")

view("cost", "optimized", """
SELECT *, saved_minutes / 60 AS saved_hours, saved_minutes * CAST(0.75 AS DOUBLE) AS saved_cost FROM (
SELECT *, high_distance_count * (current_avg_distance_km - 25) * CAST(0.5 AS DOUBLE) AS saved_minutes FROM (
SELECT avg(optimized_distance_km) AS current_avg_distance_km, avg(travel_cost) AS current_avg_travel_cost,
  count(*) FILTER (WHERE optimized_distance_km > 40) AS high_distance_count, count(*) FILTER (WHERE all_constraints_met = FALSE) AS fallback_count,
  count(*) AS total_dispatches, count(*) FILTER (WHERE optimized_distance_km > 40) / CAST(count(*) AS DOUBLE) * 100 AS improvement_potential_pct FROM optimized) a) b""")

view("staffing", "staff", """
SELECT count(*) AS active, count(*) FILTER (WHERE utilization > 0.9) AS over_count, count(*) FILTER (WHERE utilization < 0.4) AS under_count,
  count(*) - count(*) FILTER (WHERE utilization > 0.9) - count(*) FILTER (WHERE utilization < 0.4) AS balanced_count,
  coalesce(CAST(sum(capacity - assignments) FILTER (WHERE utilization < 0.4) AS BIGINT), 0) AS spare_capacity,
  CAST(floor(coalesce(sum(assignments) FILTER (WHERE utilization > 0.9), 0) * CAST(0.15 AS DOUBLE)) AS INT) AS redistribute_15,
  coalesce(CAST(sum(CAST(floor(assignments * CAST(0.2 AS DOUBLE)) AS INT)) FILTER (WHERE utilization > 0.9) AS BIGINT), 0) AS redistribute_20 FROM staff""")

SHORT_COLS = ["city", "required_skill", "total_dispatches", "unassigned", "fallback_assignments"]
SHORT_NUM = ["avg_distance_km", "max_distance_km", "avg_tech_utilization", "unassigned_rate", "fallback_rate", "problem_score"]


@query("agg_skill_shortage", with_views("shortage", f"SELECT {', '.join(SHORT_COLS)}, {r4s(*SHORT_NUM)} FROM shortage"))
def agg_skill_shortage(spark: SparkSession, sf: str) -> DataFrame:
    return I.skill_shortage(optimized(spark, sf)).selectExpr(*SHORT_COLS, *r4(*SHORT_NUM))


@query("prj_problem_score", with_views("shortage", f"SELECT city, required_skill, {r4s('problem_score')} FROM shortage"))
def prj_problem_score(spark: SparkSession, sf: str) -> DataFrame:
    return I.skill_shortage(optimized(spark, sf)).selectExpr("city", "required_skill", *r4("problem_score"))


HOUR_COLS = ["time_window", "appointment_hour", "total_dispatches", "fallback_count"]
HOUR_NUM = ["avg_distance_km", "p90_distance_km", "avg_productivity", "avg_utilization"]


@query("agg_time_of_day", with_views("hours", f"SELECT {', '.join(HOUR_COLS)}, {r4s(*HOUR_NUM)} FROM hours"))
def agg_time_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return I.time_of_day(optimized(spark, sf), exact=True).selectExpr(*HOUR_COLS, *r4(*HOUR_NUM))


@query(
    "prj_time_window",
    with_views("dispatches", f"SELECT dispatch_id, {WINDOW_SQL} AS time_window FROM dispatches"),
)
def prj_time_window(spark: SparkSession, sf: str) -> DataFrame:
    return A.dispatches(spark, sf).selectExpr("dispatch_id", f"{I.TIME_WINDOW} AS time_window")


@query(
    "prj_utilization_band",
    with_views("technicians", f"SELECT technician_id, {BAND_SQL} AS band FROM (SELECT *, current_assignments / CAST(workload_capacity AS DOUBLE) AS utilization FROM technicians) t"),
)
def prj_utilization_band(spark: SparkSession, sf: str) -> DataFrame:
    from brightloom.functions.scoring import UTILIZATION

    return A.technicians(spark, sf).selectExpr("technician_id", f"{UTILIZATION} AS utilization").selectExpr(
        "technician_id", f"{I.UTILIZATION_BAND} AS band"
    )


STAFF_COLS = ["optimized_technician_id", "technician_name", "skill", "city", "assignments", "capacity", "total_duration_min", "utilization_category"]
STAFF_NUM = ["utilization", "avg_distance", "avg_productivity"]


@query("agg_tech_utilization", with_views("staff", f"SELECT {', '.join(STAFF_COLS)}, {r4s(*STAFF_NUM)} FROM staff"))
def agg_tech_utilization(spark: SparkSession, sf: str) -> DataFrame:
    return I.technician_utilization(optimized(spark, sf), A.technicians(spark, sf)).selectExpr(*STAFF_COLS, *r4(*STAFF_NUM))


@query(
    "join_tech_details",
    with_views("staff", "SELECT optimized_technician_id, technician_name, skill, city, capacity, assignments FROM staff"),
)
def join_tech_details(spark: SparkSession, sf: str) -> DataFrame:
    return I.technician_utilization(optimized(spark, sf), A.technicians(spark, sf)).select(
        "optimized_technician_id", "technician_name", "skill", "city", "capacity", "assignments"
    )


FAILURES = with_views("optimized", """SELECT city, required_skill, constraint_status, count(*) AS failure_count FROM optimized
    WHERE all_constraints_met = FALSE GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3""")


@query("agg_constraint_failures", FAILURES)
def agg_constraint_failures(spark: SparkSession, sf: str) -> DataFrame:
    return I.constraint_failures(optimized(spark, sf))


@query("sort_failures", FAILURES)
def sort_failures(spark: SparkSession, sf: str) -> DataFrame:
    return I.constraint_failures(optimized(spark, sf))


@query(
    "sort_hour",
    with_views("dispatches", "SELECT CAST(hour(appointment_start) AS INT) AS appointment_hour, count(*) AS n FROM dispatches GROUP BY 1 ORDER BY 1"),
)
def sort_hour(spark: SparkSession, sf: str) -> DataFrame:
    d = A.dispatches(spark, sf).selectExpr("hour(appointment_start) AS appointment_hour")
    return d.groupBy("appointment_hour").agg(F.expr("count(*) AS n")).orderBy("appointment_hour")


COST_COLS = ["high_distance_count", "fallback_count", "total_dispatches"]
COST_NUM = ["current_avg_distance_km", "current_avg_travel_cost", "improvement_potential_pct"]


@query("agg_cost_opportunity", with_views("cost", f"SELECT {', '.join(COST_COLS)}, {r4s(*COST_NUM)} FROM cost"))
def agg_cost_opportunity(spark: SparkSession, sf: str) -> DataFrame:
    return I.cost_opportunity(optimized(spark, sf)).selectExpr(*COST_COLS, *r4(*COST_NUM))


@query("agg_savings_estimate", with_views("cost", f"SELECT high_distance_count, {r4s('saved_minutes', 'saved_hours', 'saved_cost')} FROM cost"))
def agg_savings_estimate(spark: SparkSession, sf: str) -> DataFrame:
    cost = I.cost_opportunity(optimized(spark, sf))
    return I.savings_estimate(cost).selectExpr("high_distance_count", *r4("saved_minutes", "saved_hours", "saved_cost"))


@query("agg_staffing_summary", with_views("staffing", "SELECT * FROM staffing"))
def agg_staffing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.staffing_summary(I.technician_utilization(optimized(spark, sf), A.technicians(spark, sf)))


PCT = ["complete_pct", "all_met_pct", "fallback_pct", "pending_pct"]


@query(
    "agg_run_summary",
    with_views("optimized", f"""SELECT total, complete, all_met, fallback, pending, {', '.join(f"round({c} / CAST(total AS DOUBLE) * 100 + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS {c}_pct" for c in ('complete', 'all_met', 'fallback', 'pending'))}
    FROM (SELECT *, complete - all_met AS fallback, total - complete AS pending FROM (SELECT count(*) AS total, count(*) FILTER (WHERE optimization_status = 'Complete') AS complete,
    count(*) FILTER (WHERE all_constraints_met) AS all_met FROM optimized) a) b"""),
)
def agg_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.run_summary(optimized(spark, sf)).selectExpr("total", "complete", "all_met", "fallback", "pending", *r4(*PCT))


ACTION_SQL = """CASE WHEN problem_score <= 1 THEN NULL WHEN unassigned_rate * 100 > 20 THEN 'add' WHEN avg_distance_km > 35 THEN 'relocate'
  WHEN fallback_rate * 100 > 30 THEN 'capacity' END"""


@query(
    "top_shortages",
    with_views("shortage", f"""SELECT city, required_skill, {r4s('problem_score')}, {ACTION_SQL} AS action FROM
    (SELECT * FROM shortage ORDER BY problem_score DESC NULLS LAST, city, required_skill LIMIT 10) s"""),
)
def top_shortages(spark: SparkSession, sf: str) -> DataFrame:
    top = I.top_shortages(I.skill_shortage(optimized(spark, sf)), 10)
    return top.selectExpr("city", "required_skill", *r4("problem_score"), f"{I.shortage_action()} AS action")


@query(
    "top_peak_hours",
    with_views("hours", f"""SELECT appointment_hour, time_window, {r4s('avg_distance_km')}, CAST(floor(fallback_count / 20) AS INT) + 1 AS extra_technicians,
    round((avg_distance_km - 20) / avg_distance_km * 100 + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS improvement_pct FROM
    (SELECT * FROM hours ORDER BY avg_distance_km DESC NULLS LAST, appointment_hour LIMIT 3) s"""),
)
def top_peak_hours(spark: SparkSession, sf: str) -> DataFrame:
    return I.peak_hours(I.time_of_day(optimized(spark, sf))).selectExpr(
        "appointment_hour", "time_window", *r4("avg_distance_km"), "extra_technicians", *r4("improvement_pct")
    )


@query(
    "top_overutilized",
    with_views("staff", f"""SELECT optimized_technician_id, technician_name, {r4s('utilization')}, assignments, CAST(floor(assignments * CAST(0.2 AS DOUBLE)) AS INT) AS redistribute
    FROM staff WHERE utilization > 0.9 ORDER BY utilization DESC, optimized_technician_id LIMIT 5"""),
)
def top_overutilized(spark: SparkSession, sf: str) -> DataFrame:
    staff = I.technician_utilization(optimized(spark, sf), A.technicians(spark, sf))
    return I.over_utilized(staff).selectExpr(
        "optimized_technician_id", "technician_name", *r4("utilization"), "assignments", "redistribute"
    )


def _lines_sql(src: str, section: int, order: str, texts: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {section} AS section, CAST({order} AS INT) * 100 + {i} AS rank, {t} AS line FROM {src}" for i, t in enumerate(texts)
    )


N = num_sql
REPORT_SQL = with_views(
    "shortage hours staff cost staffing",
    f"""WITH top AS (SELECT *, row_number() OVER (ORDER BY problem_score DESC, city, required_skill) AS place FROM shortage QUALIFY place <= 5),
    crit AS (SELECT * FROM top WHERE problem_score > 1), worst AS (SELECT * FROM top WHERE place = 1),
    peaks AS (SELECT *, CAST(floor(fallback_count / 20) AS INT) + 1 AS extra, (avg_distance_km - 20) / avg_distance_km * 100 AS improvement_pct,
      row_number() OVER (ORDER BY avg_distance_km DESC, appointment_hour) AS place FROM hours QUALIFY place <= 3),
    peak AS (SELECT * FROM peaks WHERE place = 1),
    overs AS (SELECT *, row_number() OVER (ORDER BY utilization DESC, optimized_technician_id) AS place FROM staff WHERE utilization > 0.9 QUALIFY place <= 5)
    SELECT * FROM ("""
    + " UNION ALL ".join([
        _lines_sql("cost", 0, "0", [
            "'STRATEGIC DISPATCH OPTIMIZATION MEMO'", "'Executive Summary & Recommendations'", f"'Date: {REPORT_DATE}'",
            "'Analysis Period: Current dispatch backlog (' || total_dispatches || ' dispatches)'", "'SECTION 1: GEOGRAPHIC SKILL SHORTAGE ANALYSIS'"]),
        _lines_sql("(SELECT count(*) AS n_top FROM top)", 1, "0", [
            "CASE WHEN n_top > 0 THEN 'CRITICAL SHORTAGE AREAS:' ELSE 'No critical geographic skill shortages identified' END"]),
        _lines_sql("crit", 1, "place", [
            "'City: ' || city || ' | Skill: ' || required_skill",
            f"total_dispatches || ' dispatches | ' || {N('unassigned_rate * 100', 0)} || '% unassigned | ' || {N('fallback_rate * 100', 0)} || '% fallback'",
            f"'Average travel: ' || {N('avg_distance_km', 1)} || ' km'",
            f"""CASE {ACTION_SQL} WHEN 'add' THEN 'RECOMMENDATION: Add 2-3 ''' || required_skill || ''' technicians in ' || city
              WHEN 'relocate' THEN 'RECOMMENDATION: Relocate 1 ''' || required_skill || ''' tech to ' || city
              WHEN 'capacity' THEN 'RECOMMENDATION: Increase capacity or shift schedules for ''' || required_skill || ''' in ' || city END""",
            f"""CASE {ACTION_SQL} WHEN 'add' THEN 'Expected impact: Reduce unassigned rate from ' || {N('unassigned_rate * 100', 0)} || '% to <10%'
              WHEN 'relocate' THEN 'Expected impact: Reduce avg travel from ' || {N('avg_distance_km', 1)} || ' km to ~20 km (save ~' || {N('(avg_distance_km - 20) * CAST(0.5 AS DOUBLE)', 0)} || ' min/dispatch)'
              WHEN 'capacity' THEN 'Expected impact: Improve constraint satisfaction from ' || {N('100 - fallback_rate * 100', 0)} || '% to >85%' END"""]),
        _lines_sql("cost", 2, "0", ["'SECTION 2: TIME-OF-DAY TRAVEL PATTERN ANALYSIS'", "'PEAK TRAVEL DISTANCE WINDOWS:'"]),
        _lines_sql("peaks", 2, "place", [
            "time_window || ' (' || appointment_hour || ':00)'",
            f"total_dispatches || ' dispatches | Avg distance: ' || {N('avg_distance_km', 1)} || ' km'",
            f"'P90 distance: ' || {N('p90_distance_km', 1)} || ' km | ' || fallback_count || ' fallback assignments'",
            "CASE WHEN avg_distance_km > 30 THEN 'RECOMMENDATION: Add ' || extra || ' technicians during ' || time_window END",
            f"CASE WHEN avg_distance_km > 30 THEN 'Expected impact: Reduce travel distance by ~' || {N('improvement_pct', 0)} || '% (save ' || {N('improvement_pct * CAST(0.5 AS DOUBLE)', 0)} || ' min avg/dispatch)' END"]),
        _lines_sql("staffing", 3, "0", [
            "'SECTION 3: TECHNICIAN WORKFORCE UTILIZATION'", "'UTILIZATION SUMMARY:'",
            "'Total active technicians: ' || active", "'Over-utilized (>90%): ' || over_count || ' technicians'",
            "'Under-utilized (<40%): ' || under_count || ' technicians'", "'Well-balanced (40-90%): ' || balanced_count || ' technicians'",
            "CASE WHEN over_count > 0 THEN 'OVER-UTILIZED TECHNICIANS (Risk of burnout):' END"]),
        _lines_sql("overs", 4, "place", [
            "technician_name || ' (' || optimized_technician_id || ') - ' || city",
            f"'Utilization: ' || {N('utilization * 100', 0)} || '% | ' || assignments || ' assignments | Skill: ' || skill",
            "'RECOMMENDATION: Redistribute ' || CAST(floor(assignments * CAST(0.2 AS DOUBLE)) AS INT) || ' assignments to under-utilized techs'"]),
        _lines_sql("(SELECT * FROM staffing WHERE under_count > 0)", 5, "0", [
            "'UNDER-UTILIZED TECHNICIANS (Capacity opportunity):'", "under_count || ' technicians with spare capacity'",
            "'Total spare capacity: ~' || spare_capacity || ' additional dispatches possible'",
            "'RECOMMENDATION: Cross-train or relocate to shortage areas identified in Section 1'"]),
        _lines_sql("cost", 6, "0", [
            "'SECTION 4: COST OPTIMIZATION OPPORTUNITIES'", "'CURRENT STATE:'", f"'Average travel distance: ' || {N('current_avg_distance_km', 1)} || ' km'",
            f"'High-distance dispatches (>40 km): ' || high_distance_count || ' (' || {N('improvement_potential_pct', 1)} || '%)'",
            f"'Fallback assignments: ' || fallback_count || ' (' || {N('fallback_count / CAST(total_dispatches AS DOUBLE) * 100', 1)} || '%)'",
            "'OPTIMIZATION POTENTIAL:'",
            f"'Potential time savings: ~' || {N('saved_hours', 0)} || ' hours/week'", f"'Estimated cost reduction: ~$' || {N('saved_cost', 0)} || '/week'",
            "'Fallback improvement potential: ' || fallback_count || ' dispatches could meet all constraints'"]),
        _lines_sql("cost", 7, "0", ["'SECTION 5: TOP PRIORITY EXECUTIVE ACTIONS'", "'1. IMMEDIATE (Week 1-2):'"]),
        _lines_sql("worst", 8, "0", [
            "'Add 2-3 ''' || required_skill || ''' technicians in ' || city",
            f"'Impact: Address ' || total_dispatches || ' dispatches, reduce unassigned from ' || {N('unassigned_rate * 100', 0)} || '% to <10%'"]),
        _lines_sql("(SELECT * FROM staffing WHERE over_count > 0 AND under_count > 0)", 9, "0", [
            "'Redistribute ~' || redistribute_15 || ' assignments from over-utilized to under-utilized techs'",
            "'Impact: Balance workload, prevent burnout, utilize spare capacity'"]),
        _lines_sql("cost", 10, "0", ["'2. SHORT-TERM (Month 1-2):'"]),
        _lines_sql("peak", 11, "0", [
            "'Adjust schedules to add ' || extra || ' technicians during ' || time_window",
            f"'Impact: Reduce travel by ' || {N('improvement_pct', 0)} || '%, improve ' || fallback_count || ' assignments'"]),
        _lines_sql("cost", 12, "0", [
            "CASE WHEN high_distance_count > 50 THEN 'Relocate or hire technicians in high-distance areas' END",
            f"CASE WHEN high_distance_count > 50 THEN 'Impact: Save ~' || {N('saved_hours', 0)} || ' hours/week, $' || {N('saved_cost', 0)} || '/week' END",
            "'3. STRATEGIC (Quarter 1-2):'"]),
        _lines_sql("staffing", 13, "0", [
            "'Cross-train ' || under_count || ' under-utilized technicians in shortage skills'",
            "'Implement dynamic scheduling based on time-of-day demand patterns'",
            "'Review and adjust capacity limits for consistently over-utilized technicians'"]),
        _lines_sql("cost", 14, "0", ["'END OF STRATEGIC MEMO'"]),
    ])
    + ") q WHERE line IS NOT NULL",
)


@query("agg_report", REPORT_SQL)
def agg_report(spark: SparkSession, sf: str) -> DataFrame:
    return strategy_report(optimized(spark, sf), A.technicians(spark, sf), REPORT_DATE)


@query("pipe_insights", REPORT_SQL)
def pipe_insights(spark: SparkSession, sf: str) -> DataFrame:
    # the whole flow from the stored result table to stored lines
    path = fresh_path(spark, "insights")
    strategy_report(optimized(spark, sf), A.technicians(spark, sf), REPORT_DATE).write.parquet(path)
    return spark.read.parquet(path)


@query("sink_report_text", REPORT_SQL.replace("SELECT * FROM (SELECT 0 AS section", "SELECT line AS value FROM (SELECT 0 AS section"))
def sink_report_text(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "report")
    write_report(strategy_report(optimized(spark, sf), A.technicians(spark, sf), REPORT_DATE), path)
    return spark.read.text(path)
