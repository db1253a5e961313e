"""The strategy report as ordered lines: a DataFrame of (section, rank, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.wording import num
from brightloom.operators import insights as I


def _lines(df: DataFrame, section: int, order: str, texts: list[str]) -> DataFrame:
    """``texts`` become lines per row; NULL lines are left out. ``order`` ranks the rows."""
    rows = ", ".join(f"named_struct('pos', {i}, 'line', {t})" for i, t in enumerate(texts))
    return (
        df.selectExpr(f"{order} AS ord", f"inline(array({rows}))")
        .filter("line IS NOT NULL")
        .selectExpr(f"{section} AS section", "CAST(ord AS INT) * 100 + pos AS rank", "line")
    )


def _ranked(df: DataFrame, order: str) -> DataFrame:
    # only ever over a top-k of at most five rows
    return df.selectExpr("*", f"row_number() OVER (ORDER BY {order}) AS place")


def strategy_report(optimized: DataFrame, technicians: DataFrame, date: str, exact: bool = True) -> DataFrame:
    """All sections, from five aggregates of the optimized table."""
    shortage = _ranked(I.top_shortages(I.skill_shortage(optimized), 5), "problem_score DESC, city, required_skill")
    peaks = _ranked(I.peak_hours(I.time_of_day(optimized, exact=exact), 3), "avg_distance_km DESC, appointment_hour")
    staff = I.technician_utilization(optimized, technicians)
    over = _ranked(I.over_utilized(staff, 5), "utilization DESC, optimized_technician_id")
    counts = I.staffing_summary(staff)
    cost = I.savings_estimate(I.cost_opportunity(optimized))
    action = I.shortage_action()
    impact = f"""CASE {action}
        WHEN 'add' THEN concat('Expected impact: Reduce unassigned rate from ', {num('unassigned_rate * 100', 0)}, '% to <10%')
        WHEN 'relocate' THEN concat('Expected impact: Reduce avg travel from ', {num('avg_distance_km', 1)}, ' km to ~20 km (save ~',
            {num('(avg_distance_km - 20) * 0.5', 0)}, ' min/dispatch)')
        WHEN 'capacity' THEN concat('Expected impact: Improve constraint satisfaction from ', {num('100 - fallback_rate * 100', 0)}, '% to >85%') END"""
    savings = f"'Impact: Save ~', {num('saved_hours', 0)}, ' hours/week, $', {num('saved_cost', 0)}, '/week'"
    # Headings and sentences of the report, in its order.
    parts = [
        _lines(
            cost, 0, "0",
            [
                "'STRATEGIC DISPATCH OPTIMIZATION MEMO'",
                "'Executive Summary & Recommendations'",
                f"'Date: {date}'",
                "concat('Analysis Period: Current dispatch backlog (', total_dispatches, ' dispatches)')",
                "'SECTION 1: GEOGRAPHIC SKILL SHORTAGE ANALYSIS'",
            ],
        ),
        _lines(
            shortage.selectExpr("count(*) AS n_top"), 1, "0",
            ["CASE WHEN n_top > 0 THEN 'CRITICAL SHORTAGE AREAS:' ELSE 'No critical geographic skill shortages identified' END"],
        ),
        _lines(
            shortage.filter("problem_score > 1"), 1, "place",
            [
                "concat('City: ', city, ' | Skill: ', required_skill)",
                f"""concat(total_dispatches, ' dispatches | ', {num('unassigned_rate * 100', 0)}, '% unassigned | ',
                    {num('fallback_rate * 100', 0)}, '% fallback')""",
                f"concat('Average travel: ', {num('avg_distance_km', 1)}, ' km')",
                f"""CASE {action}
                    WHEN 'add' THEN concat('RECOMMENDATION: Add 2-3 \\'', required_skill, '\\' technicians in ', city)
                    WHEN 'relocate' THEN concat('RECOMMENDATION: Relocate 1 \\'', required_skill, '\\' tech to ', city)
                    WHEN 'capacity' THEN concat('RECOMMENDATION: Increase capacity or shift schedules for \\'', required_skill, '\\' in ', city) END""",
                impact,
            ],
        ),
        _lines(cost, 2, "0", ["'SECTION 2: TIME-OF-DAY TRAVEL PATTERN ANALYSIS'", "'PEAK TRAVEL DISTANCE WINDOWS:'"]),
        _lines(
            peaks, 2, "place",
            [
                "concat(time_window, ' (', appointment_hour, ':00)')",
                f"concat(total_dispatches, ' dispatches | Avg distance: ', {num('avg_distance_km', 1)}, ' km')",
                f"concat('P90 distance: ', {num('p90_distance_km', 1)}, ' km | ', fallback_count, ' fallback assignments')",
                """CASE WHEN avg_distance_km > 30 THEN
                    concat('RECOMMENDATION: Add ', extra_technicians, ' technicians during ', time_window) END""",
                f"""CASE WHEN avg_distance_km > 30 THEN concat('Expected impact: Reduce travel distance by ~',
                    {num('improvement_pct', 0)}, '% (save ', {num('improvement_pct * 0.5', 0)}, ' min avg/dispatch)') END""",
            ],
        ),
        _lines(
            counts, 3, "0",
            [
                "'SECTION 3: TECHNICIAN WORKFORCE UTILIZATION'",
                "'UTILIZATION SUMMARY:'",
                "concat('Total active technicians: ', active)",
                "concat('Over-utilized (>90%): ', over_count, ' technicians')",
                "concat('Under-utilized (<40%): ', under_count, ' technicians')",
                "concat('Well-balanced (40-90%): ', balanced_count, ' technicians')",
                "CASE WHEN over_count > 0 THEN 'OVER-UTILIZED TECHNICIANS (Risk of burnout):' END",
            ],
        ),
        _lines(
            over, 4, "place",
            [
                "concat(technician_name, ' (', optimized_technician_id, ') - ', city)",
                f"concat('Utilization: ', {num('utilization * 100', 0)}, '% | ', assignments, ' assignments | Skill: ', skill)",
                "concat('RECOMMENDATION: Redistribute ', redistribute, ' assignments to under-utilized techs')",
            ],
        ),
        _lines(
            counts.filter("under_count > 0"), 5, "0",
            [
                "'UNDER-UTILIZED TECHNICIANS (Capacity opportunity):'",
                "concat(under_count, ' technicians with spare capacity')",
                "concat('Total spare capacity: ~', spare_capacity, ' additional dispatches possible')",
                "'RECOMMENDATION: Cross-train or relocate to shortage areas identified in Section 1'",
            ],
        ),
        _lines(
            cost, 6, "0",
            [
                "'SECTION 4: COST OPTIMIZATION OPPORTUNITIES'",
                "'CURRENT STATE:'",
                f"concat('Average travel distance: ', {num('current_avg_distance_km', 1)}, ' km')",
                f"""concat('High-distance dispatches (>40 km): ', high_distance_count, ' (', {num('improvement_potential_pct', 1)}, '%)')""",
                f"concat('Fallback assignments: ', fallback_count, ' (', {num('try_divide(fallback_count, total_dispatches) * 100', 1)}, '%)')",
                "'OPTIMIZATION POTENTIAL:'",
                f"concat('Potential time savings: ~', {num('saved_hours', 0)}, ' hours/week')",
                f"concat('Estimated cost reduction: ~$', {num('saved_cost', 0)}, '/week')",
                "concat('Fallback improvement potential: ', fallback_count, ' dispatches could meet all constraints')",
            ],
        ),
        _lines(cost, 7, "0", ["'SECTION 5: TOP PRIORITY EXECUTIVE ACTIONS'", "'1. IMMEDIATE (Week 1-2):'"]),
        _lines(
            shortage.filter("place = 1"), 8, "0",
            [
                "concat('Add 2-3 \\'', required_skill, '\\' technicians in ', city)",
                f"concat('Impact: Address ', total_dispatches, ' dispatches, reduce unassigned from ', {num('unassigned_rate * 100', 0)}, '% to <10%')",
            ],
        ),
        _lines(
            counts.filter("over_count > 0 AND under_count > 0"), 9, "0",
            [
                "concat('Redistribute ~', redistribute_15, ' assignments from over-utilized to under-utilized techs')",
                "'Impact: Balance workload, prevent burnout, utilize spare capacity'",
            ],
        ),
        _lines(cost, 10, "0", ["'2. SHORT-TERM (Month 1-2):'"]),
        _lines(
            peaks.filter("place = 1"), 11, "0",
            [
                "concat('Adjust schedules to add ', extra_technicians, ' technicians during ', time_window)",
                f"concat('Impact: Reduce travel by ', {num('improvement_pct', 0)}, '%, improve ', fallback_count, ' assignments')",
            ],
        ),
        _lines(
            cost, 12, "0",
            [
                "CASE WHEN high_distance_count > 50 THEN 'Relocate or hire technicians in high-distance areas' END",
                f"CASE WHEN high_distance_count > 50 THEN concat({savings}) END",
                "'3. STRATEGIC (Quarter 1-2):'",
            ],
        ),
        _lines(
            counts, 13, "0",
            [
                "concat('Cross-train ', under_count, ' under-utilized technicians in shortage skills')",
                "'Implement dynamic scheduling based on time-of-day demand patterns'",
                "'Review and adjust capacity limits for consistently over-utilized technicians'",
            ],
        ),
        _lines(cost, 14, "0", ["'END OF STRATEGIC MEMO'"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str) -> None:
    """A few dozen lines, in order, as one text file."""
    lines.orderBy("section", "rank").select(F.col("line").alias("value")).coalesce(1).write.text(path)
