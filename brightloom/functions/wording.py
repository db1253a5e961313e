"""Sentences about an assignment, built as column expressions.

The sentence parts are fixed values: readers of the result tables rely on them.
"""

from __future__ import annotations


def num(sql: str, digits: int) -> str:
    """Number with a fixed count of decimals."""
    return f"format_string('%.{digits}f', round({sql}, {digits}))"


# Reason per constraint level, over the optimized table's columns.
REASON = """CASE constraint_status
  WHEN 'ALL_CONSTRAINTS_MET' THEN concat('✓ ALL CONSTRAINTS MET | Assigned: ', optimized_technician_name, ' (', optimized_technician_id,
    ') | Distance: ', round(optimized_distance_km, 1), ' km | Utilization: ', round(optimized_utilization * 100, 0),
    '% | ML Success: ', round(p_productive * 100, 0), '% | ML FTF: ', round(p_ftf * 100, 0), '% | Score: ', round(optimized_score, 1))
  WHEN 'FAILED_DISTANCE' THEN concat('⚠ FALLBACK (Distance > 60km) | Best available: ', optimized_technician_name,
    ' | Distance: ', round(optimized_distance_km, 1), ' km | Passed: Skill, Capacity, Availability')
  WHEN 'FAILED_AVAILABILITY' THEN concat('⚠ FALLBACK (Technician unavailable on date) | Best available: ', optimized_technician_name,
    ' | Passed: Skill, Capacity | Failed: Availability')
  WHEN 'FAILED_CAPACITY' THEN concat('⚠ FALLBACK (Technician over capacity) | Best available: ', optimized_technician_name,
    ' | Passed: Skill | Failed: Capacity')
  WHEN 'FAILED_SKILL' THEN concat('⚠ FALLBACK (No skill match) | Best available: ', optimized_technician_name,
    ' | Required: ', required_skill, ' | Tech has: Different skill')
  WHEN 'NO_DATE_MATCH' THEN '✗ NO ASSIGNMENT | Calendar date unavailable for this appointment date'
  ELSE '✗ NO ASSIGNMENT | No technicians available' END"""

SHORT_REASON = f"""CASE WHEN constraint_level = 'ALL_CONSTRAINTS_MET'
  THEN concat('Optimal: All constraints met, score=', {num('final_score', 2)})
  ELSE concat('Partial: ', constraint_level, ', ', constraints_passed, '/4 constraints') END"""

NO_TECHNICIAN = "No feasible technicians found"

PROXIMITY_BAND = """CASE WHEN distance_km <= 10 THEN 'excellent' WHEN distance_km <= 20 THEN 'good'
  WHEN distance_km <= 40 THEN 'moderate' ELSE 'far' END"""

QUALITY_BAND = """CASE WHEN quality_score >= 0.8D THEN 'excellent' WHEN quality_score >= 0.6D THEN 'good' ELSE 'fair' END"""

RECOMMENDATION = """CASE WHEN constraint_level <> 'ALL_CONSTRAINTS_MET' THEN 'FALLBACK'
  WHEN quality_score >= 0.7D AND distance_km <= 20 AND utilization < 0.8D THEN 'OPTIMAL'
  WHEN quality_score >= 0.6D THEN 'GOOD' ELSE 'ACCEPTABLE' END"""

# Over a scored pair row plus n_candidates and the runner-up's alt_name, alt_km, alt_utilization, alt_score.
EXPLANATION_LINES = (
    "'🎯 **Primary Selection Factors:**'",
    """CASE WHEN skill_match = 1 THEN '   ✓ **Skill Match**: Technician has the required skill'
       ELSE '   ⚠ **Skill Mismatch**: Technician assigned despite different skill (fallback)' END""",
    f"concat('   ✓ **Proximity**: ', {num('distance_km', 1)}, ' km from customer location')",
    """CASE WHEN distance_km <= 10 THEN '      → Excellent proximity (within 10 km)'
       WHEN distance_km <= 20 THEN '      → Good proximity (10-20 km)'
       WHEN distance_km <= 40 THEN '      → Moderate distance (20-40 km)'
       ELSE '      → Far distance (>40 km, may incur higher travel cost)' END""",
    "'\\n📊 **Workload & Availability:**'",
    f"concat('   ✓ **Current Utilization**: ', {num('utilization * 100', 0)}, '% of daily capacity')",
    """CASE WHEN utilization < 0.4D THEN '      → Low utilization - technician has significant availability'
       WHEN utilization < 0.7D THEN '      → Balanced workload - optimal assignment'
       WHEN utilization < 0.9D THEN '      → High utilization but still available'
       ELSE '      → Near/at capacity - may be stretched thin' END""",
    "'\\n🤖 **AI-Predicted Success Metrics:**'",
    f"concat('   ✓ **Productive Dispatch Probability**: ', {num('p_productive * 100', 1)}, '%')",
    f"concat('   ✓ **First-Time-Fix Probability**: ', {num('p_ftf * 100', 1)}, '%')",
    f"concat('   ✓ **Overall Quality Score**: ', {num('quality_score', 3)})",
    """CASE WHEN quality_score >= 0.8D THEN '      → Excellent predicted outcome'
       WHEN quality_score >= 0.6D THEN '      → Good predicted outcome' ELSE '      → Fair predicted outcome' END""",
    f"""CASE WHEN travel_cost <> 0 OR workload_cost <> 0 OR success_risk_cost <> 0 THEN concat(
       '\\n💰 **Optimization Cost Analysis:**', '\\n   • Travel Cost: ', {num('travel_cost', 2)},
       '\\n   • Workload Balance Cost: ', {num('workload_cost', 2)}, '\\n   • Success Risk Cost: ', {num('success_risk_cost', 2)}) END""",
    "'\\n✅ **Constraint Validation:**'",
    """CASE WHEN constraint_level = 'ALL_CONSTRAINTS_MET' THEN concat('   All hard constraints satisfied:',
       '\\n   • Skill requirement: ✓', '\\n   • Workload capacity: ✓', '\\n   • Calendar availability: ✓', '\\n   • Distance limit (≤60 km): ✓')
       ELSE concat('   ⚠ Fallback assignment (', constraints_passed, '/5 constraints met)', '\\n   Status: ', constraint_level) END""",
    """CASE WHEN n_candidates > 1 THEN concat('\\n🔍 **Comparison to Alternatives:**', '\\n   This technician ranked #1 among ',
       n_candidates, ' candidates', '\\n   vs. #2: ', alt_name) END""",
    f"""CASE WHEN n_candidates > 1 AND distance_km < alt_km
       THEN concat('      → ', {num('distance_km', 1)}, ' km vs ', {num('alt_km', 1)}, ' km (closer)') END""",
    f"""CASE WHEN n_candidates > 1 AND utilization < alt_utilization AND utilization < 0.9D
       THEN concat('      → ', {num('utilization * 100', 0)}, '% vs ', {num('alt_utilization * 100', 0)}, '% utilization (better availability)') END""",
    f"""CASE WHEN n_candidates > 1 AND round(final_score, 6) > round(alt_score, 6)
       THEN concat('      → Higher optimization score (', {num('final_score', 1)}, ' vs ', {num('alt_score', 1)}, ')') END""",
    "'\\n📝 **Final Recommendation:**'",
    f"""CASE {RECOMMENDATION} WHEN 'OPTIMAL' THEN '   ✓ **OPTIMAL**: All criteria met with excellent metrics'
       WHEN 'GOOD' THEN '   ✓ **GOOD**: All constraints met, solid performance expected'
       WHEN 'ACCEPTABLE' THEN '   ✓ **ACCEPTABLE**: All constraints met, moderate performance expected'
       ELSE '   ⚠ **FALLBACK**: Best available option given constraint violations' END""",
)

# concat_ws leaves out the lines that do not apply
EXPLANATION = f"concat_ws('\\n', {', '.join(EXPLANATION_LINES)})"
NO_EXPLANATION = "✗ No technicians available meeting minimum criteria for this dispatch."
