"""The adapter views again, as ANSI SQL for the side-by-side check."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views and whatever they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in VIEWS[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    # least() skips NULL, so a missing coordinate is ruled out first
    return (
        f"CASE WHEN {lat1} + {lon1} + {lat2} + {lon2} IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END"
    )


view("technicians", "", """
SELECT s_suppkey AS technician_id, s_name AS name, 'SKILL_' || CAST(s_suppkey % 8 AS VARCHAR) AS primary_skill,
  n_name AS city, r_name AS state,
  CAST(40 AS DOUBLE) + ((s_suppkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS latitude,
  CAST(-75 AS DOUBLE) + ((s_suppkey * 104729) % 1000) / CAST(1000 AS DOUBLE) AS longitude,
  4 + s_suppkey % 5 AS workload_capacity, (s_suppkey * 3) % 9 AS current_assignments
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

view("tech_calendar", "", """
SELECT l_suppkey AS technician_id, CAST(l_shipdate AS DATE) AS date,
  max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS available, max(l_linenumber) AS max_assignments,
  min(l_linenumber) + 6 AS start_hour, min(l_linenumber) + 14 AS end_hour
  FROM lineitem GROUP BY 1, 2""")

view("dispatches", "", """
SELECT o_orderkey AS dispatch_id,
  CASE o_orderstatus WHEN 'F' THEN 'Order' WHEN 'O' THEN 'Trouble' ELSE 'Maintenance' END AS ticket_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'install' WHEN 1 THEN 'repair' WHEN 2 THEN 'upgrade' ELSE 'maintenance' END AS order_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Normal' END AS priority,
  'SKILL_' || CAST(o_custkey % 9 AS VARCHAR) AS required_skill,
  CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Pending' ELSE 'pending' END AS status,
  n_name AS city, r_name AS state,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(40 AS DOUBLE) + ((o_custkey * 6151) % 1000) / CAST(1000 AS DOUBLE) END AS customer_latitude,
  CAST(-75 AS DOUBLE) + ((o_custkey * 3571) % 1000) / CAST(1000 AS DOUBLE) AS customer_longitude,
  o_orderdate + INTERVAL '1' HOUR * CAST(6 + o_orderkey % 16 AS INT) AS appointment_start,
  30 * (1 + o_orderkey % 6) AS duration_min,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '0' ELSE NULL END AS prior_technician_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

view("dispatch_history", "dispatches", """
SELECT l_orderkey * 8 + l_linenumber AS dispatch_id, l_suppkey AS assigned_technician_id, o.ticket_type, o.order_type, o.priority,
  'SKILL_' || CAST(l_partkey % 9 AS VARCHAR) AS required_skill, o.city AS dispatch_city, o.state AS dispatch_state,
  o.customer_latitude, o.customer_longitude,
  l_shipdate + INTERVAL '1' HOUR * CAST(6 + l_orderkey % 16 AS INT) AS appointment_start, 30 * (1 + l_linenumber) AS duration_min,
  CASE WHEN l_quantity = 50 THEN NULL WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS productive_dispatch,
  CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END AS first_time_fix
  FROM lineitem JOIN dispatches o ON l_orderkey = o.dispatch_id""")

view("proposals", "", "SELECT DISTINCT l_orderkey AS dispatch_id, l_suppkey AS technician_id FROM lineitem")

view("cube", "", """
SELECT CASE WHEN vec_id % 2 = 0 THEN 'exp1' ELSE 'exp2' END AS exposure, w,
  CAST(floor(vec_id / CAST(40 AS DOUBLE)) AS INT) AS y, CAST(floor((vec_id % 40) / CAST(2 AS DOUBLE)) AS INT) AS x,
  CAST(100 AS DOUBLE) * (v + CAST(0.2 AS DOUBLE)) AS flux
  FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS w, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) r""")

view("particles", "", """
SELECT s_suppkey AS pid, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) / 10007 AS px,
  CAST((s_suppkey * 6151 + 17) % 10009 AS DOUBLE) / 10009 AS py,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0.1 ELSE -0.1 END AS DOUBLE) AS vx,
  CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0.1 ELSE -0.1 END AS DOUBLE) AS vy,
  CAST(1 AS DOUBLE) + (s_suppkey % 5) AS mass FROM supplier""")

view("labeled_points", "", """
SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2,
  CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings""")

# Every (dispatch, technician of the day) pair with its flags, costs and score: the
# brute-force form that the blocked operators are checked against.
PAIRS_SQL = f"""
SELECT d.*, CAST(d.appointment_start AS DATE) AS appointment_date, t.technician_id, t.name AS technician_name,
  t.primary_skill, t.city AS tech_city, t.state AS tech_state, t.workload_capacity, t.current_assignments,
  CASE WHEN c.date IS NOT NULL THEN 1 ELSE 0 END AS has_date,
  CASE WHEN d.required_skill = t.primary_skill THEN 1 ELSE 0 END AS skill_match,
  CASE WHEN t.current_assignments < t.workload_capacity THEN 1 ELSE 0 END AS capacity_available,
  CASE WHEN c.available = 1 THEN 1 ELSE 0 END AS calendar_available,
  CASE WHEN t.latitude IS NOT NULL AND d.customer_latitude IS NOT NULL
    THEN {haversine_sql('t.latitude', 't.longitude', 'd.customer_latitude', 'd.customer_longitude')} ELSE 9999.0 END AS distance_km
  FROM {{src}} d LEFT JOIN tech_calendar c ON CAST(d.appointment_start AS DATE) = c.date
  LEFT JOIN technicians t ON c.technician_id = t.technician_id"""
view("pairs", "dispatches tech_calendar technicians", PAIRS_SQL.format(src="dispatches"))

SCORED_SQL = """
SELECT *, -final_cost AS final_score, (5 - constraints_passed) * 100.0 AS constraint_penalty,
  -(final_cost + (5 - constraints_passed) * 100.0) AS final_score_with_penalty FROM (
SELECT *, base_job_cost * priority_weight AS final_cost FROM (
SELECT *, travel_cost + workload_cost + success_risk_cost + duration_cost AS base_job_cost FROM (
SELECT *, CAST(0.7 AS DOUBLE) * p_productive + CAST(0.3 AS DOUBLE) * p_ftf AS quality_score,
  CAST(10 AS DOUBLE) * (1 - (CAST(0.7 AS DOUBLE) * p_productive + CAST(0.3 AS DOUBLE) * p_ftf)) AS success_risk_cost FROM (
SELECT *,
  CAST(0.5 AS DOUBLE) * distance_km + CAST(2 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), distance_km - 20) AS travel_cost,
  CASE WHEN utilization < 0.4 THEN 8 * (CAST(0.4 AS DOUBLE) - utilization) WHEN utilization > 0.9 THEN 15 * (utilization - CAST(0.9 AS DOUBLE)) ELSE 0 END AS workload_cost,
  CAST(0.01 AS DOUBLE) * duration_min AS duration_cost,
  CASE priority WHEN 'Critical' THEN CAST(3 AS DOUBLE) WHEN 'High' THEN 2 WHEN 'Normal' THEN 1 WHEN 'Low' THEN 0.5 ELSE 1 END AS priority_weight,
  1 / (1 + exp(-(CAST(0.4 AS DOUBLE) + CAST(0.9 AS DOUBLE) * skill_match - CAST(0.01 AS DOUBLE) * model_km - CAST(0.5 AS DOUBLE) * utilization))) AS p_productive,
  1 / (1 + exp(-(CAST(0.1 AS DOUBLE) + CAST(0.7 AS DOUBLE) * skill_match + CAST(0.2 AS DOUBLE) * city_match - CAST(0.008 AS DOUBLE) * model_km - CAST(0.3 AS DOUBLE) * utilization))) AS p_ftf
  FROM (
SELECT *, CASE WHEN has_date = 0 THEN 'NO_DATE_MATCH' WHEN skill_match = 0 THEN 'FAILED_SKILL' WHEN capacity_available = 0 THEN 'FAILED_CAPACITY'
    WHEN calendar_available = 0 THEN 'FAILED_AVAILABILITY' WHEN distance_ok = 0 THEN 'FAILED_DISTANCE' ELSE 'ALL_CONSTRAINTS_MET' END AS constraint_level,
  has_date + skill_match + capacity_available + calendar_available + distance_ok AS constraints_passed,
  CASE WHEN workload_capacity > 0 THEN current_assignments / CAST(workload_capacity AS DOUBLE) ELSE 0 END AS utilization,
  CASE WHEN city = tech_city THEN 1 ELSE 0 END AS city_match,
  CASE WHEN distance_km = 9999.0 THEN CAST(-1 AS DOUBLE) ELSE distance_km END AS model_km
  FROM (SELECT *, CASE WHEN distance_km <= 60 THEN 1 ELSE 0 END AS distance_ok FROM {src}) a) b) c) d) e) f"""

view("candidates", "pairs", SCORED_SQL.format(src="pairs"))

LEVEL_RANK_SQL = (
    "CASE constraint_level WHEN 'ALL_CONSTRAINTS_MET' THEN 1 WHEN 'FAILED_DISTANCE' THEN 2 WHEN 'FAILED_AVAILABILITY' THEN 3 "
    "WHEN 'FAILED_CAPACITY' THEN 4 WHEN 'FAILED_SKILL' THEN 5 ELSE 6 END"
)

view("best", "candidates", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dispatch_id ORDER BY {LEVEL_RANK_SQL}, round(final_score, 6) DESC, technician_id) AS rn
  FROM candidates WHERE technician_id IS NOT NULL) z WHERE rn = 1""")

# The optimized table: open dispatches from the floor date on get their best technician.
view("optimized", "dispatches best", """
SELECT d.*, CASE WHEN b.technician_id IS NOT NULL THEN CAST(b.technician_id AS VARCHAR) ELSE d.prior_technician_id END AS optimized_technician_id,
  b.technician_name AS optimized_technician_name, b.constraint_level AS constraint_status, b.constraints_passed, b.final_score AS optimized_score,
  b.distance_km AS optimized_distance_km, b.utilization AS optimized_utilization, b.p_productive, b.p_ftf, b.quality_score,
  b.travel_cost, b.workload_cost, b.success_risk_cost, b.duration_cost, b.priority_weight,
  b.skill_match, b.capacity_available, b.calendar_available, b.distance_ok,
  CASE WHEN b.technician_id IS NOT NULL THEN 'Complete' ELSE 'Pending' END AS optimization_status,
  CASE WHEN b.technician_id IS NOT NULL THEN '2025-11-12 00:00:00' ELSE NULL END AS optimization_timestamp,
  CASE WHEN b.constraint_level = 'ALL_CONSTRAINTS_MET' THEN TRUE ELSE FALSE END AS all_constraints_met
  FROM (SELECT * FROM dispatches WHERE CAST(appointment_start AS DATE) >= DATE '1995-06-01') d
  LEFT JOIN (SELECT * FROM best WHERE coalesce(prior_technician_id, '') = '') b ON d.dispatch_id = b.dispatch_id""")

# The proposed pairs with the same flags, costs and scores.
view("proposed", "dispatches technicians tech_calendar proposals", f"""
SELECT d.*, CAST(d.appointment_start AS DATE) AS appointment_date, t.technician_id, t.name AS technician_name,
  t.primary_skill, t.city AS tech_city, t.state AS tech_state, t.workload_capacity, t.current_assignments,
  CASE WHEN c.date IS NOT NULL THEN 1 ELSE 0 END AS has_date,
  CASE WHEN d.required_skill = t.primary_skill THEN 1 ELSE 0 END AS skill_match,
  CASE WHEN t.current_assignments < t.workload_capacity THEN 1 ELSE 0 END AS capacity_available,
  CASE WHEN c.available = 1 THEN 1 ELSE 0 END AS calendar_available,
  CASE WHEN t.latitude IS NOT NULL AND d.customer_latitude IS NOT NULL
    THEN {haversine_sql('t.latitude', 't.longitude', 'd.customer_latitude', 'd.customer_longitude')} ELSE 9999.0 END AS distance_km
  FROM proposals p JOIN dispatches d ON p.dispatch_id = d.dispatch_id JOIN technicians t ON p.technician_id = t.technician_id
  LEFT JOIN tech_calendar c ON c.technician_id = p.technician_id AND c.date = CAST(d.appointment_start AS DATE)""")

view("proposed_scored", "proposed", SCORED_SQL.format(src="proposed"))
