"""Dispatch queries: scans, pair projections, joins, assignment and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import adapters as A
from brightloom.config import DEFAULT_RULES, FIRST_FREE_ID
from brightloom.functions import scoring, wording
from brightloom.operators import assignment as S
from brightloom.operators import ranking
from brightloom.queries.base import best, optimize, optimized, query, since_floor
from brightloom.queries.views_sql import LEVEL_RANK_SQL, haversine_sql, with_views
from brightloom.session import fresh_path
from brightloom.sources import tables, tickets

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def r4(*names: str) -> list[str]:
    """Four decimals. The billionth keeps sums that end in an exact 5 on the same side in both engines."""
    return [f"round({n} + 1e-9D, 4) + 0D AS {n}" for n in names]


def r4s(*names: str) -> str:
    return ", ".join(f"round({n} + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS {n}" for n in names)


# --- scans and filters --------------------------------------------------------------------
@query(
    "src_table_scan",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
)
def src_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.row_counts({t: A.table(spark, sf, t) for t in TABLES})


FLOOR = DEFAULT_RULES.date_floor


@query(
    "src_date_floor",
    with_views("dispatches", f"""SELECT dispatch_id, CAST(CAST(appointment_start AS DATE) AS VARCHAR) AS day FROM dispatches
    WHERE CAST(appointment_start AS DATE) >= DATE '{FLOOR}'"""),
)
def src_date_floor(spark: SparkSession, sf: str) -> DataFrame:
    return since_floor(spark, sf).selectExpr("dispatch_id", "CAST(to_date(appointment_start) AS STRING) AS day")


@query(
    "flt_unoptimized",
    with_views("dispatches", "SELECT dispatch_id, priority FROM dispatches WHERE prior_technician_id IS NULL OR prior_technician_id = ''"),
)
def flt_unoptimized(spark: SparkSession, sf: str) -> DataFrame:
    return S.unoptimized(A.dispatches(spark, sf)).select("dispatch_id", "priority")


@query(
    "flt_status",
    with_views("dispatches", "SELECT dispatch_id, status FROM dispatches WHERE status IN ('Pending', 'pending')"),
)
def flt_status(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_status(A.dispatches(spark, sf)).select("dispatch_id", "status")


@query(
    "flt_single_key",
    with_views("optimized", f"""SELECT dispatch_id, optimized_technician_id, {r4s('optimized_score')} FROM optimized
    WHERE dispatch_id = (SELECT max(o_orderkey) FROM orders)"""),
)
def flt_single_key(spark: SparkSession, sf: str) -> DataFrame:
    # the newest ticket, as the intake flow scopes its run: only that one is matched
    newest = A.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("dispatch_id"))
    return optimize(spark, sf, newest).selectExpr(
        "dispatch_id", "optimized_technician_id", *r4("optimized_score")
    )


@query(
    "flt_labels_present",
    with_views("dispatch_history", """SELECT dispatch_id, productive_dispatch, first_time_fix FROM dispatch_history
    WHERE productive_dispatch IS NOT NULL AND first_time_fix IS NOT NULL"""),
)
def flt_labels_present(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.dispatch_history(spark, sf).select("dispatch_id", "productive_dispatch", "first_time_fix")
    return rows.dropna(subset=["productive_dispatch", "first_time_fix"])


# --- tickets ------------------------------------------------------------------------------
def raw_tickets(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as form text; some streets, cities, numbers and times are blank or malformed."""
    o = orders if orders is not None else A.table(spark, sf, "orders")
    return o.selectExpr(
        "o_orderkey AS ticket_key",
        "CASE o_orderstatus WHEN 'F' THEN 'Order' WHEN 'O' THEN 'Trouble' ELSE 'Maintenance' END AS ticket_type",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'install' ELSE 'repair' END AS order_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' ELSE 'Low' END AS priority",
        "concat('SKILL_', o_custkey % 9) AS required_skill",
        "CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat('Street ', o_custkey) END AS street",
        "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('City ', o_custkey % 25) END AS city",
        "'NJ' AS state",
        "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(10000 + o_custkey AS STRING) END AS postal_code",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE concat('40.', lpad(CAST(o_custkey * 6151 % 1000 AS STRING), 3, '0')) END AS customer_latitude",
        "concat('-74.', lpad(CAST(o_custkey * 3571 % 1000 AS STRING), 3, '0')) AS customer_longitude",
        """CASE WHEN o_orderkey % 29 = 0 THEN 'bad' ELSE concat(CAST(to_date(o_orderdate) AS STRING), 'T',
           lpad(CAST(6 + o_orderkey % 16 AS STRING), 2, '0'), ':30') END AS appointment_start""",
        """concat(CAST(to_date(o_orderdate) AS STRING), 'T', lpad(CAST(7 + o_orderkey % 16 AS STRING), 2, '0'), ':30') AS appointment_end""",
        "CAST(30 * (1 + o_orderkey % 6) AS STRING) AS duration_min",
    )


RAW_SQL = """SELECT o_orderkey AS ticket_key,
  CASE o_orderstatus WHEN 'F' THEN 'Order' WHEN 'O' THEN 'Trouble' ELSE 'Maintenance' END AS ticket_type,
  o_custkey, o_orderdate, o_orderkey % 17 = 0 AS no_street, o_orderkey % 19 = 0 AS no_city, o_orderkey % 31 = 0 AS no_postal,
  o_orderkey % 23 = 0 AS bad_place, o_orderkey % 29 = 0 AS bad_time FROM orders"""


@query(
    "src_ticket_ingest",
    f"""SELECT row_number() OVER (ORDER BY ticket_key) + (SELECT max(o_orderkey) FROM orders) AS dispatch_id, ticket_type, 'pending' AS status,
    CAST(40 AS DOUBLE) + ((o_custkey * 6151) % 1000) / CAST(1000 AS DOUBLE) AS customer_latitude, 10000 + o_custkey AS postal_code,
    strftime(o_orderdate + INTERVAL '1' HOUR * CAST(6 + ticket_key % 16 AS INT) + INTERVAL '30' MINUTE, '%Y-%m-%d %H:%M:%S') AS starts,
    'Pending' AS optimization_status, FALSE AS all_constraints_met, 42 AS n_fields, TRUE AS results_empty
    FROM ({RAW_SQL}) r WHERE NOT (no_street OR no_city OR no_postal OR bad_place OR bad_time)""",
)
def src_ticket_ingest(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = tickets.split_valid(raw_tickets(spark, sf))
    taken = A.table(spark, sf, "orders")
    rows = tickets.typed_tickets(ranking.next_ids(valid, taken, "o_orderkey", "ticket_key", FIRST_FREE_ID), "new_id")
    return rows.selectExpr(
        "Dispatch_id AS dispatch_id", "Ticket_type AS ticket_type", "Status AS status", "Customer_latitude AS customer_latitude",
        "Postal_code AS postal_code", "date_format(Appointment_start_datetime, 'yyyy-MM-dd HH:mm:ss') AS starts",
        "Optimization_status AS optimization_status", "All_constraints_met AS all_constraints_met",
        f"{len(rows.columns)} AS n_fields", "coalesce(Optimized_technician_id, Optimized_technician_name) IS NULL AS results_empty",
    )


@query(
    "src_next_id",
    """SELECT o_orderkey, (SELECT coalesce(max(c_custkey), 200000000) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders""",
)
def src_next_id(spark: SparkSession, sf: str) -> DataFrame:
    batch = A.table(spark, sf, "orders").select("o_orderkey")
    return ranking.next_ids(batch, A.table(spark, sf, "customer"), "c_custkey", "o_orderkey", FIRST_FREE_ID)


ERRORS_SQL = """concat_ws('; ', CASE WHEN no_street THEN 'Street is required' END, CASE WHEN no_city THEN 'City is required' END,
  CASE WHEN no_postal THEN 'Postal code is required' END, CASE WHEN bad_place THEN 'Invalid latitude/longitude' END,
  CASE WHEN bad_time THEN 'Invalid date/time format (use YYYY-MM-DDTHH:MM)' END)"""


@query("flt_validate_rows", f"SELECT ticket_key, {ERRORS_SQL} AS errors FROM ({RAW_SQL}) r")
def flt_validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tickets.with_errors(raw_tickets(spark, sf)).selectExpr("ticket_key", "concat_ws('; ', errors) AS errors")


@query(
    "fn_parse_timestamp",
    f"""SELECT ticket_key, CASE WHEN bad_time THEN NULL ELSE strftime(o_orderdate + INTERVAL '1' HOUR * CAST(6 + ticket_key % 16 AS INT)
    + INTERVAL '30' MINUTE, '%Y-%m-%d %H:%M') END AS parsed FROM ({RAW_SQL}) r""",
)
def fn_parse_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return raw_tickets(spark, sf).selectExpr(
        "ticket_key", f"date_format({tickets.parse_time('appointment_start')}, 'yyyy-MM-dd HH:mm') AS parsed"
    )


# --- sinks --------------------------------------------------------------------------------
@query("sink_append", with_views("dispatches", "SELECT status, count(*) AS n, sum(duration_min) AS minutes FROM dispatches GROUP BY status"))
def sink_append(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "appended")
    d = A.dispatches(spark, sf).select("dispatch_id", "status", "duration_min")
    pending = F.lower("status") == "pending"
    tables.append(d.filter(pending), path)
    tables.append(d.filter(~pending), path)
    return spark.read.parquet(path).groupBy("status").agg(F.expr("count(*) AS n"), F.expr("sum(duration_min) AS minutes"))


@query("sink_overwrite", with_views("dispatches", "SELECT priority, count(*) AS n FROM dispatches WHERE status <> 'Closed' GROUP BY priority"))
def sink_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "replaced")
    d = A.dispatches(spark, sf).select("dispatch_id", "status", "priority")
    tables.overwrite(d, path, 1)
    tables.overwrite(tables.read_latest(spark, path).filter("status <> 'Closed'"), path, 2)
    return tables.read_latest(spark, path).groupBy("priority").agg(F.expr("count(*) AS n"))


@query(
    "sink_keyed_update",
    with_views("optimized", """SELECT dispatch_id, CASE WHEN optimization_status = 'Complete' THEN optimized_technician_id ELSE prior_technician_id END
    AS prior_technician_id, CASE WHEN optimization_status = 'Complete' THEN 'Complete' ELSE status END AS status FROM optimized"""),
)
def sink_keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    current = since_floor(spark, sf).select("dispatch_id", "prior_technician_id", "status")
    updates = optimized(spark, sf).filter("optimization_status = 'Complete'").selectExpr(
        "dispatch_id", "optimized_technician_id AS prior_technician_id", "optimization_status AS status"
    )
    path = fresh_path(spark, "updated")
    tables.overwrite(current, path, 1)
    tables.overwrite(
        tables.keyed_update(tables.read_latest(spark, path), updates, "dispatch_id", ["prior_technician_id", "status"]), path, 2
    )
    return tables.read_latest(spark, path)


# --- pair projections, over the proposed (dispatch, technician) pairs ---------------------------
def proposed(spark: SparkSession, sf: str) -> DataFrame:
    return S.expand_pairs(
        A.proposals(spark, sf), A.dispatches(spark, sf), A.tech_calendar(spark, sf), A.technicians(spark, sf)
    )


IDS = ["dispatch_id", "technician_id"]


def projection(name: str, plain: list[str], rounded: list[str]) -> None:
    sql = ", ".join(IDS + plain + ([r4s(*rounded)] if rounded else []))

    @query(name, with_views("proposed_scored", f"SELECT {sql} FROM proposed_scored"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return proposed(spark, sf).selectExpr(*IDS, *plain, *r4(*rounded))


projection("prj_constraint_flags", ["has_date", "skill_match", "capacity_available", "calendar_available", "distance_ok"], [])
projection("prj_constraint_level", ["constraint_level"], [])
projection("prj_constraints_passed", ["constraints_passed"], [])
projection("prj_utilization", [], ["utilization"])
projection("fn_haversine", [], ["distance_km"])
projection("prj_travel_cost", [], ["travel_cost"])
projection("prj_workload_cost", [], ["workload_cost"])
projection("prj_quality_risk", [], ["quality_score", "success_risk_cost"])
projection("prj_duration_cost", [], ["duration_cost"])
projection("prj_priority_weight", ["priority"], ["priority_weight"])
projection(
    "prj_final_score", [],
    ["base_job_cost", "final_cost", "constraint_penalty", "final_score", "final_score_with_penalty"],
)
projection("ml_score_linear", [], ["p_productive", "p_ftf"])


@query(
    "join_scores",
    with_views("proposed_scored", f"""SELECT p.dispatch_id, p.technician_id, round(coalesce(s.p_productive, 0.5), 4) AS p_productive,
    round(coalesce(s.p_ftf, 0.5), 4) AS p_ftf FROM proposals p JOIN dispatches d ON d.dispatch_id = p.dispatch_id
    LEFT JOIN (SELECT * FROM proposed_scored WHERE skill_match = 1) s ON p.dispatch_id = s.dispatch_id AND p.technician_id = s.technician_id"""),
)
def join_scores(spark: SparkSession, sf: str) -> DataFrame:
    # scores known for some pairs only; the others count as 0.5
    pairs = proposed(spark, sf)
    known = pairs.filter("skill_match = 1").select(*IDS, "p_productive", "p_ftf")
    return scoring.default_scores(pairs.select(*IDS).join(known, IDS, "left")).selectExpr(
        *IDS, "round(p_productive, 4) AS p_productive", "round(p_ftf, 4) AS p_ftf"
    )


@query(
    "win_first_non_null",
    with_views("proposed_scored", f"""SELECT DISTINCT dispatch_id,
    first_value(technician_id) OVER w AS technician_id, first_value(near_km IGNORE NULLS) OVER w AS near_km FROM (
      SELECT *, CASE WHEN distance_km <= 60 THEN round(distance_km, 4) END AS near_km FROM proposed_scored) p
    WINDOW w AS (PARTITION BY dispatch_id ORDER BY {LEVEL_RANK_SQL}, round(final_score, 6) DESC, technician_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
)
def win_first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    # per column the first known value in rank order: the smallest rank among the rows that have one
    rank = f"struct({scoring.level_rank()} AS lv, -round(final_score, 6) AS cost, technician_id)"
    rows = proposed(spark, sf).selectExpr(*IDS, "CASE WHEN distance_km <= 60 THEN round(distance_km, 4) END AS near_km", f"{rank} AS rk")
    return rows.groupBy("dispatch_id").agg(
        F.expr("min_by(technician_id, rk) AS technician_id"),
        F.expr("min_by(near_km, rk) FILTER (WHERE near_km IS NOT NULL) AS near_km"),
    )


# --- history projections ---------------------------------------------------------------------
def _history_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from brightloom.operators import features

    return features.training_rows(A.dispatch_history(spark, sf), A.technicians(spark, sf))


@query(
    "join_history_tech",
    with_views("dispatch_history technicians", """SELECT h.dispatch_id, t.technician_id, t.name AS technician_name, t.primary_skill AS technician_skill,
    h.required_skill FROM dispatch_history h JOIN technicians t ON h.assigned_technician_id = t.technician_id
    WHERE h.productive_dispatch IS NOT NULL AND h.first_time_fix IS NOT NULL"""),
)
def join_history_tech(spark: SparkSession, sf: str) -> DataFrame:
    return _history_pairs(spark, sf).select("dispatch_id", "technician_id", "technician_name", "technician_skill", "required_skill")


@query(
    "prj_rename",
    with_views("technicians", """SELECT technician_id AS tech_id, name AS technician_name, primary_skill AS technician_skill, city AS technician_city,
    state AS technician_state, latitude AS technician_latitude, longitude AS technician_longitude,
    workload_capacity AS technician_workload_capacity, current_assignments AS technician_current_assignments FROM technicians"""),
)
def prj_rename(spark: SparkSession, sf: str) -> DataFrame:
    from brightloom.operators import features

    return features.technician_columns(A.technicians(spark, sf))


# --- joins and assignment ------------------------------------------------------------------------
def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.dispatches(spark, sf), A.tech_calendar(spark, sf), A.technicians(spark, sf)


@query(
    "join_candidates",
    with_views("candidates", "SELECT dispatch_id, constraint_level, count(*) AS n_candidates FROM candidates GROUP BY 1, 2"),
)
def join_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return S.candidate_levels(*_inputs(spark, sf))


@query(
    "join_candidates_feasible",
    with_views("candidates", f"SELECT dispatch_id, technician_id, {r4s('distance_km')} FROM candidates WHERE constraint_level = 'ALL_CONSTRAINTS_MET'"),
)
def join_candidates_feasible(spark: SparkSession, sf: str) -> DataFrame:
    return S.feasible_pairs(*_inputs(spark, sf)).selectExpr(*IDS, *r4("distance_km"))


@query(
    "agg_constraint_breakdown",
    with_views("candidates", """SELECT constraint_level, count(DISTINCT dispatch_id) AS unique_dispatches, count(*) AS pairs
    FROM candidates WHERE technician_id IS NOT NULL GROUP BY 1"""),
)
def agg_constraint_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    # one row per dispatch and level, so counting rows counts distinct dispatches
    levels = S.candidate_levels(*_inputs(spark, sf)).filter("constraint_level <> 'NO_DATE_MATCH'")
    return levels.groupBy("constraint_level").agg(
        F.expr("count(*) AS unique_dispatches"), F.expr("sum(n_candidates) AS pairs")
    )


@query(
    "set_distinct_dispatches",
    with_views("candidates", "SELECT DISTINCT dispatch_id FROM candidates WHERE constraint_level = 'ALL_CONSTRAINTS_MET'"),
)
def set_distinct_dispatches(spark: SparkSession, sf: str) -> DataFrame:
    return S.dispatches_with_feasible(*_inputs(spark, sf))


@query(
    "win_best_per_dispatch",
    with_views("best", f"SELECT dispatch_id, technician_id, constraint_level, constraints_passed, {r4s('distance_km', 'final_score')} FROM best"),
)
def win_best_per_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf).selectExpr(
        *IDS, "constraint_level", "constraints_passed", *r4("distance_km", "final_score")
    )


RUNNER_SQL = """SELECT dispatch_id, technician_id AS first_id, technician_name AS first_name, lead(technician_name) OVER w AS alt_name,
  lead(distance_km) OVER w AS alt_km, lead(utilization) OVER w AS alt_utilization, lead(final_score) OVER w AS alt_score,
  row_number() OVER w AS score_rank, count(*) OVER (PARTITION BY dispatch_id) AS n_candidates FROM candidates WHERE technician_id IS NOT NULL
  WINDOW w AS (PARTITION BY dispatch_id ORDER BY round(final_score, 6) DESC, technician_id)"""


def runner_up(spark: SparkSession, sf: str) -> DataFrame:
    """Per dispatch: number of candidates and the second best by score."""
    from brightloom.queries.base import written

    def build(s: SparkSession, d: str) -> DataFrame:
        inputs = _inputs(s, d)
        second = S.top_technicians(*inputs, k=3).filter("score_rank <= 2").groupBy("dispatch_id").agg(
            F.expr("max(CASE WHEN score_rank = 1 THEN technician_id END) AS first_id"),
            F.expr("max(CASE WHEN score_rank = 2 THEN technician_name END) AS alt_name"),
            F.expr("max(CASE WHEN score_rank = 2 THEN distance_km END) AS alt_km"),
            F.expr("max(CASE WHEN score_rank = 2 THEN utilization END) AS alt_utilization"),
            F.expr("max(CASE WHEN score_rank = 2 THEN final_score END) AS alt_score"),
        )
        return S.day_candidates(*inputs).join(second, "dispatch_id")

    return written(spark, sf, "runner_up", build)


@query(
    "win_runner_up",
    with_views("candidates", f"""SELECT dispatch_id, first_id, alt_name, {r4s('alt_km', 'alt_utilization', 'alt_score')}, n_candidates
    FROM ({RUNNER_SQL}) r WHERE score_rank = 1"""),
)
def win_runner_up(spark: SparkSession, sf: str) -> DataFrame:
    return runner_up(spark, sf).selectExpr(
        "dispatch_id", "first_id", "alt_name", *r4("alt_km", "alt_utilization", "alt_score"), "n_candidates"
    )


@query(
    "join_result_back",
    with_views("optimized", f"SELECT dispatch_id, optimized_technician_id, constraint_status, {r4s('optimized_score', 'optimized_distance_km')} FROM optimized"),
)
def join_result_back(spark: SparkSession, sf: str) -> DataFrame:
    return optimized(spark, sf).selectExpr(
        "dispatch_id", "optimized_technician_id", "constraint_status", *r4("optimized_score", "optimized_distance_km")
    )


@query(
    "prj_result_overlay",
    with_views("optimized", """SELECT dispatch_id, optimized_technician_id, optimized_technician_name, optimization_status, optimization_timestamp,
    all_constraints_met FROM optimized"""),
)
def prj_result_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return optimized(spark, sf).select(
        "dispatch_id", "optimized_technician_id", "optimized_technician_name", "optimization_status",
        "optimization_timestamp", "all_constraints_met",
    )


REASON_SQL = """CASE constraint_status
  WHEN 'ALL_CONSTRAINTS_MET' THEN '✓ ALL CONSTRAINTS MET | Assigned: ' || optimized_technician_name || ' (' || optimized_technician_id ||
    ') | Distance: ' || CAST(round(optimized_distance_km, 1) AS VARCHAR) || ' km | Utilization: ' || CAST(round(optimized_utilization * 100, 0) AS VARCHAR) ||
    '% | ML Success: ' || CAST(round(p_productive * 100, 0) AS VARCHAR) || '% | ML FTF: ' || CAST(round(p_ftf * 100, 0) AS VARCHAR) ||
    '% | Score: ' || CAST(round(optimized_score, 1) AS VARCHAR)
  WHEN 'FAILED_DISTANCE' THEN '⚠ FALLBACK (Distance > 60km) | Best available: ' || optimized_technician_name || ' | Distance: ' ||
    CAST(round(optimized_distance_km, 1) AS VARCHAR) || ' km | Passed: Skill, Capacity, Availability'
  WHEN 'FAILED_AVAILABILITY' THEN '⚠ FALLBACK (Technician unavailable on date) | Best available: ' || optimized_technician_name || ' | Passed: Skill, Capacity | Failed: Availability'
  WHEN 'FAILED_CAPACITY' THEN '⚠ FALLBACK (Technician over capacity) | Best available: ' || optimized_technician_name || ' | Passed: Skill | Failed: Capacity'
  WHEN 'FAILED_SKILL' THEN '⚠ FALLBACK (No skill match) | Best available: ' || optimized_technician_name || ' | Required: ' || required_skill || ' | Tech has: Different skill'
  ELSE '✗ NO ASSIGNMENT | No technicians available' END"""


@query("prj_reason_text", with_views("optimized", f"SELECT dispatch_id, {REASON_SQL} AS reason FROM optimized"))
def prj_reason_text(spark: SparkSession, sf: str) -> DataFrame:
    return optimized(spark, sf).selectExpr("dispatch_id", f"{wording.REASON} AS reason")


def num_sql(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}))"


@query(
    "prj_short_reason",
    with_views("best", f"""SELECT dispatch_id, CASE WHEN constraint_level = 'ALL_CONSTRAINTS_MET' THEN 'Optimal: All constraints met, score=' || {num_sql('final_score', 2)}
    ELSE 'Partial: ' || constraint_level || ', ' || constraints_passed || '/4 constraints' END AS reason FROM best"""),
)
def prj_short_reason(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf).selectExpr("dispatch_id", f"{wording.SHORT_REASON} AS reason")


def band(name: str, spark_expr: str, sql_expr: str) -> None:
    @query(name, with_views("best", f"SELECT dispatch_id, {sql_expr} AS band FROM best"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return best(spark, sf).selectExpr("dispatch_id", f"{spark_expr} AS band")


band("prj_proximity_band", wording.PROXIMITY_BAND, "CASE WHEN distance_km <= 10 THEN 'excellent' WHEN distance_km <= 20 THEN 'good' WHEN distance_km <= 40 THEN 'moderate' ELSE 'far' END")
band("prj_quality_band", wording.QUALITY_BAND, "CASE WHEN quality_score >= 0.8 THEN 'excellent' WHEN quality_score >= 0.6 THEN 'good' ELSE 'fair' END")
RECOMMEND_SQL = """CASE WHEN constraint_level <> 'ALL_CONSTRAINTS_MET' THEN 'FALLBACK' WHEN quality_score >= 0.7 AND distance_km <= 20 AND utilization < 0.8 THEN 'OPTIMAL'
  WHEN quality_score >= 0.6 THEN 'GOOD' ELSE 'ACCEPTABLE' END"""
band("prj_recommendation", wording.RECOMMENDATION, RECOMMEND_SQL)

EXPLAIN_SQL = f"""concat_ws(chr(10), '🎯 **Primary Selection Factors:**',
  CASE WHEN skill_match = 1 THEN '   ✓ **Skill Match**: Technician has the required skill' ELSE '   ⚠ **Skill Mismatch**: Technician assigned despite different skill (fallback)' END,
  '   ✓ **Proximity**: ' || {num_sql('distance_km', 1)} || ' km from customer location',
  CASE WHEN distance_km <= 10 THEN '      → Excellent proximity (within 10 km)' WHEN distance_km <= 20 THEN '      → Good proximity (10-20 km)'
    WHEN distance_km <= 40 THEN '      → Moderate distance (20-40 km)' ELSE '      → Far distance (>40 km, may incur higher travel cost)' END,
  chr(10) || '📊 **Workload & Availability:**', '   ✓ **Current Utilization**: ' || {num_sql('utilization * 100', 0)} || '% of daily capacity',
  CASE WHEN utilization < 0.4 THEN '      → Low utilization - technician has significant availability' WHEN utilization < 0.7 THEN '      → Balanced workload - optimal assignment'
    WHEN utilization < 0.9 THEN '      → High utilization but still available' ELSE '      → Near/at capacity - may be stretched thin' END,
  chr(10) || '🤖 **AI-Predicted Success Metrics:**', '   ✓ **Productive Dispatch Probability**: ' || {num_sql('p_productive * 100', 1)} || '%',
  '   ✓ **First-Time-Fix Probability**: ' || {num_sql('p_ftf * 100', 1)} || '%', '   ✓ **Overall Quality Score**: ' || {num_sql('quality_score', 3)},
  CASE WHEN quality_score >= 0.8 THEN '      → Excellent predicted outcome' WHEN quality_score >= 0.6 THEN '      → Good predicted outcome' ELSE '      → Fair predicted outcome' END,
  CASE WHEN travel_cost <> 0 OR workload_cost <> 0 OR success_risk_cost <> 0 THEN chr(10) || '💰 **Optimization Cost Analysis:**' || chr(10) || '   • Travel Cost: ' || {num_sql('travel_cost', 2)}
    || chr(10) || '   • Workload Balance Cost: ' || {num_sql('workload_cost', 2)} || chr(10) || '   • Success Risk Cost: ' || {num_sql('success_risk_cost', 2)} END,
  chr(10) || '✅ **Constraint Validation:**',
  CASE WHEN constraint_level = 'ALL_CONSTRAINTS_MET' THEN '   All hard constraints satisfied:' || chr(10) || '   • Skill requirement: ✓' || chr(10) || '   • Workload capacity: ✓' || chr(10)
    || '   • Calendar availability: ✓' || chr(10) || '   • Distance limit (≤60 km): ✓'
    ELSE '   ⚠ Fallback assignment (' || constraints_passed || '/5 constraints met)' || chr(10) || '   Status: ' || constraint_level END,
  CASE WHEN n_candidates > 1 THEN chr(10) || '🔍 **Comparison to Alternatives:**' || chr(10) || '   This technician ranked #1 among ' || n_candidates || ' candidates' || chr(10) || '   vs. #2: ' || alt_name END,
  CASE WHEN n_candidates > 1 AND distance_km < alt_km THEN '      → ' || {num_sql('distance_km', 1)} || ' km vs ' || {num_sql('alt_km', 1)} || ' km (closer)' END,
  CASE WHEN n_candidates > 1 AND utilization < alt_utilization AND utilization < 0.9 THEN '      → ' || {num_sql('utilization * 100', 0)} || '% vs ' || {num_sql('alt_utilization * 100', 0)} || '% utilization (better availability)' END,
  CASE WHEN n_candidates > 1 AND round(final_score, 6) > round(alt_score, 6) THEN '      → Higher optimization score (' || {num_sql('final_score', 1)} || ' vs ' || {num_sql('alt_score', 1)} || ')' END,
  chr(10) || '📝 **Final Recommendation:**',
  CASE {RECOMMEND_SQL} WHEN 'OPTIMAL' THEN '   ✓ **OPTIMAL**: All criteria met with excellent metrics' WHEN 'GOOD' THEN '   ✓ **GOOD**: All constraints met, solid performance expected'
    WHEN 'ACCEPTABLE' THEN '   ✓ **ACCEPTABLE**: All constraints met, moderate performance expected' ELSE '   ⚠ **FALLBACK**: Best available option given constraint violations' END)"""


@query(
    "prj_explanation",
    with_views("candidates best", f"""SELECT b.dispatch_id, {EXPLAIN_SQL} AS explanation FROM best b JOIN
    (SELECT dispatch_id AS did, alt_name, alt_km, alt_utilization, alt_score, n_candidates FROM ({RUNNER_SQL}) q WHERE score_rank = 1) r ON b.dispatch_id = r.did"""),
)
def prj_explanation(spark: SparkSession, sf: str) -> DataFrame:
    joined = best(spark, sf).join(runner_up(spark, sf).drop("first_id"), "dispatch_id")
    return joined.selectExpr("dispatch_id", f"{wording.EXPLANATION} AS explanation")


WITHIN_KM = DEFAULT_RULES.hard_max_km


@query(
    "join_within_radius",
    with_views("technicians", f"""SELECT a.technician_id, count(b.technician_id) AS n_within FROM technicians a LEFT JOIN technicians b
    ON a.technician_id <> b.technician_id AND {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= {WITHIN_KM} GROUP BY 1"""),
)
def join_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    from brightloom.operators import radius

    return radius.neighbour_counts(A.technicians(spark, sf), "technician_id", WITHIN_KM)


# --- whole flow ---------------------------------------------------------------------------------------
@query(
    "pipe_optimize",
    with_views("optimized", f"""SELECT dispatch_id, optimized_technician_id, constraint_status, optimization_status, all_constraints_met,
    {r4s('optimized_score', 'travel_cost', 'workload_cost', 'success_risk_cost', 'duration_cost')}, {REASON_SQL} AS reason FROM optimized"""),
)
def pipe_optimize(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "optimize")
    tables.overwrite(optimize(spark, sf), path, 1)
    return tables.read_latest(spark, path).selectExpr(
        "dispatch_id", "optimized_technician_id", "constraint_status", "optimization_status", "all_constraints_met",
        *r4("optimized_score", "travel_cost", "workload_cost", "success_risk_cost", "duration_cost"), f"{wording.REASON} AS reason",
    )
