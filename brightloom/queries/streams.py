"""Stream queries: the given orders arrive as raw tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom import adapters as A
from brightloom.queries.base import query
from brightloom.queries.dispatch import ERRORS_SQL, RAW_SQL, num_sql, r4, r4s, raw_tickets
from brightloom.queries.views_sql import LEVEL_RANK_SQL, PAIRS_SQL, SCORED_SQL, view, with_views
from brightloom.session import fresh_path
from brightloom.streaming.intake import Intake

_RUNS: dict[tuple[str, str], Intake] = {}


def intake_run(spark: SparkSession, sf: str) -> Intake:
    """The stream over the orders file, run to its end once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        path = fresh_path(spark, "intake")
        run = Intake(f"{path}/out", lambda s: A.tech_calendar(s, sf), lambda s: A.technicians(s, sf))
        schema = A.table(spark, sf, "orders").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
        run.start(raw_tickets(spark, sf, stream), f"{path}/checkpoint").awaitTermination()
        _RUNS[key] = run
    return _RUNS[key]


view("tickets", "", f"""SELECT 200000000 + row_number() OVER (ORDER BY r.ticket_key) AS dispatch_id, r.ticket_type,
  CASE WHEN r.ticket_key % 2 = 0 THEN 'install' ELSE 'repair' END AS order_type,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' ELSE 'Low' END AS priority,
  'SKILL_' || CAST(r.o_custkey % 9 AS VARCHAR) AS required_skill, 'City ' || CAST(r.o_custkey % 25 AS VARCHAR) AS city, 'NJ' AS state,
  CAST(40 AS DOUBLE) + ((r.o_custkey * 6151) % 1000) / CAST(1000 AS DOUBLE) AS customer_latitude,
  -(CAST(74 AS DOUBLE) + ((r.o_custkey * 3571) % 1000) / CAST(1000 AS DOUBLE)) AS customer_longitude,
  r.o_orderdate + INTERVAL '1' HOUR * CAST(6 + r.ticket_key % 16 AS INT) + INTERVAL '30' MINUTE AS appointment_start,
  30 * (1 + r.ticket_key % 6) AS duration_min
  FROM ({RAW_SQL}) r JOIN orders o ON o.o_orderkey = r.ticket_key WHERE NOT (no_street OR no_city OR no_postal OR bad_place OR bad_time)""")
view("ticket_pairs", "tickets tech_calendar technicians", PAIRS_SQL.format(src="tickets"))
view("ticket_candidates", "ticket_pairs", SCORED_SQL.format(src="ticket_pairs"))
view("ticket_best", "ticket_candidates", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dispatch_id ORDER BY {LEVEL_RANK_SQL}, round(final_score, 6) DESC, technician_id) AS rn
  FROM ticket_candidates WHERE technician_id IS NOT NULL) z WHERE rn = 1""")


@query(
    "stream_ticket_intake",
    with_views("tickets ticket_best", f"""SELECT t.dispatch_id, CAST(b.technician_id AS VARCHAR) AS optimized_technician_id, b.constraint_level AS constraint_status,
    {r4s('b.final_score').replace('AS b.', 'AS ')}, 'Complete' AS optimization_status, coalesce(b.constraint_level = 'ALL_CONSTRAINTS_MET', FALSE) AS all_constraints_met,
    CASE WHEN b.technician_id IS NULL THEN 'No feasible technicians found' WHEN b.constraint_level = 'ALL_CONSTRAINTS_MET' THEN 'Optimal: All constraints met, score=' || {num_sql('b.final_score', 2)}
    ELSE 'Partial: ' || b.constraint_level || ', ' || b.constraints_passed || '/4 constraints' END AS reason,
    42 AS n_fields, b.technician_id IS NOT NULL AS explained FROM tickets t LEFT JOIN ticket_best b ON t.dispatch_id = b.dispatch_id"""),
)
def stream_ticket_intake(spark: SparkSession, sf: str) -> DataFrame:
    rows = intake_run(spark, sf).current(spark)
    return rows.selectExpr(
        "Dispatch_id AS dispatch_id", "Optimized_technician_id AS optimized_technician_id", "Optimization_constraint_status AS constraint_status",
        "Optimized_score AS final_score", "Optimization_status AS optimization_status", "All_constraints_met AS all_constraints_met",
        "Optimization_reason AS reason", f"{len(rows.columns) - 2} AS n_fields", "explanation LIKE '%Final Recommendation%' AS explained",
    ).selectExpr(
        "dispatch_id", "optimized_technician_id", "constraint_status", *r4("final_score"), "optimization_status", "all_constraints_met",
        "reason", "n_fields", "explained",
    )


@query(
    "stream_reject_sink",
    f"SELECT ticket_key, errors FROM (SELECT ticket_key, {ERRORS_SQL} AS errors FROM ({RAW_SQL}) r) e WHERE errors <> ''",
)
def stream_reject_sink(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(intake_run(spark, sf).rejects).selectExpr("ticket_key", "concat_ws('; ', errors) AS errors")
