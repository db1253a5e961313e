"""Ticket intake as a stream: every micro-batch runs the whole dispatch flow on its own tickets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom import config as C
from brightloom.functions import wording
from brightloom.functions.scoring import Scorer
from brightloom.operators import assignment, ranking
from brightloom.session import cut_lineage, small_side
from brightloom.sources import tables, tickets

_TO_DISPATCH = (
    "Dispatch_id AS dispatch_id", "Ticket_type AS ticket_type", "Order_type AS order_type", "Priority AS priority",
    "Required_skill AS required_skill", "City AS city", "State AS state", "Customer_latitude AS customer_latitude",
    "Customer_longitude AS customer_longitude", "Appointment_start_datetime AS appointment_start", "Duration_min AS duration_min",
)
# result field -> expression over the winner's columns
_RESULT = {
    "Optimized_technician_id": "CAST(technician_id AS STRING)", "Optimized_technician_name": "technician_name",
    "Optimization_constraint_status": "constraint_level", "Optimization_constraints_passed": "constraints_passed",
    "Optimized_score": "final_score", "Optimized_distance_km": "distance_km", "Optimized_utilization": "utilization",
    "Optimized_p_productive": "p_productive", "Optimized_p_ftf": "p_ftf", "Optimized_quality_score": "quality_score",
    "Optimized_travel_cost": "travel_cost", "Optimized_workload_cost": "workload_cost",
    "Optimized_success_risk_cost": "success_risk_cost", "Optimized_duration_cost": "duration_cost",
    "Optimized_priority_weight": "priority_weight", "Optimization_skill_match": "skill_match",
    "Optimization_capacity_available": "capacity_available", "Optimization_calendar_available": "calendar_available",
    "Optimization_distance_ok": "distance_ok",
    "Optimization_reason": f"coalesce({wording.SHORT_REASON}, '{wording.NO_TECHNICIAN}')",
    "explanation": f"CASE WHEN technician_id IS NULL THEN '{wording.NO_EXPLANATION}' ELSE {wording.EXPLANATION} END",
}


REPEATED = "another ticket of the batch has this key"
NO_KEY = "Ticket key is required"
# batches of the n-th checkpoint over a folder are numbered from n times this on
EPOCH = 1 << 32


@dataclass(frozen=True)
class Intake:
    """Where tickets go, and what they are matched against.

    ``calendar`` and ``technicians`` are functions, so that each batch reads the current tables.
    """

    path: str
    calendar: Callable[[SparkSession], DataFrame]
    technicians: Callable[[SparkSession], DataFrame]
    scorer: Scorer | None = None
    rules: C.DispatchRules = C.DEFAULT_RULES

    @property
    def tickets(self) -> str:
        return f"{self.path}/tickets"

    @property
    def rejects(self) -> str:
        return f"{self.path}/rejects"

    @property
    def ids(self) -> str:
        """The ledger: (ticket_key, Dispatch_id, batch) of every key's first batch."""
        return f"{self.path}/ids"

    @property
    def marks(self) -> str:
        """(top, batch): the highest id after each batch, one row per batch."""
        return f"{self.path}/marks"

    @property
    def epochs(self) -> str:
        return f"{self.path}/epochs"

    def current(self, spark: SparkSession) -> DataFrame:
        """One row per dispatch: its state after the last batch that had its ticket."""
        rows = spark.read.parquet(self.tickets)
        last = rows.groupBy(F.col("Dispatch_id").alias("_id")).agg(F.max("batch").alias("_batch"))
        return rows.join(last, F.expr("Dispatch_id = _id AND batch = _batch")).drop("_id", "_batch")

    def run_batch(self, raw: DataFrame, batch_id: int) -> None:
        """Validate, number, match, explain and write one batch.

        A ticket_key of an earlier batch keeps its id and gets a new state, see ``current``. Other ids
        follow the high-water mark of the *earlier* batches, and each batch owns one folder per sink, so
        a repeated batch gives the same rows in the same place. A ticket without a key is rejected.
        """
        spark = raw.sparkSession
        no_key = f"CASE WHEN ticket_key IS NULL THEN array_append(errors, '{NO_KEY}') ELSE errors END"
        checked = cut_lineage(tickets.with_errors(raw).withColumn("errors", F.expr(no_key)))
        # of several valid tickets with one key the first by content goes on, the others are rejected;
        # rejected ones need no place, so no group is larger than the valid tickets of one key
        content = F.to_json(F.struct(*[c for c in checked.columns if c != "errors"]))
        place = F.row_number().over(Window.partitionBy("ticket_key").orderBy(content))
        valid = checked.filter("size(errors) = 0")
        ranked = cut_lineage(valid.withColumn("_place", place))
        repeated = ranked.filter("_place > 1").withColumn("errors", F.array(F.lit(REPEATED))).drop("_place")
        tables.write_batch(checked.filter("size(errors) > 0").unionByName(repeated), self.rejects, batch_id)
        valid = ranked.filter("_place = 1").drop("errors", "_place")
        before = self._before(spark, self.marks, "top long", batch_id).agg(F.max("top").alias("top")).first().top
        top = C.FIRST_FREE_ID if before is None else before
        known = self._before(spark, self.ids, "ticket_key long, Dispatch_id long", batch_id).selectExpr("ticket_key AS _key", "Dispatch_id AS _id")
        met = cut_lineage(valid.join(known, F.col("ticket_key") == F.col("_key"), "left").drop("_key"))
        new = cut_lineage(ranking.ids_after(met.filter("_id IS NULL").drop("_id"), top, "ticket_key"))
        tables.write_batch(new.selectExpr("CAST(ticket_key AS BIGINT) AS ticket_key", "CAST(new_id AS BIGINT) AS Dispatch_id"), self.ids, batch_id)
        tables.write_batch(new.agg(F.expr(f"CAST(coalesce(max(new_id), {top}) AS BIGINT) AS top")), self.marks, batch_id)
        numbered = new.unionByName(met.filter("_id IS NOT NULL").withColumnRenamed("_id", "new_id"))
        typed = cut_lineage(tickets.typed_tickets(numbered, "new_id"))
        finished, supply = self._finished(typed)
        tables.write_batch(finished, self.tickets, batch_id)
        supply.release()

    @staticmethod
    def _before(spark: SparkSession, path: str, columns: str, batch_id: int) -> DataFrame:
        """What earlier batches wrote to ``path``; nothing if there is none yet."""
        schema = f"{columns}, batch long"
        try:
            rows = spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        return rows.filter(F.col("batch") < batch_id)

    def _finished(self, typed: DataFrame) -> tuple[DataFrame, assignment.Supply]:
        spark = typed.sparkSession
        d = typed.selectExpr(*_TO_DISPATCH)
        # only the days of the batch, stored once for both searches
        dates = small_side(d.selectExpr("to_date(appointment_start) AS date").distinct())
        calendar = self.calendar(spark).join(dates, "date", "left_semi")
        supply = assignment.supply_for(d, calendar, self.technicians(spark), self.rules)
        best = assignment.best_of(supply, self.scorer, self.rules)
        second = assignment.top_of(supply, 2, self.scorer, self.rules).filter("score_rank = 2").selectExpr(
            "dispatch_id", "technician_name AS alt_name", "distance_km AS alt_km", "utilization AS alt_utilization", "final_score AS alt_score"
        )
        counts = supply.counted().select("dispatch_id", F.col("n_day").alias("n_candidates"))
        found = best.join(counts, "dispatch_id").join(second, "dispatch_id", "left")
        result = found.selectExpr("dispatch_id AS _id", *[f"{sql} AS _{name}" for name, sql in _RESULT.items()])
        joined = typed.join(result, F.expr("Dispatch_id = _id"), "left")
        given = {n: f"_{n}" for n in _RESULT if n not in ("Optimization_reason", "explanation")}
        given["Optimization_status"] = "'Complete'"
        given["Optimization_reason"] = f"coalesce(_Optimization_reason, '{wording.NO_TECHNICIAN}')"
        given["All_constraints_met"] = "coalesce(_Optimization_constraint_status = 'ALL_CONSTRAINTS_MET', false)"
        return joined.selectExpr(
            *[f"{given[n]} AS {n}" if n in given else n for n, _ in tickets.DISPATCH_FIELDS],
            f"coalesce(_explanation, '{wording.NO_EXPLANATION}') AS explanation",
        ), supply

    def _epoch(self, spark: SparkSession, checkpoint: str) -> int:
        """Which checkpoint over this folder it is, from 0. Its number lies in the checkpoint itself, so
        that a new one never repeats the batch numbers, and with them the ids, of another."""
        mine = f"{checkpoint.rstrip('/')}/epoch"
        own = self._before(spark, mine, "epoch long", EPOCH)
        found = own.first()
        if found is not None:
            return found.epoch
        last = self._before(spark, self.epochs, "epoch long", EPOCH).agg(F.max("epoch").alias("last")).first().last
        epoch = 0 if last is None else last + 1
        named = spark.range(1).selectExpr(f"{epoch}L AS epoch")
        tables.write_batch(named, self.epochs, epoch)
        tables.write_batch(named, mine, 0)
        return epoch

    def start(self, raw_stream: DataFrame, checkpoint: str):
        """Everything that is there now, then stop; a restart with the same checkpoint goes on from there.

        A new checkpoint over the same folder goes on after the batches of the earlier ones.
        """
        first = EPOCH * self._epoch(raw_stream.sparkSession, checkpoint)
        return (
            raw_stream.writeStream.foreachBatch(lambda raw, batch_id: self.run_batch(raw, first + batch_id))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
