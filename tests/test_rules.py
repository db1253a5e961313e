"""Edge values of the rules."""

import math

from pyspark.sql import functions as F

from brightloom.functions import scoring, wording
from brightloom.functions.geo import haversine_km
from brightloom.operators import features as X
from brightloom.operators import insights as I
from brightloom.operators import metrics as M
from brightloom.operators.cube import _to_grid


def values(spark, column, kind, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} {kind}")
    return [r.v for r in df.selectExpr("i", f"{expr} AS v").orderBy("i").collect()]


def test_bins_are_right_closed(spark):
    got = values(spark, "d", "long", [0, 60, 61, 1000, None], X.binned("d", X.DURATION_BINS))
    assert got == ["nan", "short", "medium", "nan", "nan"]


def test_distance_bands(spark):
    assert values(spark, "distance_km", "double", [10.0, 20.0, 40.0, 40.1], wording.PROXIMITY_BAND) == ["excellent", "good", "moderate", "far"]


def test_utilization_bands(spark):
    got = values(spark, "utilization", "double", [0.4, 0.7, 0.9, None], I.UTILIZATION_BAND)
    assert [g.split(" ")[0] for g in got] == ["Well-balanced", "High", "Over-utilized", "Over-utilized"]


def test_hours(spark):
    rows = [f"2024-01-01 {h:02d}:00:00" for h in (0, 8, 12, 16, 20)] + [None]
    got = values(spark, "t", "string", rows, I.TIME_WINDOW.replace("appointment_start", "CAST(t AS TIMESTAMP)"))
    assert [g.split(" ")[0] for g in got] == ["Early", "Morning", "Afternoon", "Evening", "Late", "Late"]


def test_priority(spark):
    assert values(spark, "priority", "string", ["Critical", "High", "Normal", "Low", "Medium", None], scoring.priority_weight()) == [3.0, 2.0, 1.0, 0.5, 1.0, 1.0]


def test_distance(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (1.0, 2.0, 1.0, 2.0), (1.0, 2.0, 1.0, None)], "a double, b double, c double, d double")
    got = [r.v for r in rows.selectExpr(f"{haversine_km('a', 'b', 'c', 'd')} AS v").collect()]
    assert abs(got[0] - math.pi * 6371) < 1e-6 and got[1] == 0 and got[2] is None


def test_missing_longitude_and_zero_capacity(spark):
    row = spark.sql(
        """SELECT DATE '2024-01-01' AS date, 'A' AS required_skill, 'A' AS primary_skill, 3 AS current_assignments, 0 AS workload_capacity, 1 AS available,
        40D AS latitude, CAST(NULL AS DOUBLE) AS longitude, 40D AS customer_latitude, 1D AS customer_longitude, 60 AS duration_min, 'Low' AS priority, 'x' AS city, 'x' AS tech_city"""
    )
    r = scoring.score_pairs(row, scoring.linear_scorer()).first()
    assert r.distance_km is None and r.distance_ok == 0 and r.utilization == 0.0 and r.constraint_level == "FAILED_CAPACITY"


def test_workload_cost(spark):
    got = values(spark, "u", "double", [0.1, 0.4, 0.9, 1.0], scoring.workload_cost("u"))
    assert [round(g, 6) for g in got] == [2.4, 0.0, 0.0, 1.5]


def test_half_even_grid():
    assert [_to_grid(v) for v in (125, -25, 135)] == [120, -20, 140]


def test_encoding(spark):
    rows = spark.createDataFrame([("b",), (None,), ("it's",)], "c string")
    codes = X.fit_encoders(rows, ("c",))
    assert codes == {"c": ["MISSING", "b", "it's"]}
    assert values(spark, "c", "string", ["b", None, "zzz", "it's"], X.encoded("c", codes["c"])) == [1, 0, -1, 2]


def test_equal_scores_rank_evenly(spark):
    r = M.ranking_metrics(spark.createDataFrame([(0.7, 0), (0.7, 1)], "p double, y int"), "p", "y").first()
    assert r.roc_auc == 0.5 and r.accuracy == 0.5


def test_ranking_metrics_against_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).selectExpr("round(pmod(id * 7919, 1009) / 1009D, 2) AS p", "CAST(pmod(id * 31, 7) < 3 AS INT) AS y", "id").selectExpr(
        "CASE WHEN y = 1 THEN least(1D, p + 0.1D) ELSE p END AS p", "y", "CAST(y AS DOUBLE) AS label"
    )
    auc = M.ranking_metrics(df, "p", "y", buckets=50).first().roc_auc
    other = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(df)
    assert abs(auc - other) < 1e-9


def test_early_stop_keeps_the_best_epoch(spark):
    losses = [5.0, 4.0, 4.5, 4.4, 4.3, 4.2, 4.1, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(losses)], "s string, epoch int, loss double")
    r = M.early_stop(df, ["s"], "epoch", "loss", 5).first()
    assert (r.stopped_at, r.best_epoch, r.best_loss) == (6, 1, 4.0)


def test_first_not_met_constraint_decides(spark):
    flags = ("has_date", "skill_match", "capacity_available", "calendar_available", "distance_ok")
    rows = [tuple(0 if i == j else 1 for i in range(5)) for j in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in flags))
    got = [r.v for r in df.withColumn("v", F.expr(scoring.CONSTRAINT_LEVEL)).collect()]
    assert got == ["NO_DATE_MATCH", "FAILED_SKILL", "FAILED_CAPACITY", "FAILED_AVAILABILITY", "FAILED_DISTANCE", "ALL_CONSTRAINTS_MET"]
