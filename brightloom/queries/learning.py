"""Feature, metric, split and model queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import adapters as A
from brightloom.functions.scoring import sigmoid
from brightloom.operators import assignment as S
from brightloom.operators import features as X
from brightloom.operators import metrics as M
from brightloom.operators import models, splits
from brightloom.queries.base import query, written
from brightloom.queries.dispatch import proposed, r4, r4s
from brightloom.queries.views_sql import haversine_sql, view, with_views
from brightloom.session import fresh_path
from brightloom.sources import cubes, tables

CONFIG = models.TrainConfig()


def history(spark: SparkSession, sf: str) -> DataFrame:
    return X.training_rows(A.dispatch_history(spark, sf), A.technicians(spark, sf))


def _cases(column: str, bins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{n}'" for lo, hi, n in bins) + " ELSE 'nan' END"


view("rows_raw", "dispatch_history technicians", f"""
SELECT *, {_cases('distance_km', X.DISTANCE_BINS)} AS distance_category FROM (
SELECT h.*, t.technician_id, t.primary_skill AS technician_skill, t.city AS technician_city, t.state AS technician_state,
  t.workload_capacity AS technician_workload_capacity, t.current_assignments AS technician_current_assignments,
  {haversine_sql('t.latitude', 't.longitude', 'h.customer_latitude', 'h.customer_longitude')} AS distance_km,
  CASE WHEN h.required_skill = t.primary_skill THEN 1 ELSE 0 END AS skill_match, CASE WHEN h.dispatch_city = t.city THEN 1 ELSE 0 END AS city_match,
  CASE WHEN h.dispatch_state = t.state THEN 1 ELSE 0 END AS state_match, t.current_assignments / CAST(t.workload_capacity AS DOUBLE) AS workload_utilization,
  CAST(hour(h.appointment_start) AS INT) AS appointment_hour, CAST(isodow(h.appointment_start) - 1 AS INT) AS appointment_day_of_week,
  {_cases('duration_min', X.DURATION_BINS)} AS duration_category
  FROM dispatch_history h JOIN technicians t ON h.assigned_technician_id = t.technician_id
  WHERE h.productive_dispatch IS NOT NULL AND h.first_time_fix IS NOT NULL) a""")
for c in X.CATEGORICAL:
    view(f"codes_{c}", "rows_raw", f"SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'MISSING') AS v FROM rows_raw) d")
PLAIN = [f for f in X.FEATURES if not f.endswith("_encoded")]
view("matrix", "rows_raw " + " ".join(f"codes_{c}" for c in X.CATEGORICAL), f"""
SELECT r.dispatch_id, r.technician_id, r.productive_dispatch, r.first_time_fix, {', '.join(f'CAST(coalesce(r.{f}, -1) AS DOUBLE) AS {f}' for f in PLAIN)},
  {', '.join(f'CAST(c_{c}.code AS DOUBLE) AS {c}_encoded' for c in X.CATEGORICAL)} FROM rows_raw r
  {' '.join(f"JOIN codes_{c} c_{c} ON c_{c}.v = coalesce(r.{c}, 'MISSING')" for c in X.CATEGORICAL)}""")


# --- projections ---------------------------------------------------------------------------------------------
@query("prj_match_flags", with_views("rows_raw", "SELECT dispatch_id, technician_id, skill_match, city_match, state_match FROM rows_raw"))
def prj_match_flags(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_raw_features(history(spark, sf)).select("dispatch_id", "technician_id", "skill_match", "city_match", "state_match")


@query("fn_hour_weekday", with_views("dispatches", "SELECT dispatch_id, CAST(hour(appointment_start) AS INT) AS hour, CAST(isodow(appointment_start) - 1 AS INT) AS weekday FROM dispatches"))
def fn_hour_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return A.dispatches(spark, sf).selectExpr("dispatch_id", "hour(appointment_start) AS hour", "weekday(appointment_start) AS weekday")


@query("fn_bin_duration", with_views("rows_raw", "SELECT dispatch_id, duration_min, duration_category FROM rows_raw"))
def fn_bin_duration(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_raw_features(history(spark, sf)).select("dispatch_id", "duration_min", "duration_category")


@query("fn_bin_distance", with_views("rows_raw", f"SELECT dispatch_id, {r4s('distance_km')}, distance_category FROM rows_raw"))
def fn_bin_distance(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_raw_features(history(spark, sf)).selectExpr("dispatch_id", *r4("distance_km"), "distance_category")


@query(
    "fn_label_encode",
    with_views("dispatches technicians", """SELECT d.dispatch_id, d.required_skill, CAST(coalesce(c.code, -1) AS INT) AS code FROM dispatches d LEFT JOIN
    (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT primary_skill AS v FROM technicians) s) c ON d.required_skill = c.v"""),
)
def fn_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    # fitted on the technicians' skills: a skill that nobody has is unseen
    codes = X.fit_encoders(A.technicians(spark, sf).withColumnRenamed("primary_skill", "required_skill"), ("required_skill",))
    return A.dispatches(spark, sf).selectExpr("dispatch_id", "required_skill", f"{X.encoded('required_skill', codes['required_skill'])} AS code")


@query(
    "fn_fill_missing",
    with_views("dispatches", """SELECT dispatch_id, round(coalesce(customer_latitude, -1), 4) AS customer_latitude, coalesce(prior_technician_id, 'MISSING') AS prior,
    CASE WHEN customer_latitude IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS score FROM dispatches"""),
)
def fn_fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    d = A.dispatches(spark, sf).selectExpr(
        "dispatch_id", "customer_latitude", "prior_technician_id AS prior", "CASE WHEN customer_latitude IS NOT NULL THEN 0.9D END AS score"
    )
    return d.fillna({"customer_latitude": -1.0, "prior": X.MISSING, "score": 0.5}).withColumn("customer_latitude", F.expr("round(customer_latitude, 4)"))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    def build(s: SparkSession, d: str) -> DataFrame:
        rows = history(s, d)
        encoders = X.fit_encoders(X.with_raw_features(rows))
        return X.feature_matrix(rows, encoders, ["dispatch_id", "technician_id", *models.LABELS.values()])

    return written(spark, sf, "matrix", build)


@query("ml_feature_matrix", with_views("matrix", f"SELECT dispatch_id, technician_id, {r4s(*X.FEATURES)} FROM matrix"))
def ml_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark, sf).selectExpr("dispatch_id", "technician_id", *r4(*X.FEATURES))


@query(
    "agg_feature_stats",
    with_views("matrix", " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std, round(min({f}), 4) AS min, round(max({f}), 4) AS max FROM matrix" for f in X.FEATURES)),
)
def agg_feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return X.feature_stats(matrix(spark, sf)).selectExpr("feature", *[f"round({c}, 4) AS {c}" for c in ("mean", "std", "min", "max")])


# --- metrics -----------------------------------------------------------------------------------------------------
SCORE = "round((technician_id % 97) / 97D * 0.5D + 0.3D * skill_match + 0.1D, 3)"
SCORE_SQL = "round((technician_id % 97) / CAST(97 AS DOUBLE) * 0.5 + CAST(0.3 AS DOUBLE) * skill_match + 0.1, 3)"


@query(
    "agg_auc_metrics",
    with_views("rows_raw", f"""WITH g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg, sum(CASE WHEN (s >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS hits
      FROM (SELECT {SCORE_SQL} AS s, productive_dispatch AS y FROM rows_raw) r GROUP BY s),
    c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM g)
    SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc,
      round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos), 6) AS pr_auc, round(sum(hits) / CAST(sum(pos + neg) AS DOUBLE), 6) AS accuracy FROM c"""),
)
def agg_auc_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = X.with_raw_features(history(spark, sf)).selectExpr(f"{SCORE} AS p", "productive_dispatch AS y")
    return M.ranking_metrics(scored, "p", "y").selectExpr(*[f"round({c}, 6) AS {c}" for c in ("roc_auc", "pr_auc", "accuracy")])


@query("agg_mean_scores", with_views("proposed_scored", "SELECT count(*) AS n, round(avg(p_productive), 4) AS avg_p_productive, round(avg(p_ftf), 4) AS avg_p_ftf FROM proposed_scored"))
def agg_mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return models.mean_scores(proposed(spark, sf)).selectExpr("n", *[f"round({c}, 4) AS {c}" for c in ("avg_p_productive", "avg_p_ftf")])


W = [0.02, 0.8, -0.5]
SIGNAL_SQL = "(CAST(0.02 AS DOUBLE) + CAST(0.8 AS DOUBLE) * x1 - CAST(0.5 AS DOUBLE) * x2)"


@query("agg_class_error", with_views("labeled_points", f"SELECT round(avg(CASE WHEN y * {SIGNAL_SQL} < 0 THEN 1 ELSE 0 END), 6) AS error FROM labeled_points"))
def agg_class_error(spark: SparkSession, sf: str) -> DataFrame:
    return A.labeled_points(spark, sf).agg(F.expr(f"round({M.class_error(M.dot(W, models.POINT))}, 6) AS error"))


@query("agg_log_loss", with_views("labeled_points", f"SELECT round(avg(ln(1 + exp(-y * {SIGNAL_SQL}))), 6) AS loss FROM labeled_points"))
def agg_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return A.labeled_points(spark, sf).agg(F.expr(f"round({M.log_loss(M.dot(W, models.POINT))}, 6) AS loss"))


@query("agg_rowwise_min_mean", "SELECT round(avg(l_discount), 6) AS e1, round(avg(l_tax), 6) AS e2, round(avg(least(l_discount, l_tax)), 6) AS e FROM lineitem")
def agg_rowwise_min_mean(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").agg(
        F.expr("round(avg(l_discount), 6) AS e1"), F.expr("round(avg(l_tax), 6) AS e2"), F.expr("round(avg(least(l_discount, l_tax)), 6) AS e")
    )


@query(
    "agg_paired_win_rate",
    """SELECT round(avg(CASE WHEN b < a THEN CAST(100 AS DOUBLE) ELSE 0 END), 6) AS win_pct, round(avg(third), 6) AS mean_third FROM
    (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b, count(*) AS third FROM lineitem GROUP BY 1) t""",
)
def agg_paired_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    # an order is a trial; two kinds of flagged lines are the errors of two models
    trials = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.expr("sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a"), F.expr("sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b"), F.expr("count(*) AS third")
    )
    return trials.agg(F.expr("round(avg(CASE WHEN b < a THEN 100D ELSE 0D END), 6) AS win_pct"), F.expr("round(avg(third), 6) AS mean_third"))


SQL_TERMS = ["CAST(1 AS DOUBLE)", "x1", "x2", "x1 * x1", "x2 * x2", "x1 * x2", "abs(x1 - x2)", "abs(x1 + x2)"]


@query(
    "agg_normal_equations",
    with_views("labeled_points", " UNION ALL ".join(
        [f"SELECT {i} AS i, {j} AS j, round(sum({SQL_TERMS[i]} * {SQL_TERMS[j]}) + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS value FROM labeled_points" for i in range(8) for j in range(i, 8)]
        + [f"SELECT {i} AS i, -1 AS j, round(sum({SQL_TERMS[i]} * y) + CAST(1e-9 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS value FROM labeled_points" for i in range(8)])),
)
def agg_normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    return M.normal_sums(A.labeled_points(spark, sf)).selectExpr("i", "j", *r4("value"))


# --- vectors --------------------------------------------------------------------------------------------------------
@query("fn_nonlinear_features", with_views("labeled_points", "SELECT row_id, " + ", ".join(f"round({t}, 6) + CAST(0 AS DOUBLE) AS z{i}" for i, t in enumerate(SQL_TERMS)) + " FROM labeled_points"))
def fn_nonlinear_features(spark: SparkSession, sf: str) -> DataFrame:
    z = A.labeled_points(spark, sf).selectExpr("row_id", f"{M.nonlinear(7)} AS z")
    return z.selectExpr("row_id", *[f"round(z[{i}], 6) + 0D AS z{i}" for i in range(8)])


@query(
    "fn_linear_sign",
    with_views("labeled_points", f"""SELECT row_id, CAST(sign({SIGNAL_SQL}) AS INT) AS side, CAST(sign(CAST(0.1 AS DOUBLE) * x2 - x1 * CAST(0.2 AS DOUBLE) + (CAST(0.2 AS DOUBLE) - x2) * CAST(0.5 AS DOUBLE)
    + (x1 - CAST(0.1 AS DOUBLE)) * CAST(-0.5 AS DOUBLE)) AS INT) AS line_side FROM labeled_points"""),
)
def fn_linear_sign(spark: SparkSession, sf: str) -> DataFrame:
    # on which side (0.5, -0.5) lies of the line through the point and (0.1, 0.2)
    w = M.line_through("x1", "x2", "0.1D", "0.2D")
    return A.labeled_points(spark, sf).selectExpr(
        "row_id", f"CAST(sign({M.dot(W, models.POINT)}) AS INT) AS side",
        f"CAST(sign({w[0]} + ({w[1]}) * 0.5D + ({w[2]}) * -0.5D) AS INT) AS line_side",
    )


@query("fn_sigmoid", with_views("labeled_points", f"SELECT row_id, round(1 / (1 + exp(-{SIGNAL_SQL})), 6) AS h FROM labeled_points"))
def fn_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return A.labeled_points(spark, sf).selectExpr("row_id", f"round({sigmoid(M.dot(W, models.POINT))}, 6) AS h")


@query("fn_one_hot", "SELECT vec_id, list_aggregate(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), 'string_agg', '') AS hot FROM embeddings")
def fn_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    hot = "transform(sequence(0, 9), i -> CAST(i = label AS INT))"
    return A.table(spark, sf, "embeddings").selectExpr("vec_id", f"array_join(transform({hot}, b -> CAST(b AS STRING)), '') AS hot")


@query(
    "fn_argmax_label",
    "SELECT vec_id, 'class_' || (list_position(embedding, list_max(embedding)) - 1) AS label FROM embeddings",
)
def fn_argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    # one name per entry of the vector, as a classifier's head has one output per class
    names = "transform(sequence(0, size(embedding) - 1), i -> concat('class_', i))"
    return A.table(spark, sf, "embeddings").selectExpr(
        "vec_id", f"{names}[CAST(array_position(embedding, array_max(embedding)) AS INT) - 1] AS label"
    )


@query("set_stack_classes", "SELECT vec_id, CASE WHEN label < 3 THEN 0 WHEN label < 7 THEN 1 ELSE 2 END AS class FROM embeddings")
def set_stack_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    groups = ("label < 3", "label >= 3 AND label < 7", "label >= 7")
    a, b, c = (e.filter(g).selectExpr("vec_id", f"{i} AS class") for i, g in enumerate(groups))
    return a.unionByName(b).unionByName(c)


# folder names of the three classes
CLASSES = ("bogus", "real", "platypus")


@query(
    "src_labeled_files",
    """SELECT CASE WHEN label < 3 THEN 0 WHEN label < 7 THEN 1 ELSE 2 END AS label, count(*) AS n, round(sum(list_sum(embedding)), 2) AS total
    FROM (SELECT label, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4)) AS embedding FROM embeddings) e GROUP BY 1""",
)
def src_labeled_files(spark: SparkSession, sf: str) -> DataFrame:
    # class folders of text arrays, written from the embeddings
    path = fresh_path(spark, "stamps")
    rows = A.table(spark, sf, "embeddings").selectExpr(
        f"CASE WHEN label < 3 THEN '{CLASSES[0]}' WHEN label < 7 THEN '{CLASSES[1]}' ELSE '{CLASSES[2]}' END AS class",
        "array_join(transform(embedding, v -> format_string('%.4f', round(CAST(v AS DOUBLE), 4))), ' ') AS value",
    )
    rows.write.option("maxRecordsPerFile", 1000).partitionBy("class").text(path)
    arrays = cubes.read_labeled_arrays(spark, path, list(CLASSES), "*.txt")
    return arrays.groupBy("label").agg(
        F.expr("sum(shape[0]) AS n"), F.expr("round(sum(aggregate(pixels, 0D, (a, v) -> a + v)), 2) AS total")
    )


# --- splits --------------------------------------------------------------------------------------------------------------
KEY_SPACE = 1_000_003


@query(
    "set_stratified_split",
    with_views("dispatch_history", f"""SELECT dispatch_id, productive_dispatch, CASE WHEN rn <= floor(n * 0.2) THEN 'test' WHEN rn <= floor(n * 0.2) + floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM
    (SELECT dispatch_id, productive_dispatch, row_number() OVER (PARTITION BY productive_dispatch ORDER BY (dispatch_id * 7919 + 104729) % {KEY_SPACE}, dispatch_id) AS rn,
      count(*) OVER (PARTITION BY productive_dispatch) AS n FROM dispatch_history WHERE productive_dispatch IS NOT NULL) r"""),
)
def set_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.dispatch_history(spark, sf).select("dispatch_id", "productive_dispatch").dropna()
    # a key both engines can compute, in place of the default hash
    return splits.stratified_split(rows, "productive_dispatch", "dispatch_id", key=f"(dispatch_id * 7919 + 104729) % {KEY_SPACE}", key_space=KEY_SPACE)


@query(
    "set_random_split",
    "SELECT vec_id, CASE WHEN (vec_id * 7919 + 42) % 100 < 81 THEN 'train' WHEN (vec_id * 7919 + 42) % 100 < 90 THEN 'validation' ELSE 'test' END AS split FROM embeddings",
)
def set_random_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_split(A.table(spark, sf, "embeddings").select("vec_id"), "vec_id", key="pmod(vec_id * 7919 + 42, 100L)")


@query("set_positional_split", with_views("labeled_points", "SELECT row_id, y, CASE WHEN row_number() OVER (ORDER BY row_id) <= 25 THEN 'first' ELSE 'rest' END AS part FROM labeled_points"))
def set_positional_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.positional_split(A.labeled_points(spark, sf).select("row_id", "y"), "row_id", 25)


@query("top_latest", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def top_latest(spark: SparkSession, sf: str) -> DataFrame:
    latest = A.table(spark, sf, "orders").agg(F.expr("max(struct(o_orderdate, o_orderkey)) AS m"))
    return latest.selectExpr("m.o_orderkey AS o_orderkey", "CAST(to_date(m.o_orderdate) AS STRING) AS day")


@query("src_matrix_text", with_views("labeled_points", "SELECT round(x1, 5) AS x1, round(x2, 5) AS x2, CAST(y AS DOUBLE) AS y FROM labeled_points"))
def src_matrix_text(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "matrix-text")
    tables.write_matrix(A.labeled_points(spark, sf).select("x1", "x2", "y"), path)
    return tables.read_matrix(spark, path, ["x1", "x2", "y"]).selectExpr("round(x1, 5) AS x1", "round(x2, 5) AS x2", "y")


@query(
    "ml_early_stop",
    """WITH l AS (SELECT o_orderpriority AS series, CAST(datediff('month', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS epoch, avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2),
    b AS (SELECT *, min(loss) OVER (PARTITION BY series ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
    g AS (SELECT *, max(CASE WHEN before IS NULL OR loss < before THEN epoch END) OVER (PARTITION BY series ORDER BY epoch) AS last_gain FROM b),
    s AS (SELECT series, coalesce(min(epoch) FILTER (WHERE epoch - last_gain >= 5), max(epoch)) AS stopped_at FROM g GROUP BY 1)
    SELECT g.series, any_value(stopped_at) AS stopped_at, max(last_gain) AS best_epoch, round(min(loss), 4) AS best_loss FROM g JOIN s ON g.series = s.series WHERE epoch <= stopped_at GROUP BY 1""",
)
def ml_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    # monthly means per priority stand for the validation losses of several runs
    losses = A.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.expr("CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS epoch")
    ).agg(F.expr("avg(o_totalprice) AS loss"))
    return M.early_stop(losses, ["series"], "epoch", "loss", 5).selectExpr("series", "stopped_at", "best_epoch", "round(best_loss, 4) AS best_loss")


# --- models ---------------------------------------------------------------------------------------------------------------------
_TRAINED: dict[tuple[str, str], tuple[models.SuccessModel, DataFrame]] = {}


def trained(spark: SparkSession, sf: str) -> tuple[models.SuccessModel, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        model, _ = models.train_success(history(spark, sf), CONFIG)
        path = fresh_path(spark, "training")
        models.training_matrix(history(spark, sf), model.encoders, CONFIG).write.parquet(path)
        _TRAINED[key] = model, spark.read.parquet(path)
    return _TRAINED[key]


@query("ml_train_success")
def ml_train_success(spark: SparkSession, sf: str) -> DataFrame:
    model, data = trained(spark, sf)
    shares = data.agg(*[F.expr(f"count_if(split = '{s}') AS n_{s}") for s in ("train", "validation", "test")], F.expr(f"{len(X.FEATURES)} AS n_features"))
    # both counts are reported: rows lost in scoring would show, and not empty the result
    return models.evaluate(model, data, "validation").crossJoin(F.broadcast(shares))


@query("ml_calibrate")
def ml_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration by decile of the predicted probability on the test part."""
    model, data = trained(spark, sf)
    scored = model.predict(data.filter("split = 'test'"))
    return scored.groupBy(F.expr("CAST(least(9, floor(p_productive * 10)) AS INT) AS decile")).agg(
        F.expr("count(*) AS n"), F.expr("avg(p_productive) AS predicted"), F.expr("avg(productive_dispatch) AS observed")
    )


@query("ml_score_candidates")
def ml_score_candidates(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf)
    pairs = S.expand_pairs(
        A.proposals(spark, sf), A.dispatches(spark, sf), A.tech_calendar(spark, sf), A.technicians(spark, sf), scorer=model.scorer()
    )
    return pairs.select("dispatch_id", "technician_id", "p_productive", "p_ftf", "final_score")


@query("ml_path_save_load")
def ml_path_save_load(spark: SparkSession, sf: str) -> DataFrame:
    model, data = trained(spark, sf)
    path = fresh_path(spark, "model")
    model.save(spark, path)
    again = models.SuccessModel.load(spark, path)
    both = model.predict(data.filter("split = 'test'")).withColumnsRenamed({"p_productive": "a", "p_ftf": "b"})
    return again.predict(both).agg(F.expr("count(*) AS n"), F.expr("count_if(a = p_productive AND b = p_ftf) AS same"))


@query("ml_registry_save")
def ml_registry_save(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf)
    root = fresh_path(spark, "registry")
    for version, at in (("1", "2025-11-10 00:00:00"), ("2", "2025-11-12 00:00:00")):
        models.register(spark, f"{root}/table", model, version, at, f"{root}/models/{version}")
    return spark.read.parquet(f"{root}/table").select("model_id", "model_version", "created", "model_type", "config")


@query("ml_registry_load")
def ml_registry_load(spark: SparkSession, sf: str) -> DataFrame:
    model, data = trained(spark, sf)
    root = fresh_path(spark, "registry")
    for version, at in (("2", "2025-11-12 00:00:00"), ("1", "2025-11-10 00:00:00")):
        models.register(spark, f"{root}/table", model, version, at, f"{root}/models/{version}")
    latest, again = models.load_registered(spark, f"{root}/table")
    first, _ = models.load_registered(spark, f"{root}/table", "success_1")
    return models.mean_scores(again.predict(data.filter("split = 'test'"))).selectExpr("*", f"'{latest}' AS latest", f"'{first}' AS by_id")


@query("pipe_train_registry")
def pipe_train_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Train, evaluate, register, reload, score the open dispatches' best technicians with the model."""
    model, data = trained(spark, sf)
    root = fresh_path(spark, "registry")
    models.register(spark, f"{root}/table", model, "1", "2025-11-12 00:00:00", f"{root}/models/1")
    _, again = models.load_registered(spark, f"{root}/table")
    best = S.best_technician(
        S.unoptimized(A.dispatches(spark, sf)), A.tech_calendar(spark, sf), A.technicians(spark, sf), scorer=again.scorer()
    )
    means = best.groupBy("constraint_level").agg(
        F.expr("count(*) AS n"), F.expr("avg(p_productive) AS avg_p_productive"), F.expr("avg(p_ftf) AS avg_p_ftf")
    )
    test = models.evaluate(again, data, "test").filter("label = 'productive_dispatch'").selectExpr(
        "roc_auc AS test_roc_auc", "pr_auc AS test_pr_auc", "accuracy AS test_accuracy"
    )
    return means.crossJoin(F.broadcast(test))  # one row


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """The points with a label that a line separates."""
    return A.labeled_points(spark, sf).selectExpr("row_id", "x1", "x2", "CASE WHEN 0.05D + x1 - 0.5D * x2 > 0 THEN 1 ELSE -1 END AS y")


@query("ml_logistic_gd")
def ml_logistic_gd(spark: SparkSession, sf: str) -> DataFrame:
    p = planted(spark, sf)
    w, epochs, loss, converged = models.logistic_gd(p)
    return p.agg(F.expr("count(*) AS n"), F.expr(f"{M.class_error(M.dot(w, models.POINT))} AS error")).selectExpr(
        "n", "error", f"{epochs} AS epochs", f"{str(converged).lower()} AS converged", f"{loss!r}D AS loss", f"{w[1] / w[0]!r}D AS w1", f"{w[2] / w[0]!r}D AS w2"
    )


@query("ml_perceptron")
def ml_perceptron(spark: SparkSession, sf: str) -> DataFrame:
    p = planted(spark, sf)
    w, rounds, errors = models.perceptron(p)
    return p.agg(F.expr("count(*) AS n"), F.expr(f"{M.class_error(M.dot(w, models.POINT))} AS error")).selectExpr("n", "error", f"{rounds} AS rounds", f"{errors} AS misclassified", f"{str(errors == 0).lower()} AS converged")


@query("ml_linear_margin")
def ml_linear_margin(spark: SparkSession, sf: str) -> DataFrame:
    p = planted(spark, sf)
    margin, (other, _, _) = models.linear_margin(p), models.perceptron(p)
    return p.agg(
        F.expr("count(*) AS n"), F.expr(f"{M.class_error(M.dot(margin, models.POINT))} AS margin_error"), F.expr(f"{M.class_error(M.dot(other, models.POINT))} AS perceptron_error")
    )


@query("ml_model_order_sweep")
def ml_model_order_sweep(spark: SparkSession, sf: str) -> DataFrame:
    points = splits.positional_split(A.labeled_points(spark, sf), "row_id", 25)
    rows = models.order_sweep(points)
    return spark.createDataFrame(rows, "k int, trained_on string, held_out string, train_error double, held_out_error double")


@query("ml_softmax_head")
def ml_softmax_head(spark: SparkSession, sf: str) -> DataFrame:
    e = splits.random_split(A.table(spark, sf, "embeddings"), "vec_id").withColumn("x", array_to_vector(F.expr("CAST(embedding AS array<double>)")))
    model = models.softmax_head(e.filter("split = 'train'"), "x", "label")
    scored, converged = model.transform(e), model.summary.totalIterations < models.MAX_STEPS
    return scored.groupBy("split").agg(
        F.expr("count(*) AS n"), F.expr("avg(CASE WHEN prediction = label THEN 1D ELSE 0D END) AS accuracy"), F.expr(f"{str(converged).lower()} AS converged")
    )
