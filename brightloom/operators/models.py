"""Success models: training, calibration, scoring, saving and the version registry."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from brightloom.functions.scoring import Scorer
from brightloom.operators import features as X
from brightloom.operators.metrics import NONLINEAR, class_error, dot, log_loss, normal_sums, ranking_metrics, solve_normal
from brightloom.operators.splits import stratified_split

# Linear fits run to their tolerance; this only ends one that never settles, and the result says so.
MAX_STEPS = 1000
ROWS_PER_PARTITION = 100_000

LABELS = {"p_productive": "productive_dispatch", "p_ftf": "first_time_fix"}


@dataclass(frozen=True)
class TrainConfig:
    """Defaults: 100 trees of depth 6 at rate 0.1, sigmoid calibration over 3 folds, 70/10/20 split."""

    max_iter: int = 100
    max_depth: int = 6
    step_size: float = 0.1
    calibrate: bool = True
    folds: int = 3
    test_size: float = 0.2
    val_size: float = 0.1
    seed: int = 42


@dataclass
class Member:
    """One boosted model and the sigmoid that maps its raw score to a probability."""

    model: GBTClassificationModel
    slope: float
    offset: float


@dataclass
class SuccessModel:
    config: TrainConfig
    encoders: X.Encoders
    members: dict[str, list[Member]]
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def predict(self, matrix: DataFrame) -> DataFrame:
        """``matrix`` with both probabilities: the mean over the fold models, inside the executors."""
        out = VectorAssembler(inputCols=list(X.FEATURES), outputCol="_x").transform(matrix)
        added = ["_x"]
        for name, members in self.members.items():
            terms = []
            for i, m in enumerate(members):
                raw, prob, pred = (f"_{name}_{i}_{s}" for s in ("raw", "prob", "pred"))
                ready = m.model.copy()
                ready.setFeaturesCol("_x").setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
                out = ready.transform(out).withColumn(f"{raw}_v", vector_to_array(raw)[1])
                added += [raw, prob, pred, f"{raw}_v"]
                terms.append(f"1 / (1 + exp(-({m.slope!r}D * {raw}_v + {m.offset!r}D)))")
            out = out.withColumn(name, F.expr(f"({' + '.join(terms)}) / {len(terms)}"))
        return out.drop(*added)

    def scorer(self) -> Scorer:
        """The model in the slot of a pair scorer: no collect, one transform per batch of pairs."""

        def score(pairs: DataFrame) -> DataFrame:
            rows = pairs.selectExpr(
                "struct(*) AS pair", "ticket_type", "order_type", "priority", "required_skill", "duration_min", "appointment_start",
                "city AS dispatch_city", "state AS dispatch_state", "customer_latitude", "customer_longitude",
                "primary_skill AS technician_skill", "tech_city AS technician_city", "tech_state AS technician_state",
                "latitude AS technician_latitude", "longitude AS technician_longitude",
                "workload_capacity AS technician_workload_capacity", "current_assignments AS technician_current_assignments",
            )
            return self.predict(X.feature_matrix(rows, self.encoders, ["pair"])).selectExpr("pair.*", *self.members)

        return score

    def save(self, spark: SparkSession, path: str) -> None:
        for name, members in self.members.items():
            for i, m in enumerate(members):
                m.model.write().overwrite().save(f"{path}/{name}/{i}")
        meta = {
            "config": asdict(self.config), "encoders": self.encoders, "stats": self.stats, "features": list(X.FEATURES),
            "members": {n: [(m.slope, m.offset) for m in ms] for n, ms in self.members.items()},
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SuccessModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        members = {
            n: [Member(GBTClassificationModel.load(f"{path}/{n}/{i}"), a, b) for i, (a, b) in enumerate(sigmoids)]
            for n, sigmoids in meta["members"].items()
        }
        return SuccessModel(TrainConfig(**meta["config"]), meta["encoders"], members, meta["stats"])


def _gbt(c: TrainConfig, label: str) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="_x", labelCol=label, maxIter=c.max_iter, maxDepth=c.max_depth, stepSize=c.step_size, seed=c.seed,
        cacheNodeIds=True, maxMemoryInMB=512, checkpointInterval=10,
    )


def _calibrated(train: DataFrame, label: str, c: TrainConfig) -> list[Member]:
    if not c.calibrate:
        return [Member(_gbt(c, label).fit(train), 2.0, 0.0)]  # the classifier's own link

    def fold(i: int) -> Member:
        model = _gbt(c, label).fit(train.filter(f"_fold <> {i}"))
        held = model.transform(train.filter(f"_fold = {i}"))
        one = VectorAssembler(inputCols=["_raw"], outputCol="_r").transform(held.withColumn("_raw", vector_to_array("rawPrediction")[1]))
        sigmoid = LogisticRegression(featuresCol="_r", labelCol=label, maxIter=MAX_STEPS).fit(one.select("_r", label))
        return Member(model, float(sigmoid.coefficients[0]), float(sigmoid.intercept))

    # the folds are independent, and the jobs of a small tree leave most executors idle
    with ThreadPoolExecutor(c.folds) as pool:
        return list(pool.map(fold, range(c.folds)))


def training_matrix(rows: DataFrame, encoders: X.Encoders, c: TrainConfig) -> DataFrame:
    """Features, both labels and the split; a fold of the calibration by hash of the id."""
    keep = ["dispatch_id", "technician_id", *LABELS.values()]
    matrix = X.feature_matrix(rows, encoders, keep)
    split = stratified_split(matrix, "productive_dispatch", "dispatch_id", c.test_size, c.val_size, seed=c.seed)
    return split.selectExpr("*", f"CAST(pmod(xxhash64(dispatch_id, {c.seed + 1}), {c.folds}) AS INT) AS _fold")


def train_success(rows: DataFrame, config: TrainConfig = TrainConfig()) -> tuple[SuccessModel, DataFrame]:
    """The model, and the matrix with its split. ``rows`` come from ``features.training_rows``."""
    encoders = X.fit_encoders(X.with_raw_features(rows))
    matrix = training_matrix(rows, encoders, config)
    stats = {r.feature: {k: r[k] for k in ("mean", "std", "min", "max")} for r in X.feature_stats(matrix).collect()}  # 19 rows
    train = VectorAssembler(inputCols=list(X.FEATURES), outputCol="_x").transform(matrix.filter("split = 'train'")).select(
        "_x", "_fold", *LABELS.values()
    )
    # each level of each tree is a job over all partitions: as few of them as their rows allow
    parts = -(-matrix.filter("split = 'train'").count() // ROWS_PER_PARTITION)
    train = train.repartition(max(1, parts)).persist(StorageLevel.MEMORY_AND_DISK)
    with ThreadPoolExecutor(len(LABELS)) as pool:
        fitted = pool.map(lambda label: _calibrated(train, label, config), LABELS.values())
        members = dict(zip(LABELS, fitted))
    train.unpersist()
    return SuccessModel(config, encoders, members, stats), matrix


def evaluate(model: SuccessModel, matrix: DataFrame, part: str) -> DataFrame:
    """(label, roc_auc, pr_auc, accuracy, n) on one part of the split."""
    scored = model.predict(matrix.filter(f"split = '{part}'"))
    frames = [
        ranking_metrics(scored, name, label).selectExpr(f"'{label}' AS label", "roc_auc", "pr_auc", "accuracy", "n")
        for name, label in LABELS.items()
    ]
    return frames[0].unionByName(frames[1])


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.expr("count(*) AS n"), F.expr("avg(p_productive) AS avg_p_productive"), F.expr("avg(p_ftf) AS avg_p_ftf")
    )


# --- registry --------------------------------------------------------------------------------------------
REGISTRY = "model_id string, model_version string, created timestamp, location string, model_type string, config string"


def register(spark: SparkSession, registry: str, model: SuccessModel, version: str, created: str, location: str) -> str:
    """Save the model and append its row; older versions stay."""
    model_id = f"success_{version}"
    model.save(spark, location)
    row = spark.createDataFrame(
        [(model_id, version, location, "SuccessModel", json.dumps(asdict(model.config)))],
        "model_id string, model_version string, location string, model_type string, config string",
    )
    row.selectExpr(
        "model_id", "model_version", f"CAST('{created}' AS TIMESTAMP) AS created", "location", "model_type", "config"
    ).write.mode("append").parquet(registry)
    return model_id


def load_registered(spark: SparkSession, registry: str, model_id: str | None = None) -> tuple[str, SuccessModel]:
    """A model by id, else the latest one."""
    rows = spark.read.schema(REGISTRY).parquet(registry)
    if model_id:
        rows = rows.filter(F.col("model_id") == model_id)
    found = rows.agg(F.expr("max_by(struct(model_id, location), struct(created, model_id)) AS m")).first().m
    if found is None:
        raise ValueError(f"no model in {registry}")
    return found.model_id, SuccessModel.load(spark, found.location)


# --- linear models: every round is one aggregate over the table -----------------------------------------------
POINT = ("1D", "x1", "x2")


def logistic_gd(
    points: DataFrame, eta: float = 1.0, threshold: float = 0.01, max_epochs: int = MAX_STEPS
) -> tuple[list[float], int, float, bool]:
    """Full-batch gradient descent; stops when the weights move less than ``threshold``. (w, epochs, loss, converged)"""
    p = points.select("x1", "x2", "y").persist(StorageLevel.MEMORY_AND_DISK)
    w, epoch, converged = [0.0, 0.0, 0.0], 0, False
    while epoch < max_epochs:
        s = dot(w, POINT)
        g = p.agg(*[F.expr(f"avg(-y * ({t}) / (1 + exp(y * ({s}))))") for t in POINT]).first()
        move = [eta * x for x in g]
        w = [a - b for a, b in zip(w, move)]
        epoch += 1
        if sum(m * m for m in move) ** 0.5 < threshold:
            converged = True
            break
    loss = p.agg(F.expr(log_loss(dot(w, POINT)))).first()[0]
    p.unpersist()
    return w, epoch, loss, converged


def perceptron(points: DataFrame, max_rounds: int = 300) -> tuple[list[float], int, int]:
    """Batch perceptron: add y·x of all misclassified points until none is left. (w, rounds, errors)

    It has converged if there are no errors; after ``max_rounds`` the best weights so far are returned.
    """
    p = points.select("x1", "x2", "y").persist(StorageLevel.MEMORY_AND_DISK)
    w, best = [0.0, 0.0, 0.0], None
    for rounds in range(max_rounds + 1):
        wrong = f"sign({dot(w, POINT)}) <> y"
        r = p.agg(F.expr(f"count_if({wrong})"), *[F.expr(f"avg(CASE WHEN {wrong} THEN y * ({t}) ELSE 0 END)") for t in POINT]).first()
        if best is None or r[0] < best[2]:
            best = (list(w), rounds, r[0])
        if r[0] == 0:
            break
        w = [a + b for a, b in zip(w, r[1:])]
    p.unpersist()
    return best


def linear_margin(points: DataFrame, max_iter: int = MAX_STEPS) -> list[float]:
    """Weights (w0, w1, w2) of a maximum-margin line, to the solver's tolerance."""
    data = VectorAssembler(inputCols=["x1", "x2"], outputCol="_x").transform(points.selectExpr("x1", "x2", "CAST((y + 1) / 2 AS DOUBLE) AS label"))
    m = LinearSVC(featuresCol="_x", labelCol="label", regParam=1e-6, maxIter=max_iter, standardization=False).fit(data)
    return [float(m.intercept), *map(float, m.coefficients)]


def order_sweep(points: DataFrame, orders: range = range(3, 8)) -> list[tuple[int, str, str, float, float]]:
    """(k, trained on, held out, error on each) per order and direction; ``points`` has ``part``.

    All orders share one set of sums per part; all errors of a part come from one aggregate.
    """
    parts = [r.part for r in points.select("part").distinct().collect()]  # two parts
    out = []
    for part in sorted(parts):
        sums = normal_sums(points.filter(F.col("part") == part)).collect()  # 44 numbers
        fits = {k: dot(solve_normal(sums, k), NONLINEAR) for k in orders}
        errors = {
            r.part: r
            for r in points.groupBy("part").agg(*[F.expr(f"{class_error(s)} AS e{k}") for k, s in fits.items()]).collect()
        }
        for other in parts:
            if other != part:
                out += [(k, part, other, errors[part][f"e{k}"], errors[other][f"e{k}"]) for k in fits]
    return out


def softmax_head(data: DataFrame, features: str, label: str, max_iter: int = MAX_STEPS):
    """Multinomial logistic regression on frozen feature vectors, to the solver's tolerance."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter, regParam=0.0).fit(data)


def boosted_with_validation(train: DataFrame, label: str, indicator: str, config: TrainConfig, tolerance: float = 0.01):
    """Boosting that stops when the validation rows stop improving."""
    gbt = _gbt(config, label).setParams(validationIndicatorCol=indicator, validationTol=tolerance)
    return gbt.fit(train)
