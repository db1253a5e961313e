"""Models on a planted signal."""

import pytest

from brightloom import adapters as A
from brightloom.operators import features as X
from brightloom.operators import metrics as M
from brightloom.operators import models
from brightloom.session import fresh_path


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    # labels that follow from the features
    h = A.dispatch_history(spark, sf_dir).drop("productive_dispatch", "first_time_fix").selectExpr(
        "*", "CASE WHEN duration_min > 120 OR priority = 'High' THEN 1 ELSE 0 END AS productive_dispatch",
        "CASE WHEN order_type = 'repair' THEN 1 ELSE 0 END AS first_time_fix",
    )
    return X.training_rows(h, A.technicians(spark, sf_dir))


@pytest.fixture(scope="module")
def trained(rows):
    return models.train_success(rows, models.TrainConfig(max_iter=3, max_depth=3, folds=2))


def test_learns_and_stays_in_bounds(trained):
    model, matrix = trained
    for r in models.evaluate(model, matrix, "test").collect():
        assert r.roc_auc > 0.9 and r.pr_auc > 0.8
    scored = model.predict(matrix)
    low, high = scored.selectExpr("min(least(p_productive, p_ftf)) AS a", "max(greatest(p_productive, p_ftf)) AS b").first()
    assert 0 <= low <= high <= 1


def test_registry_gives_the_latest_or_the_named_model(spark, trained):
    model, matrix = trained
    root = fresh_path(spark, "reg")
    models.register(spark, f"{root}/t", model, "b", "2024-01-02 00:00:00", f"{root}/m/b")
    models.register(spark, f"{root}/t", model, "a", "2024-01-01 00:00:00", f"{root}/m/a")
    assert models.load_registered(spark, f"{root}/t", "success_a")[0] == "success_a"
    found, again = models.load_registered(spark, f"{root}/t")
    assert found == "success_b" and again.encoders == model.encoders and again.stats.keys() == set(X.FEATURES)
    test = matrix.filter("split = 'test'").select("dispatch_id", "technician_id", *X.FEATURES)
    both = again.predict(model.predict(test).withColumnRenamed("p_productive", "p0").withColumnRenamed("p_ftf", "f0"))
    assert both.filter("p0 <> p_productive OR f0 <> p_ftf").isEmpty()


def test_line_models_separate(spark):
    p = spark.range(400).selectExpr("pmod(id * 37, 101) / 50D - 1 AS x1", "pmod(id * 53, 97) / 48D - 1 AS x2").selectExpr(
        "x1", "x2", "CASE WHEN 0.2D + x1 - 0.5D * x2 > 0 THEN 1 ELSE -1 END AS y"
    ).filter("abs(0.2D + x1 - 0.5D * x2) > 0.05D")
    w, _, errors = models.perceptron(p, max_rounds=200)
    assert errors == 0 and w[1] > 0 > w[2]
    w, epochs, loss, converged = models.logistic_gd(p, eta=1.0, threshold=0.05, max_epochs=100)
    assert converged and epochs < 100 and loss < 0.5
    assert not models.logistic_gd(p, eta=1.0, threshold=0.0, max_epochs=2)[3]
    w = models.linear_margin(p)
    assert p.agg({"y": "count"}).first()[0] > 0
    assert p.selectExpr(f"{M.class_error(M.dot(w, models.POINT))} AS e").first().e < 0.05


def test_least_squares_sums(spark):
    p = spark.range(50).selectExpr("id / 25D - 1 AS x1", "pmod(id * 7, 50) / 25D - 1 AS x2").selectExpr("x1", "x2", "2 - 3 * x1 + 0.5D * x2 AS y")
    w = M.solve_normal(M.normal_sums(p).collect(), 2)
    assert [round(v, 8) for v in w] == [2.0, -3.0, 0.5]


def test_validation_stops_boosting(rows, spark):
    from pyspark.ml.feature import VectorAssembler

    encoders = X.fit_encoders(X.with_raw_features(rows))
    m = X.feature_matrix(rows, encoders, ["dispatch_id", "first_time_fix"]).selectExpr("*", "dispatch_id % 5 = 0 AS held")
    v = VectorAssembler(inputCols=list(X.FEATURES), outputCol="_x").transform(m)
    model = models.boosted_with_validation(v, "first_time_fix", "held", models.TrainConfig(max_iter=10, max_depth=2), tolerance=0.5)
    assert model.getNumTrees < 10
