import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright import Analyst, Profile, TaskAdvice, Trainer
from tabwright.operators import metrics
from tabwright.plans.training import full_modeling, train_kmeans


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(600).selectExpr(
        "id", "(id * 37 % 101) * 1.0D as a", "(id * 53 % 97) * 1.0D as b",
        "3 * (id * 37 % 101) - 2 * (id * 53 % 97) + (id * 31 % 11) * 1.0D as y",
        "case when (id * 37 % 101) + (id * 13 % 40) > 70 then 'high' else 'low' end as c",
    )


def matrix(trainer):
    pdf = trainer._train_vectors.toPandas()
    return np.array([v.toArray() for v in pdf["_scaled"]]), pdf["_label"].to_numpy()


def test_linear_models_equal_closed_forms(line):
    t = Trainer(line, "y", ["id"], ["a", "b"], classification=False, folds=3)
    board = t.train_all(["linear_regression", "ridge", "no_such_model"])
    assert board.count() == 2 and "no_such_model" in t.failures
    x, y = matrix(t)
    assert x.mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and x.std(axis=0) == pytest.approx([1, 1])
    yc = y - y.mean()
    for name, alpha in (("linear_regression", 0.0), ("ridge", 1.0)):
        weights = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ yc)
        model = t.models[name].stages[-1]
        assert list(model.coefficients) == pytest.approx(list(weights), rel=1e-6)
        assert model.intercept == pytest.approx(y.mean(), rel=1e-6)
    scores = [r["cv_mean"] for r in board.collect()]
    assert all(0.9 < s < 1 for s in scores)
    assert t.predict(line).count() == 600
    assert {r["feature"] for r in t.feature_importance().collect()} == {"a", "b"}


def test_logistic_stands_at_the_optimum(line):
    t = Trainer(line, "c", ["id"], ["a", "b"], classification=True)
    result = t.train_model("logistic_regression", cross_validate=False)
    x, y = matrix(t)
    model = t.models["logistic_regression"].stages[-2]
    w, b = np.array(model.coefficients), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # gradient of the summed log loss with C = 1 and a free intercept
    assert x.T @ (p - y) + w == pytest.approx([0, 0], abs=0.05)
    assert np.sum(p - y) == pytest.approx(0, abs=0.05)
    assert set(result["metrics"]) == {"accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc"}
    assert {r["prediction"] for r in t.predict(line).select("prediction").distinct().collect()} <= {"high", "low"}


def test_trees_rank_and_explain(line):
    t = Trainer(line, "c", ["id"], ["a", "b"], classification=True, trees=5, rounds=3, folds=2)
    board = t.train_all(["random_forest", "xgboost", "lightgbm"]).collect()
    assert [r["model"] for r in board if r["model"] == "gradient_boosting"] == ["gradient_boosting"]  # both boosters are one
    assert board[0]["score"] >= board[-1]["score"] and all(r["cv_mean"] > 0.5 for r in board)
    assert t.feature_importance("random_forest").first()["feature"] == "a"


def test_folds_and_split_ignore_partitioning(line):
    a = Trainer(line, "y", ["id"], ["a"], classification=False)
    b = Trainer(line.repartition(9, "b"), "y", ["id"], ["a"], classification=False)
    rows = lambda t: {(r["id"], r["is_test"], r["fold"]) for r in t.data.collect()}
    assert rows(a) == rows(b)


def test_null_targets_are_dropped_and_unknown_tasks_refused(spark, line):
    holes = line.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    assert Trainer(holes, "y", ["id"], ["a"], classification=False).data.count() == 300
    with pytest.raises(ValueError):
        Trainer(line.select("c"), "c", classification=True)
    found = full_modeling(line.withColumn("t", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 9 as int))")), "b")
    assert "time_series" in found["message"]
    assert "target" in full_modeling(line, None)["message"]


def test_zero_division_in_metrics(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.25 and row["precision_weighted"] == pytest.approx(0.25 * 0.25)
    assert row["f1_weighted"] == pytest.approx(0.25 * 0.4)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 0.0


def test_kmeans_finds_two_groups(spark):
    df = spark.range(60).selectExpr("id", "case when id % 2 = 0 then id / 100 else 50 + id / 100 end as v")
    clustered, silhouette = train_kmeans(df, ["v"], k=2)
    assert silhouette > 0.9
    assert clustered.groupBy("cluster", F.col("id") % 2).count().count() == 2


def test_facade_chain(spark, line, tmp_path):
    a = Analyst(line.drop("c"), "y").analyze().preprocess().train(["linear_regression"], keys=["id"], folds=2)
    items = {r["item"]: r["value"] for r in a.summary().collect()}
    assert items["rows"] == "600" and items["best_model"].startswith("linear_regression")
    written = a.report(str(tmp_path / "report"))
    assert {"leaderboard", "findings", "data"} <= {r["table"] for r in written.collect()}
    with pytest.raises(ValueError):
        Analyst(line.where("id < 0"))
    with pytest.raises(ValueError):
        Analyst(line).train()
    with pytest.raises(TypeError):
        Analyst([1, 2])


def test_task_of_an_unknown_target(line):
    with pytest.raises(ValueError):
        TaskAdvice(Profile(line), "nope")
