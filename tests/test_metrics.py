import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import covariance, grid, metrics


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "t int, p int")


def values(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], {"accuracy": 0.6, "f1": 4 / 6, "precision": 2 / 3, "recall": 2 / 3}),
        ([(1, 0), (0, 0)], {"accuracy": 0.5, "f1": 0.0, "precision": 0.0, "recall": 0.0}),
        ([(0, 1), (0, 0)], {"accuracy": 0.5, "f1": 0.0, "precision": 0.0, "recall": 0.0}),
        ([(0, 0)], {"accuracy": 1.0, "f1": 0.0, "precision": 0.0, "recall": 0.0}),
    ],
)
def test_binary(spark, pairs, expected):
    got = values(metrics.binary_metrics(frame(spark, pairs), "t", "p"))
    assert got == pytest.approx(expected)


def test_binary_by_group(spark):
    df = frame(spark, [(1, 1), (0, 1)]).withColumn("g", F.col("t"))
    got = {r.g: r.accuracy for r in metrics.binary_metrics(df, "t", "p", by=["g"]).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_regression_rounds_half_to_even(spark):
    truth, guess = np.array([0.0, 2.0, 2.0, 4.0, 1.0]), np.array([0.5, 1.5, 2.5, 3.5, 3.2])
    df = spark.createDataFrame(list(zip(truth.tolist(), guess.tolist())), "t double, p double")
    got = values(metrics.regression_metrics(df, "t", "p"))
    rounded = np.around(guess)
    kept = np.where(rounded - truth, guess, truth)
    for name, p in [("rmse", guess), ("integerized_rmse", rounded), ("label_precision_rmse", kept)]:
        assert got[name] == pytest.approx(np.sqrt(np.mean((truth - p) ** 2)))
    singles = [metrics.rmse, metrics.rmse_rounded, metrics.rmse_label_precision]
    assert {k: v for f in singles for k, v in values(f(df, "t", "p")).items()} == got


def test_relevance(spark):
    df = frame(spark, [(-9, -9), (-9, 1), (2, -9), (2, 0), (-1, -1)])
    got = values(metrics.relevance_metrics(df, "t", "p"))
    assert got == pytest.approx(
        {"accuracy": 0.4, "relevant_accuracy": 0.6, "relevant_f1": 2 / 3, "relevant_precision": 2 / 3,
         "relevant_recall": 2 / 3, "rmse": np.sqrt(2.0)}
    )
    nothing = values(metrics.relevance_metrics(frame(spark, [(-9, -9)]), "t", "p"))
    assert nothing["rmse"] is None and nothing["accuracy"] == 1.0


def test_metrics_follow_the_task(spark):
    df = frame(spark, [(1, 1)])
    assert "f1" in metrics.metrics_for(df, "t", "p", "class").columns
    assert "rmse" in metrics.metrics_for(df, "t", "p", "sequence").columns


def test_best_configuration(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.9), (0, 0.9)], "config int, accuracy double")
    assert values(metrics.best_config(df, ["config"]))["config"] == 0
    assert values(metrics.best_config(df, ["config"], maximise=False))["config"] == 2


def test_covariance_is_that_of_numpy(spark):
    data = np.random.default_rng(5).normal(size=(300, 3)) * [1, 100, 1e-3] + [0, 1e6, 5]
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double").repartition(5)
    got = {(r.row, r.col): r.cov for r in covariance.covariance_matrix(df, ["a", "b", "c"]).collect()}
    expected = np.cov(data.T)
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert got[a, b] == pytest.approx(expected[i, j], rel=1e-9)


def test_covariance_report(spark):
    labels = {"a": {"1": "one", "2": "two", "3": "three"}, "b": {"1": "x", "2": "y"}}
    real = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    scored = spark.createDataFrame(
        [("one", "x", 1), ("three", "y", 1), ("two", "y", 1), ("two", "x", 0)], "a string, b string, prediction int"
    )
    diff = covariance.covariance_report(real, scored, ["a", "b"], labels)
    expected = np.cov([[1, 2, 3], [2, 1, 1]]) - np.cov([[1, 3, 2], [1, 2, 2]])
    got = {(r.row, r.col): r["diff"] for r in diff.collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(expected[0, 1])
    assert covariance.frobenius_norm(diff).collect()[0].frobenius_norm == diff.first().frobenius_norm
    assert diff.first().frobenius_norm == pytest.approx(np.linalg.norm(expected, "fro"))
    matrix = spark.createDataFrame([("a", "a", 7.5), ("a", "b", -3.5), ("b", "b", 1.0)], "row string, col string, cov double")
    assert [r.cov for r in covariance.clamped(matrix).collect()] == [3.0, -3.0, 1.0]


def test_grid():
    rows = grid.grid_rows({"x": 1, "y": 0}, y=[2, 3], z=["a"])
    assert rows == [{"x": 1, "y": 2, "z": "a"}, {"x": 1, "y": 3, "z": "a"}]


def test_grid_on_folds(spark):
    folds = spark.range(3).withColumnRenamed("id", "fold")
    out = grid.param_grid(folds, {"c": 9}, e=[2, 3, 4])
    assert out.columns == ["fold", "grid_no", "c", "e"] and out.count() == 9


def test_draws_cover_the_space(spark):
    rows = grid.param_draws(spark.range(40), 25, "s", ["id"], {"w": [0.1, 0.2]}, {"n": (15, 25)}).collect()
    assert len(rows) == 1000
    assert {r.w for r in rows} == {0.1, 0.2} and {r.n for r in rows} == set(range(15, 26))
    low = sum(r.n == 15 for r in rows)
    assert low > sum(r.n == 25 for r in rows) > 0
