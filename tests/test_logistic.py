import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from surveyloom.config import PlausibilityParams
from surveyloom.operators import hashed, logistic, plausibility
from surveyloom.sources import scratch

PARAMS = PlausibilityParams(num_epochs=1)


def library_fit(rows, params, column="features"):
    return LogisticRegression(
        featuresCol=column, labelCol="labels", maxIter=params.max_iter, regParam=params.weight_decay,
        probabilityCol="_p", rawPredictionCol="_r", predictionCol="_g",
    ).fit(rows)


def agree(model, library, selector):
    assert model.stages[-1].intercept == pytest.approx(library.intercept, abs=1e-6)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), library.coefficients.toArray(), atol=1e-6)
    assert model.stages[0].selectedFeatures == selector.selectedFeatures


def test_a_grid_on_all_folds_learns_in_the_scans_of_its_longest_training(spark, monkeypatch):
    data = [(i, str(i % 7), str(i * i % 5), int((i % 7 + i * i % 5) % 3 == 0 or i % 13 == 0), i % 3) for i in range(600)]
    rows = spark.createDataFrame(data, "id int, a string, b string, labels int, fold int")
    vectors = scratch.materialise(plausibility.with_vectors(rows, ["a"], ["b"], PARAMS), "vectors")
    selector = plausibility.used_places(vectors)
    scans, plain = [], logistic.gradient_sums

    def counted(blocks, models, *rest):
        scans.append(len(models))
        return plain(blocks, models, *rest)

    monkeypatch.setattr(logistic, "gradient_sums", counted)
    grid = plausibility.grid_of(PARAMS, [1, 2], [0.01, 0.1])
    points = [(params, fold) for params in grid for fold in (0, 2)]
    models = plausibility.train_plausibility(vectors, [p for p, _ in points], selector=selector, unseen=[f for _, f in points])
    together = len(scans)
    assert max(scans) == 4  # two folds, two penalties; fewer iterations are a part of more
    scans.clear()
    for params, fold in points[4:]:
        plausibility.train_plausibility(vectors, [params], selector=selector, unseen=[fold])
    assert together < len(scans) / 2
    for model, (params, fold) in zip(models, points):
        agree(model, library_fit(selector.transform(vectors.where(F.col("fold") != fold)), params, "_used"), selector)


@pytest.mark.parametrize("even", [True, False])
def test_vectors_of_any_values_and_lengths(spark, even):
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        places = sorted(rng.choice(9, 4 if even else int(rng.integers(0, 9)), replace=False).tolist())
        values = rng.normal(1, 2, len(places)).round(3).tolist()
        vector = Vectors.sparse(10, places, values) if i % 3 else Vectors.dense(Vectors.sparse(10, places, values).toArray())
        data.append((i, vector, int(sum(values) + rng.normal() > 3)))
    rows = spark.createDataFrame(data, ["id", "features", "labels"]).repartition(3)
    rows = scratch.materialise(rows, "rows")
    selector = plausibility.used_places(rows)
    model = plausibility.train_plausibility(rows, PARAMS.with_values(weight_decay=0.02))
    library = library_fit(selector.transform(rows), PARAMS.with_values(weight_decay=0.02), "_used")
    agree(model, library, selector)
    theirs = library.transform(selector.transform(rows)).select("id", F.get(vector_to_array("_p"), 1).alias("p"), "_g")
    both = plausibility.score(model, rows).join(theirs, "id")
    assert both.count() == 300
    assert both.where("abs(plausibility - p) > 1e-6 or prediction != _g").isEmpty()


def test_a_training_set_of_one_class(spark):
    rows = spark.createDataFrame([(i, str(i % 2), "x", 1, 0) for i in range(6)], "id int, a string, b string, labels int, fold int")
    vectors = plausibility.with_vectors(rows, ["a"], ["b"], PARAMS)
    scored = plausibility.score(plausibility.train_plausibility(vectors, PARAMS), vectors)
    assert {(r.plausibility, r.prediction) for r in scored.collect()} == {(1.0, 1)}


def test_several_models_score_a_row_at_once(spark):
    data = [(i, str(i % 7), str(i % 4), int(i % 3 == 0), i % 2) for i in range(200)]
    rows = spark.createDataFrame(data, "id int, a string, b string, labels int, fold int")
    vectors = scratch.materialise(plausibility.with_vectors(rows, ["a"], ["b"], PARAMS), "vectors")
    models = plausibility.train_plausibility(vectors, [PARAMS, PARAMS], unseen=[0, 1])
    scored = plausibility.score_by_all(models, vectors)
    for number, model in enumerate(models):
        picked = plausibility.of_model(scored, number)
        assert picked.columns == ["id", "a", "b", "labels", "fold", "plausibility", "prediction"]
        assert sorted(picked.collect()) == sorted(plausibility.score(model, vectors).collect())


@pytest.mark.parametrize("size", [1 << 20, 64])
@pytest.mark.parametrize("crosses", [True, False])
def test_places_are_those_of_the_library(spark, size, crosses):
    data = [(None if i % 11 == 0 else "é" * (i % 5) + str(i), float(i % 3), f"x{i % 2}", "日本" + str(i % 4)) for i in range(300)]
    rows = spark.createDataFrame(data, "a string, b double, c string, d string").repartition(3)
    tokens = plausibility.value_tokens(["a", "b", "c", "d"])
    if crosses:
        tokens = plausibility.crossed_tokens(tokens, 2, 2)
    hasher = HashingTF(inputCol="tokens", outputCol="theirs", numFeatures=size, binary=True)
    params = PARAMS.with_values(hash_dimensions=size, crosses=crosses)
    both = plausibility.with_vectors(hasher.transform(rows.withColumn("tokens", tokens)), ["a", "b"], ["c", "d"], params)
    assert both.where(F.col("features") != F.col("theirs")).isEmpty() and both.where("features is not null").count() == 300
    own = hashed.distinct_tokens(rows, ["a", "b"], ["c", "d"], crosses)
    theirs = rows.select(F.explode(tokens).alias("token")).distinct()
    assert own.exceptAll(theirs).isEmpty() and theirs.exceptAll(own).isEmpty()


def test_search_of_a_curved_valley():
    """The optimiser alone, on Rosenbrock's function: states of fewer iterations lie on the way of more."""

    def value(x):
        a, b = 1 - x[0], x[1] - x[0] ** 2
        return a * a + 100 * b * b, np.array([-2 * a - 400 * x[0] * b, 200 * b])

    def run(stops):
        search = logistic.minimise(np.array([-1.2, 1.0]), stops)
        point = next(search)
        while True:
            try:
                point = search.send(value(point))
            except StopIteration as end:
                return end.value

    found = run([0, 5, 200])
    np.testing.assert_allclose(found[200], [1, 1], atol=1e-3)
    assert found[0].tolist() == [-1.2, 1.0] and found[5].tolist() == run([5])[5].tolist()
