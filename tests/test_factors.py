from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import factors, plausibility, vocabulary
from surveyloom.operators.factors import FactorModel, FactorParams
from surveyloom.plans.tasks import run_tasks


@pytest.fixture(scope="module")
def rows(spark):
    """An exclusive or of two columns, which no main effect can tell."""
    rng = np.random.default_rng(0)
    data = [(i, int(a), int(b), int(a != b), i % 2) for i, (a, b) in enumerate(rng.integers(0, 2, (600, 2)))]
    return spark.createDataFrame(data, "id int, a int, b int, labels int, fold int")


@pytest.fixture(scope="module")
def numbered(rows):
    tokens = plausibility.value_tokens(["a", "b"])
    words = vocabulary.token_vocabulary(rows, tokens)
    return rows.drop("a", "b").join(vocabulary.token_numbers(rows, tokens, words, ["id"]), "id"), words.count()


def test_vocabulary_and_numbers(spark):
    df = spark.createDataFrame(
        [(1, ["x", "y", "x"]), (2, ["y", "z"]), (3, []), (4, None), (5, [None, "q"])], "id int, t array<string>"
    )
    words = {r.token: (r.number, r.rows) for r in vocabulary.token_vocabulary(df, F.col("t")).collect()}
    assert {t: n for t, (_, n) in words.items()} == {"x": 1, "y": 2, "z": 1, "q": 1}
    assert sorted(n for n, _ in words.values()) == [0, 1, 2, 3]
    few = vocabulary.token_vocabulary(df, F.col("t"), min_rows=2)
    assert [(r.token, r.number) for r in few.collect()] == [("y", 0)]
    found = {r.id: r.numbers for r in vocabulary.token_numbers(df, F.col("t"), few, ["id"]).collect()}
    assert found == {1: [-1, 0, -1], 2: [0, -1], 3: [], 4: [], 5: [-1, -1]}


def test_exact_vectors_equal_those_of_a_counted_vocabulary(spark):
    rng = np.random.default_rng(3)
    lists = {i: [f"w{t}" for t in rng.integers(0, 40, 6)] for i in range(80)}
    df = spark.createDataFrame(list(lists.items()), "id int, t array<string>")
    words = vocabulary.token_vocabulary(df, F.col("t"))
    number = {r.token: r.number for r in words.collect()}
    read = vocabulary.with_exact_vectors(df, F.col("t"), words, ["id"]).collect()
    assert len(read) == 80 and len(set(number.values())) == len(number)  # no token shares a place
    for row in read:
        assert row.features.size == len(number) and row.t == lists[row.id]
        assert dict(zip(row.features.indices.tolist(), row.features.values)) == {number[t]: 1.0 for t in lists[row.id]}


def test_mllib_takes_exact_vectors(rows):
    tokens = plausibility.crossed_tokens(plausibility.value_tokens(["a", "b"]), 1, 1)
    vectors = vocabulary.with_exact_vectors(rows, tokens, vocabulary.token_vocabulary(rows, tokens), ["id"])
    model = plausibility.train_plausibility(vectors, plausibility.PlausibilityParams(num_epochs=3, weight_decay=0.0))
    assert plausibility.score(model, vectors).where("prediction <> labels").isEmpty()


@pytest.mark.parametrize("task, labels", [("class", [0, 1, 1, 0]), ("continuous", [0.5, -1, 2, 3]), ("sequence", [0, 3, 2, 1])])
def test_gradient_is_the_derivative_of_the_loss(task, labels):
    model = FactorModel(FactorParams(task_type=task, levels=4, factors=2), 5, mean=0.3, spread=2.0)
    rng = np.random.default_rng(1)
    model.weights = model.fresh() + rng.normal(0, 0.3, len(model.fresh()))
    model.weights[model.heads + 5] = 0  # what unknown tokens weigh
    model.split(model.weights)[2][-1] = 0
    numbers, label = np.array([[0, 1, 2], [2, 3, 5], [4, 0, 1], [1, 3, 4]]), np.array(labels, float)

    def loss(weights):
        now = replace(model, weights=weights)
        z = now.raw(numbers)[0]
        if task == "sequence":
            reached = factors._logistic(now.cuts()[None, :] - z[:, None])
            return -np.log(np.diff(reached, axis=1)[np.arange(4), label.astype(int)]).sum()
        guess = z + weights[0]
        if task == "class":
            return (np.log1p(np.exp(guess)) - label * guess).sum()
        return 0.5 * ((guess - (label - 0.3) / 2.0) ** 2).sum()

    gradient = model.gradient(numbers, label)
    for k in range(len(model.weights)):
        unknown = k == model.heads + 5 or k >= len(model.weights) - 2
        step = np.zeros(len(model.weights))
        step[k] = 1e-6
        want = 0 if unknown else (loss(model.weights + step) - loss(model.weights - step)) / 2e-6
        assert gradient[k] == pytest.approx(want, abs=1e-5)


def test_factors_learn_what_main_effects_cannot(numbered):
    rows, size = numbered
    params = FactorParams(num_epochs=12, batch_size=16)
    crossed, plain = params, replace(params, factors=0)
    result = factors.cross_validate_factors(rows, ["id"], size, [crossed, plain], [0, 1])
    accuracy = {(r.setting, r.fold): r.accuracy for r in result.collect()}
    assert set(accuracy) == {(s, f) for s in (0, 1) for f in (0, 1)}
    assert min(accuracy[0, f] for f in (0, 1)) > 0.95 and max(accuracy[1, f] for f in (0, 1)) < 0.85  # three of four cells


def test_every_setting_changes_the_model(numbered):
    rows, size = numbered
    base = FactorParams(num_epochs=3, batch_size=32, warmup_steps=4)
    others = [
        replace(base, num_epochs=4), replace(base, learning_rate=5e-5), replace(base, batch_size=16),
        replace(base, warmup_steps=20), replace(base, weight_decay=0.2), base,
    ]
    models = factors.train_factors(rows, ["id"], size, [(p, None) for p in [base, *others]])
    same = [np.allclose(models[0].weights, m.weights) for m in models[1:]]
    assert same == [False] * 5 + [True]


def test_scans_do_not_grow_with_settings_and_folds(spark, numbered, monkeypatch):
    rows, size = numbered
    steps = []
    plain = factors.part_gradients

    def counted(part, models):
        found = plain(part, models)
        plan = found._jdf.queryExecution().executedPlan().toString()
        steps.append(plan.count("FileScan"))
        return found

    monkeypatch.setattr(factors, "part_gradients", counted)
    for settings in (1, 5):
        steps.clear()
        models = [(FactorParams(num_epochs=2), fold) for _ in range(settings) for fold in (0, 1)]
        factors.train_factors(rows, ["id"], size, models)
        assert steps == [1] * (2 * factors.PARTS)


def test_a_fold_s_model_has_not_seen_it(spark, numbered):
    rows, size = numbered
    flipped = rows.withColumn("labels", F.when(F.col("fold") == 0, 1 - F.col("labels")).otherwise(F.col("labels")))
    params = FactorParams(num_epochs=1)
    a, b = (factors.train_factors(r, ["id"], size, [(params, 0)])[0] for r in (rows, flipped))
    assert np.allclose(a.weights, b.weights)


def test_empty_rows_unknown_tokens_and_no_rows_to_score(spark, numbered):
    rows, size = numbered
    empty = rows.limit(0)
    model = factors.train_factors(empty, ["id"], size, [(FactorParams(), None)])[0]
    assert np.array_equal(model.weights, model.fresh())
    assert factors.score_factors(empty, model).count() == 0
    odd = spark.createDataFrame([(1, [-1, 99, 0])], "id int, numbers array<int>")
    assert factors.score_factors(odd, model).first().plausibility == pytest.approx(0.5)


def test_tasks_by_type(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(a), str(int(a) if i else "x"), float(2 * a + 1), int(a == 2), i % 2) for i, a in enumerate(rng.integers(0, 4, 800))]
    rows = spark.createDataFrame(data, "id int, a int, level string, amount double, two int, fold int")
    tasks = spark.createDataFrame(
        [("level", "sequence", 4), ("amount", "continuous", 1), ("two", "class", 2)], "feature string, task_type string, num_labels int"
    ).unionByName(spark.createDataFrame([("a", "class", 4)], "feature string, task_type string, num_labels int"))
    result = run_tasks(rows, tasks, ["a", "amount"], ["id"], FactorParams(num_epochs=10, batch_size=16), [0, 1])
    value = {(r.feature, r.metric, r.fold): (r.value, r.spread) for r in result.collect()}
    for fold in (0, 1):
        assert value["two", "accuracy", fold][0] > 0.95 and value["a", "accuracy", fold][0] > 0.95
        for feature in ("level", "amount"):
            assert value[feature, "rmse", fold][0] < value[feature, "rmse", fold][1] / 2
    assert {r.test_rows for r in result.where("feature = 'level'").collect()} == {399, 400}  # 'x' is left out
    wrong = spark.createDataFrame([("a", "other", 1)], tasks.schema)
    with pytest.raises(ValueError, match="unknown task"):
        run_tasks(rows, wrong, ["a"], ["id"], FactorParams(), [0])


def test_small_vocabularies_are_looked_up_and_large_ones_joined(spark, monkeypatch, capsys):
    data = [(1, ["x", "y", None]), (1, ["z", "x"]), (2, None), (3, []), (None, ["y", "q"]), (4, ["x"])]
    df = spark.createDataFrame(data, "id int, t array<string>")
    words = vocabulary.token_vocabulary(df.where("id < 4"), F.col("t"))
    looked_up = vocabulary.token_numbers(df, F.col("t"), words, ["id"])
    monkeypatch.setattr(vocabulary, "SENT_BYTES", 0)
    joined = vocabulary.token_numbers(df, F.col("t"), words, ["id"])
    assert looked_up.schema["numbers"].dataType.elementType == joined.schema["numbers"].dataType.elementType
    assert sorted(map(repr, looked_up.collect())) == sorted(map(repr, joined.collect()))
    capsys.readouterr()
    looked_up.explain()
    assert "Generate" not in capsys.readouterr().out  # rows are not taken apart into tokens


def test_gradients_side_by_side_are_those_of_each_model():
    rng = np.random.default_rng(5)
    models = [FactorModel(FactorParams(factors=f, task_type=t, levels=3, seed=f), 12) for f, t in ((3, "class"), (0, "class"), (2, "sequence"))]
    for model in models:
        model.weights = model.fresh() + rng.normal(0, 0.2, len(model.fresh()))
    numbers, label = rng.integers(0, 13, (50, 4)), rng.integers(0, 2, 50).astype(float)  # with repeated and unknown tokens
    for model, found in zip(models, factors.gradients(models, numbers, label)):
        z, v, total = model.raw(numbers)
        g, head = model.by_score(z, label)
        linear, by_factor = np.zeros(13), np.zeros((13, model.params.factors))
        np.add.at(linear, numbers, g[:, None])
        np.add.at(by_factor, numbers, g[:, None, None] * (total[:, None, :] - v))
        linear[-1], by_factor[-1] = 0, 0
        assert found == pytest.approx(np.concatenate([head, linear, by_factor.ravel()]), abs=1e-12)
    assert [len(g) for g in factors.gradients(models, numbers[:0], label[:0])] == [len(m.weights) for m in models]
