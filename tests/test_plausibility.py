import pytest
from pyspark.sql import functions as F

from surveyloom.config import ExperimentConfig, PlausibilityParams
from surveyloom.operators import candidates, plausibility, ranks
from surveyloom.plans import training_set as study
from surveyloom.plans.experiment import run_experiment, score_saved_model
from surveyloom.sources import demo, scratch

PARAMS = PlausibilityParams(num_epochs=2)
T, FEATURES = demo.TARGETS, demo.FEATURES


@pytest.fixture(scope="module")
def parts(spark, sf):
    num = scratch.materialise(demo.survey_num(spark, sf.replace("0.001", "0.01")), "num")
    clean = study_clean(num)
    text = demo.spelled_out(num)
    real = scratch.materialise(study.text_dataset(text, clean, demo.CONFIG, FEATURES), "real")
    n = real.count()
    drawn = scratch.materialise(candidates.generate_candidates(real, T, demo.LABELS, 2 * n), "drawn")
    built = study.build_training_set(real, drawn, demo.CONFIG, demo.DICTIONARY, FEATURES, n)
    return real, drawn, built, scratch.materialise(study.assign_folds(built.training, 5, demo.CONFIG), "rows")


def study_clean(num):
    from surveyloom.operators.clean import prepare

    return prepare(num, T)


def test_training_set_is_complete(parts):
    real, drawn, built, rows = parts
    n = real.count()
    counts = {r.labels: r["count"] for r in rows.groupBy("labels").count().collect()}
    assert counts == {0: n, 1: n}
    keys = ["id", "draw_no"]
    sampled = rows.where("labels = 0").select(*keys)
    assert sampled.unionAll(built.remaining.select(*keys)).exceptAll(drawn.select(*keys)).isEmpty()
    assert sampled.join(built.remaining, keys, "left_semi").isEmpty()
    assert rows.groupBy("id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert rows.groupBy(*keys).count().where("count > 1").isEmpty()


def test_tokens(spark):
    df = spark.createDataFrame([("1", None, 2.0, "x")], "a string, b string, s double, t string")
    tokens = plausibility.value_tokens(["a", "b", "s", "t"])
    row = df.select(plausibility.crossed_tokens(tokens, 2, 2).alias("x")).collect()[0].x
    assert row == [
        "a=1", "b=nan", "s=2.0", "t=x", "a=1&s=2.0", "a=1&t=x", "b=nan&s=2.0", "b=nan&t=x", "s=2.0&t=x",
    ]
    assert df.select(plausibility.crossed_tokens(tokens, 3, 1).alias("x")).collect()[0].x[4:] == [
        "a=1&t=x", "b=nan&t=x", "s=2.0&t=x",
    ]


def test_crosses_learn_what_main_effects_cannot(parts):
    rows = parts[3]
    accuracy = {}
    for crosses in (True, False):
        params = PARAMS.with_values(crosses=crosses)
        vectors = plausibility.with_vectors(rows, FEATURES, T, params)
        train, test = ranks.fold_split(vectors, 0)
        scored, result = plausibility.evaluate(plausibility.train_plausibility(train, params), test)
        accuracy[crosses] = result.collect()[0].accuracy
        assert scored.where("plausibility not between 0 and 1").isEmpty()
    assert accuracy[True] > 0.85
    assert 0.4 < accuracy[False] < 0.6


def test_scores_stay_with_their_rows(parts, tmp_path):
    _, _, built, rows = parts
    vectors = plausibility.with_vectors(rows, FEATURES, T, PARAMS)
    model = plausibility.train_plausibility(vectors, PARAMS)
    remaining = plausibility.with_vectors(built.remaining, FEATURES, T, PARAMS)
    scored = plausibility.score(model, remaining)
    again = plausibility.score(model, remaining.repartition(13))
    keys = ["id", "draw_no", "prediction"]
    assert scored.select(*keys).exceptAll(again.select(*keys)).isEmpty()
    assert set(T) <= set(scored.columns) and "text" in scored.columns
    plausibility.save_model(model, str(tmp_path / "model"))
    loaded = plausibility.score(plausibility.load_model(str(tmp_path / "model")), remaining)
    assert scored.select(*keys).exceptAll(loaded.select(*keys)).isEmpty()


def test_search(parts):
    rows = parts[3]
    vectors = scratch.materialise(
        plausibility.with_vectors(rows, FEATURES, T, PARAMS).select("labels", "fold", "features"), "vectors"
    )
    per_fold = plausibility.cross_validate(vectors, PARAMS, [0, 4])
    assert sorted(r.fold for r in per_fold.collect()) == [0, 4]
    trials = plausibility.grid_of(PARAMS, [1, 2], [1e-3, 100.0])
    assert len(trials) == 4
    best, table = plausibility.search_best(vectors, trials, [0], parallel=2)
    assert best.weight_decay == 1e-3 and table.count() == 4
    tried = {r.weight_decay: r.accuracy for r in table.collect()}
    assert tried[1e-3] > tried[100.0]  # weight decay changes the model


def test_drawn_settings(spark):
    drawn = plausibility.drawn_trials(spark, PARAMS, 30, "s")
    assert len(drawn) == 30 and drawn == plausibility.drawn_trials(spark, PARAMS, 30, "s")
    assert all(15 <= p.num_epochs <= 25 for p in drawn)
    assert {p.weight_decay for p in drawn} == {0.01, 0.03, 0.05, 0.1, 0.2}
    assert len(set(drawn)) > 10


def test_experiment_with_search(spark, sf, tmp_path):
    num = scratch.materialise(demo.survey_num(spark, sf), "num")
    names = spark.createDataFrame(list(demo.DICTIONARY.items()), "name string, simplab string")
    sizes = ExperimentConfig(
        feature_counts=[2], candidates=900, train_candidates=400, folds=2, run_folds=[1], search_epochs=(1, 2)
    )
    out = str(tmp_path / "out")
    rows = run_experiment(
        spark, num, demo.spelled_out(num), names, out, demo.CONFIG, sizes, search_trials=2
    ).collect()
    trials = spark.read.parquet(f"{out}/search").orderBy("accuracy").collect()
    assert len(rows) == 1 and len(trials) == 2
    assert rows[0].accuracy == pytest.approx(trials[-1].accuracy)


def test_own_scorer(spark):
    df = spark.range(10)
    scored = plausibility.score_with(df, lambda batch: batch["id"] * 0.5)
    assert {r.id: r.prediction for r in scored.collect()} == {i: i / 2 for i in range(10)}


def test_collisions_are_counted(parts):
    rows = parts[3]
    few = plausibility.token_collisions(rows, FEATURES, T, PARAMS.with_values(hash_dimensions=64))
    assert few == 1.0
    assert plausibility.token_collisions(rows, FEATURES, T, PARAMS) < 0.02


def test_experiment(spark, sf, tmp_path):
    num = scratch.materialise(demo.survey_num(spark, sf), "num")
    names = spark.createDataFrame(list(demo.DICTIONARY.items()), "name string, simplab string")
    sizes = ExperimentConfig(
        feature_counts=[1, 3], epochs=[1], candidates=900, train_candidates=400, folds=3, run_folds=[0, 2],
        fold_by="row",
    )
    out = str(tmp_path / "out")
    ledger = run_experiment(spark, num, demo.spelled_out(num), names, out, demo.CONFIG, sizes)
    rows = ledger.orderBy("feature_count", "fold").collect()
    assert [(r.feature_count, r.grid_no, r.fold) for r in rows] == [(1, 0, 0), (1, 0, 2), (3, 0, 0), (3, 0, 2)]
    assert all(0 <= r.accuracy <= 1 and 0.5 <= r.majority_rate <= 1 for r in rows)
    assert all(value is not None for r in rows for value in r)  # every point is scored and compared
    points = {"f1-0-0": 500, "f1-0-2": 500, "f3-0-0": 500, "f3-0-2": 500}
    scored = spark.read.parquet(f"{out}/scored_candidates")
    assert {r.run_id: r["count"] for r in scored.groupBy("run_id").count().collect()} == points
    accepted = {r.run_id: r["count"] for r in scored.where("prediction = 1").groupBy("run_id").count().collect()}
    assert {p: accepted.get(p, 0) for p in points} == {f"f{r.feature_count}-0-{r.fold}": r.accepted for r in rows}
    assert spark.read.parquet(f"{out}/covariance").count() == 4 * 25
    texts = spark.read.parquet(f"{out}/text_dataset/run_id=f1")
    assert texts.count() == 866 + 400 and {r.fold for r in texts.select("fold").distinct().collect()} == {0, 1, 2}
    assert spark.read.parquet(f"{out}/missing_codes").where("cells > 0").count() > 0
    assert spark.read.parquet(f"{out}/nulls").count() == spark.read.parquet(f"{out}/unparseable").count() == len(num.columns)
    held_back = spark.read.parquet(f"{out}/remain_dataset/run_id=f1")
    features = [c for c in held_back.columns if c not in ("id", "draw_no", "text", *T)]
    again = score_saved_model(spark, out, "f1-0-2", held_back, features, demo.CONFIG, sizes.base)
    keys = ["id", "draw_no", "prediction"]
    assert again.select(*keys).exceptAll(spark.read.parquet(f"{out}/scored_candidates/run_id=f1-0-2").select(*keys)).isEmpty()


def test_nothing_held_back_and_a_repeated_run(spark, sf, tmp_path):
    num = scratch.materialise(demo.survey_num(spark, sf), "num")
    names = spark.createDataFrame(list(demo.DICTIONARY.items()), "name string, simplab string")
    out = str(tmp_path / "out")

    def run(train):
        sizes = ExperimentConfig(feature_counts=[1], epochs=[1], candidates=900, train_candidates=train, folds=2, run_folds=[0])
        return run_experiment(spark, num, demo.spelled_out(num), names, out, demo.CONFIG, sizes)

    assert run(400).count() == 1
    line = run(900)  # replaces the run before, with no candidate left
    assert line.count() == 1 and line.first().accepted == 0
    assert spark.read.parquet(f"{out}/remain_dataset/run_id=f1").count() == 0
    assert spark.read.parquet(f"{out}/scored_candidates/run_id=f1-0-0").count() == 0


def test_clashing_dictionary_is_an_error(spark, sf, tmp_path):
    num = scratch.materialise(demo.survey_num(spark, sf), "num")
    names = spark.createDataFrame([("yr", "order year"), ("yr", "other")], "name string, simplab string")
    with pytest.raises(Exception, match="different labels"):
        run_experiment(spark, num, demo.spelled_out(num), names, str(tmp_path), demo.CONFIG, ExperimentConfig([1]))


def test_illegal_answers_stop_the_experiment(spark, sf, tmp_path):
    num = scratch.materialise(demo.survey_num(spark, sf), "num").withColumn(
        "prio", F.when(F.col("id") % 10 == 0, "77").otherwise(F.col("prio"))
    )
    names = spark.createDataFrame([("yr", "order year")], "name string, simplab string")
    with pytest.raises(ValueError, match="outside the legal answers"):
        run_experiment(spark, num, demo.spelled_out(num), names, str(tmp_path), demo.CONFIG, ExperimentConfig([1]))


def test_an_interrupted_grid_goes_on(spark, sf, tmp_path, monkeypatch):
    from surveyloom.plans import experiment

    num = scratch.materialise(demo.survey_num(spark, sf), "num")
    names = spark.createDataFrame(list(demo.DICTIONARY.items()), "name string, simplab string")
    sizes = ExperimentConfig(feature_counts=[2], epochs=[1], candidates=900, train_candidates=400, folds=3)
    out = str(tmp_path / "out")
    ran = []
    plain, save = experiment.Point.run, experiment.save_model

    def noted(point, *args):
        ran.append(point.run_id)
        plain(point, *args)

    def broken(model, path):
        if "f2-0-1" in path:
            raise RuntimeError("lost")
        save(model, path)

    def run(resume):
        ran.clear()
        return run_experiment(spark, num, demo.spelled_out(num), names, out, demo.CONFIG, sizes, resume=resume)

    monkeypatch.setattr(experiment.Point, "run", noted)
    monkeypatch.setattr(experiment, "save_model", broken)
    with pytest.raises(RuntimeError, match="lost"):
        run(True)
    assert "f2-0-0" in ran
    monkeypatch.setattr(experiment, "save_model", save)
    finished = {r[4] for r in experiment.finished_runs(spark, out)}
    assert 0 in finished and 1 not in finished
    assert sorted(r.fold for r in run(True).collect()) == [0, 1, 2]
    assert "f2-0-1" in ran and "f2-0-0" not in ran
    run(True)
    assert ran == []


def test_models_are_as_wide_as_the_places_in_use(spark):
    from pyspark.ml.classification import LogisticRegression

    data = [(i, str(i % 7), str(i % 5), int(i % 7 == i % 5 or i % 11 == 0), i % 2) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, a string, b string, labels int, fold int")
    vectors = scratch.materialise(plausibility.with_vectors(rows, ["a"], ["b"], PARAMS), "vectors")
    model = plausibility.train_plausibility(vectors, PARAMS)
    assert model.stages[-1].numFeatures == 7 + 5 + 35  # 2**20 places otherwise, most of them empty
    whole = LogisticRegression(maxIter=PARAMS.max_iter, regParam=PARAMS.weight_decay, labelCol="labels", probabilityCol="_scores",
                               rawPredictionCol="_raw", predictionCol="_predicted").fit(vectors)
    both = plausibility.score(model, vectors).select("id", "plausibility").join(
        plausibility.score(whole, vectors).select("id", F.col("plausibility").alias("other")), "id"
    )
    assert both.count() == 400 and both.where("abs(plausibility - other) > 1e-6").isEmpty()
    # places that only unseen rows use count nothing
    unseen = plausibility.with_vectors(spark.createDataFrame([("new", "other")], "a string, b string"), ["a"], ["b"], PARAMS)
    own, other = (plausibility.score(m, unseen).first().plausibility for m in (model, whole))
    assert own == pytest.approx(other, abs=1e-6)


def test_places_of_dense_and_of_no_vectors(spark):
    from pyspark.ml.linalg import Vectors

    data = [(Vectors.dense([0.0, 1.0, 0.0]), 1), (Vectors.dense([0.0, 0.0, 2.0]), 0), (Vectors.sparse(3, [1], [1.0]), 1)]
    vectors = spark.createDataFrame(data, ["features", "labels"])
    assert plausibility.used_places(vectors).selectedFeatures == [1, 2]
    assert plausibility.used_places(vectors.where("labels > 1")) is None
