"""Real-versus-generated classifier on MLlib.

Real and generated rows differ in how values go together, so besides
``feature=value`` tokens the model sees feature x target and target x target
crosses. Tokens are hashed to a sparse vector; the model is MLlib's logistic
regression, trained by ``logistic`` for all folds and settings in the same scans.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VarianceThresholdSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.config import PlausibilityParams
from surveyloom.functions.arrays import argmax
from surveyloom.operators import logistic
from surveyloom.operators.grid import grid_rows, param_draws
from surveyloom.operators.hashed import distinct_tokens, hashed_vector
from surveyloom.operators.metrics import binary_columns, binary_metrics
from surveyloom.operators.ranks import fold_split
from surveyloom.sources.scratch import materialise

SCORE = "_score_"


def value_tokens(columns: list[str]) -> Column:
    """One ``column=value`` token per column."""
    return F.array(
        *[
            F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan")))
            for c in columns
        ]
    )


def crossed_tokens(tokens: Column, n_features: int, n_targets: int) -> Column:
    """The tokens and their feature x target and target x target pairs.

    ``tokens`` lists the features first. Pairs are formed from the list itself, so
    a value is turned into text once however many pairs it is part of, and the
    expression has the same size for any number of columns.
    """
    of_features = F.slice(tokens, 1, n_features)
    of_targets = F.slice(tokens, n_features + 1, n_targets)

    def with_each(token: Column, others: Column) -> Column:
        return F.transform(others, lambda other: F.concat(token, F.lit("&"), other))

    mixed = F.flatten(F.transform(of_features, lambda f: with_each(f, of_targets)))
    among_targets = F.flatten(
        F.transform(of_targets, lambda t, i: with_each(t, F.slice(of_targets, i + 2, n_targets)))
    )
    return F.concat(tokens, mixed, among_targets)


def with_vectors(
    df: DataFrame, features: list[str], targets: list[str], params: PlausibilityParams
) -> DataFrame:
    """Add the hashed ``features`` vector; done once, then shared by all models."""
    return df.withColumn("features", hashed_vector(features, targets, params.hash_dimensions, params.crosses))


def used_places(vectors: DataFrame, name: str = "features"):
    """A selector of the places that any row uses, fitted; None for an empty table.

    Hashed vectors are long and nearly all their places are empty everywhere. Those get
    no weight in any model, so a model without them is the same, and its gradients, of
    which every task sends one per iteration, have the size of the data's tokens.
    """
    first = vectors.select(name).first()
    if first is None:
        return None

    def run(batches):
        seen = np.zeros(0, bool)
        for batch in batches:
            places = batch["place"].flatten().to_numpy(zero_copy_only=False)
            marks = np.zeros(max(len(seen), int(places.max(initial=-1)) + 1), bool)
            marks[places] = True
            marks[: len(seen)] &= ~seen
            if len(fresh := np.flatnonzero(marks)):
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int32())], names=["place"])
                marks[: len(seen)] |= seen
                seen = marks

    # at most one line per place of the vector
    places = vectors.select(logistic.filled_places(name).alias("place")).mapInArrow(run, "place int")
    used = sorted(r[0] for r in places.distinct().collect()) or [0]
    size = first[0].size
    marks = [(Vectors.sparse(size, used, [1.0] * len(used)),), (Vectors.sparse(size, [], []),)]
    selector = VarianceThresholdSelector(featuresCol=name, outputCol="_used")
    return selector.fit(vectors.sparkSession.createDataFrame(marks, [name]).coalesce(1))


def train_plausibility(
    vectors: DataFrame, params: PlausibilityParams | list[PlausibilityParams], label: str = "labels", selector=None,
    unseen: list[int] | None = None, fold_col: str = "fold",
):
    """Fit the classifier on rows that already carry their vector.

    ``selector`` leaves out places that no row uses; a table's ``used_places`` serve
    all its folds and settings. The model takes whole vectors. A list of settings, with
    for each the fold that its model must not see, gives a list of models, all trained
    in the same scans.
    """
    settings = params if isinstance(params, list) else [params]
    folds = unseen if unseen is not None else [None] * len(settings)
    selector = selector or used_places(vectors)
    models = _trained(vectors, settings, folds, label, selector, fold_col) if settings else []
    return models if isinstance(params, list) else models[0]


def _classifier(params: PlausibilityParams, label: str, selector) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_used" if selector else "features",
        labelCol=label,
        maxIter=params.max_iter,
        regParam=params.weight_decay,
        probabilityCol="_scores",
        rawPredictionCol="_raw",
        predictionCol="_predicted",
    )


def _trained(
    vectors: DataFrame, settings: list[PlausibilityParams], folds: list, label: str, selector, fold_col: str
) -> list[PipelineModel]:
    fold = F.lit(0) if all(f is None for f in folds) else F.col(fold_col)
    classes = [F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)]
    counts = vectors.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), *classes).collect()

    def both_classes(unseen: int | None) -> bool:
        seen = [r for r in counts if unseen is None or r.fold not in (None, unseen)]
        zeros, ones = sum(r.n0 for r in seen), sum(r.n1 for r in seen)
        return zeros > 0 and ones > 0 and zeros + ones == sum(r.n for r in seen)

    # other labels than 0 and 1, or one class only: the library's own cases
    special = {f for f in folds if selector is None or not both_classes(f)}
    plain = [(f, p.weight_decay, p.max_iter) for p, f in zip(settings, folds) if f not in special]
    found = iter(_solved(vectors.where(F.col(label).isin(0, 1)), plain, label, selector, fold) if plain else [])
    models = []
    for params, unseen in zip(settings, folds):
        classifier = _classifier(params, label, selector)
        if unseen in special:
            train = vectors if unseen is None else fold_split(vectors, unseen, fold_col)[0]
            model = classifier.fit(selector.transform(train) if selector else train)
        else:
            model = _library_model(vectors.sparkSession, classifier, *next(found))
        models.append(PipelineModel([selector, model] if selector else [model]))
    return models


def _solved(vectors: DataFrame, settings: list[tuple], label: str, selector, fold: Column) -> list[tuple]:
    used = list(selector.selectedFeatures)
    size = vectors.select("features").first()[0].size
    blocks = logistic.write_blocks(vectors, used, size, label, fold)
    parts = blocks.rdd.getNumPartitions()
    moments = logistic.fold_moments(blocks, len(used), parts)
    return logistic.train_all(blocks, settings, moments, len(used), parts)


def _library_model(spark: SparkSession, classifier: LogisticRegression, weights: np.ndarray, constant: float):
    """MLlib's model of these weights, for saving and for its own ``transform``."""
    sc = spark.sparkContext
    matrix = _py2java(sc, DenseMatrix(1, len(weights), weights, True))
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        classifier.uid, matrix, _py2java(sc, Vectors.dense([constant])), 2, False
    )
    return classifier._copyValues(LogisticRegressionModel(made))


def score(model, vectors: DataFrame) -> DataFrame:
    """Add ``plausibility`` (score of class 1) and ``prediction`` (best class).

    The score travels with its row, so nothing has to be matched by position.
    """
    if _stages(model)[-1].coefficientMatrix.numRows == 1:
        return of_model(score_by_all([model], vectors), 0)
    scored = model.transform(vectors).withColumn("_scores", vector_to_array("_scores"))
    return (
        scored.withColumn("plausibility", F.try_element_at("_scores", F.lit(2)))
        .withColumn("prediction", argmax(F.col("_scores")))
        .drop("features", "_used", "_scores", "_raw", "_predicted")
    )


def score_by_all(models: list, vectors: DataFrame) -> DataFrame:
    """The rows with one score of class 1 for each of several models of two classes; ``of_model`` picks one's."""
    scored = vectors.withColumn("_scores", _probabilities(models, "features")).drop("features")
    return scored.withColumns({f"{SCORE}{i}": F.col(f"_scores.{SCORE}{i}") for i in range(len(models))}).drop("_scores")


def of_model(scored: DataFrame, number: int) -> DataFrame:
    """The rows with ``plausibility`` and ``prediction`` of the model of that number."""
    best = F.when(F.col("plausibility") > 0.5, F.lit(1)).otherwise(F.lit(0))
    own = scored.withColumn("plausibility", F.col(f"{SCORE}{number}")).withColumn("prediction", best)
    return own.drop(*[c for c in scored.columns if c.startswith(SCORE)])


def _stages(model) -> list:
    return getattr(model, "stages", [model])


def _weights(model) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, their weights, constant)."""
    *before, classifier = _stages(model)
    weights = classifier.coefficients.toArray()
    used = np.array(before[0].selectedFeatures, np.int64) if before else np.arange(len(weights))
    return used, weights, classifier.intercept


def _probabilities(models: list, name: str) -> Column:
    """Each model's probability of class 1, from the places and values of a vector."""
    parts = [_weights(m) for m in models]
    used = functools.reduce(np.union1d, [places for places, _, _ in parts])
    size = int(used.max(initial=0)) + 1
    tables = np.zeros((len(models), len(used) + 1))  # the last place, of all others, has no weight
    for table, (places, weights, _) in zip(tables, parts):
        table[np.searchsorted(used, places)] = weights
    constants = [constant for _, _, constant in parts]
    positions: list[logistic.Positions] = []

    def probabilities(places: pa.Array, values: pa.Array) -> pa.Array:
        if not positions:
            positions.append(logistic.Positions(used, size))
        lengths = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = places.flatten().to_numpy(zero_copy_only=False)
        at = np.where(at < size, positions[0].of(np.minimum(at, size - 1)), -1).astype(np.intp) % len(tables[0])
        values = values.flatten().to_numpy(zero_copy_only=False)
        plain = bool((values == 1).all())
        width = int(lengths.max(initial=0))
        even = plain and width * len(lengths) <= logistic.MOST_PADDING * len(at)
        if even:  # token by token
            lines = np.full((len(lengths), width), len(used), np.intp)
            lines[np.arange(width) < lengths[:, None]] = at
            filled = np.ascontiguousarray(lines.T)
        found = []
        for table, constant in zip(tables, constants):
            if even:
                margin = np.zeros(len(lengths))
                for line in filled:
                    margin += table.take(line, mode="clip")
            else:
                margin = np.bincount(np.repeat(np.arange(len(lengths)), lengths), table[at] * values, len(lengths))
            with np.errstate(over="ignore"):
                found.append(pa.array(1 - 1 / (1 + np.exp(margin + constant))))
        return pa.StructArray.from_arrays(found, names=[f"{SCORE}{i}" for i in range(len(found))])

    kind = ", ".join(f"{SCORE}{i} double" for i in range(len(models)))
    return F.arrow_udf(probabilities, f"struct<{kind.replace(' double', ': double')}>")(*logistic.sparse_parts(name))


def evaluate(model, test: DataFrame, label: str = "labels") -> tuple[DataFrame, DataFrame]:
    """(scored test rows, one row of metrics)."""
    scored = score(model, test)
    return scored, binary_metrics(scored, label, "prediction")


def score_with(
    df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "prediction",
    dtype: str = "double",
) -> DataFrame:
    """Score with the caller's own batch model; batches arrive over Arrow."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: scorer(batch)})

    return df.mapInPandas(run, f"{fields}, `{name}` {dtype}")


def fold_metrics(scored: DataFrame, label: str = "labels", by: list[str] | None = None) -> DataFrame:
    """Per group: test rows, binary metrics and the rate of the larger class."""
    by = by or []
    truth, guess = F.col(label), F.col("prediction")
    larger = F.greatest(F.sum(truth), F.count("*") - F.sum(truth)) / F.count("*")
    return scored.groupBy(*by).agg(
        F.count("*").alias("test_rows"),
        F.sum(truth).alias("positives"),
        *binary_columns(truth, guess),
        larger.alias("majority_rate"),
    )


def token_collisions(
    rows: DataFrame, features: list[str], targets: list[str], params: PlausibilityParams
) -> float:
    """Share of the distinct tokens that have no place of the vector to themselves."""
    # the vectoriser's own hash
    distinct = distinct_tokens(rows, features, targets, params.crosses)
    place = F.pmod(F.hash("token"), F.lit(params.hash_dimensions))
    places = distinct.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    share = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")
    return places.agg(share).first()[0] or 0.0


def side_by_side(work: Callable, items: list, parallel: int = 1) -> list:
    """work(item) for every item, ``parallel`` of them at a time; results in order."""
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(work, items))


def cross_validate(
    vectors: DataFrame,
    params: PlausibilityParams,
    folds: list[int],
    fold_col: str = "fold",
    label: str = "labels",
    parallel: int = 1,
    selector=None,
) -> DataFrame:
    """(fold, test_rows, positives, accuracy, f1, precision, recall, majority_rate): one model per listed fold."""
    models = train_plausibility(vectors, [params] * len(folds), label, selector, folds, fold_col)

    def held_out(fold: int) -> DataFrame:
        _, test = fold_split(vectors, fold, fold_col)
        return score(models[folds.index(fold)], test).select(fold_col, label, "prediction")

    parts = side_by_side(held_out, folds, parallel)
    return fold_metrics(functools.reduce(DataFrame.unionAll, parts), label, [fold_col])


def grid_of(
    base: PlausibilityParams, epochs: list[int], weight_decays: list[float]
) -> list[PlausibilityParams]:
    return [base.with_values(**p) for p in grid_rows({}, num_epochs=epochs, weight_decay=weight_decays)]


def drawn_trials(
    spark: SparkSession, base: PlausibilityParams, trials: int, seed: str,
    epoch_range: tuple[int, int] = fv.SEARCH_EPOCH_RANGE,
) -> list[PlausibilityParams]:
    """Settings drawn from the search space; one row per trial comes to the driver."""
    one_search = spark.range(1).withColumnRenamed("id", "search")
    table = param_draws(one_search, trials, seed, ["search"], ranges={"num_train_epochs": epoch_range})
    return [
        base.with_values(num_epochs=row["num_train_epochs"], weight_decay=row["weight_decay"])
        for row in table.orderBy("trial").collect()
    ]


def search_best(
    vectors: DataFrame,
    trials: list[PlausibilityParams],
    folds: list[int],
    fold_col: str = "fold",
    label: str = "labels",
    parallel: int = 1,
) -> tuple[PlausibilityParams, DataFrame]:
    """Best settings by mean accuracy over the folds, and the table of all trials."""
    selector = used_places(vectors)

    def tried(number: int) -> DataFrame:
        result = cross_validate(vectors, trials[number], folds, fold_col, label, selector=selector)
        return result.select(
            F.lit(number).alias("trial"),
            F.lit(trials[number].num_epochs).alias("num_epochs"),
            F.lit(trials[number].weight_decay).alias("weight_decay"),
            "accuracy", "f1", "majority_rate",
        )

    parts = side_by_side(tried, list(range(len(trials))), parallel)
    means = materialise(
        functools.reduce(DataFrame.unionAll, parts).groupBy("trial", "num_epochs", "weight_decay").agg(
            *(F.avg(c).alias(c) for c in ("accuracy", "f1", "majority_rate"))
        ),
        "trials",
    )
    first = means.orderBy(F.desc("accuracy"), "trial").first()
    return trials[first["trial"]], means


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path)
