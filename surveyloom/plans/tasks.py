"""One model per described variable, of the kind its task asks for, judged by that task's metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.factors import CLASS, CONTINUOUS, ORDERED, FactorParams, score_held_out, train_factors
from surveyloom.operators.metrics import metrics_for
from surveyloom.operators.plausibility import value_tokens
from surveyloom.operators.vocabulary import token_numbers, token_vocabulary
from surveyloom.sources.scratch import materialise

TASKS = (CLASS, CONTINUOUS, ORDERED)


def run_tasks(
    rows: DataFrame, tasks: DataFrame, features: list[str], keys: list[str], base: FactorParams,
    folds: list[int], fold_col: str = "fold",
) -> DataFrame:
    """(feature, task_type, fold, test_rows, spread, metric, value): every described variable on every fold.

    `tasks` has a line per variable (feature, task_type, num_labels); each is predicted
    from the other `features`. Classes and ordered answers are whole numbers from 0, a
    cell that is no number is left out. The test rows' own spread, the error of always
    answering their mean, stands beside the metrics.
    """
    parts = None
    for task in tasks.orderBy("feature").collect():  # a line per variable of the schema
        if task["task_type"] not in TASKS:
            raise ValueError(f"unknown task {task['task_type']} of {task['feature']}")
        result = _one_task(rows, task, [f for f in features if f != task["feature"]], keys, base, folds, fold_col)
        parts = result if parts is None else parts.unionByName(result)
    return parts


def _one_task(rows, task, features, keys, base, folds, fold_col) -> DataFrame:
    feature, kind = task["feature"], task["task_type"]
    label = F.expr(f"try_cast(`{feature}` as double)")
    labelled = rows.withColumn("label", label).where("label is not null")
    tokens = value_tokens(features)
    labelled = materialise(labelled.select(*keys, fold_col, "label", tokens.alias("tokens")), "labelled")
    words = materialise(token_vocabulary(labelled, F.col("tokens")), "vocabulary")
    numbered = labelled.select(*keys, fold_col, "label").join(token_numbers(labelled, F.col("tokens"), words, keys), keys)
    numbered = materialise(numbered, "numbered")
    params = replace(base, task_type=kind, levels=task["num_labels"] if kind == ORDERED else 2)
    positives = [1] if kind != CLASS or task["num_labels"] <= 2 else list(range(task["num_labels"]))
    settings = [(replace(params, positive=p), fold) for p in positives for fold in folds]
    models = train_factors(numbered, keys, words.count(), settings, "label", fold_col)
    scored = score_held_out(numbered.where(F.col(fold_col).isin(folds)), models, fold_col)
    if len(positives) > 1:  # the class whose own model is surest
        answer = F.max_by(F.floor(F.col("model") / len(folds)).cast("int"), F.struct("plausibility", -F.col("model")))
        scored = scored.groupBy(*keys, fold_col, "label").agg(answer.alias("prediction"))
    scored = materialise(scored, "scored")
    measured = metrics_for(scored, "label", "prediction", kind, [fold_col])
    names = [c for c in measured.columns if c != fold_col]
    long = measured.unpivot([fold_col], names, "metric", "value")
    facts = scored.groupBy(fold_col).agg(F.count("*").alias("test_rows"), F.stddev_pop("label").alias("spread"))
    return long.join(facts, fold_col).select(
        F.lit(feature).alias("feature"), F.lit(kind).alias("task_type"), fold_col, "test_rows", "spread", "metric", "value"
    )
