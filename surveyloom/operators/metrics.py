"""Classification and regression metrics, each from a single aggregate.

An undefined ratio (no predicted or no true positives) counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from surveyloom import fixed_values as fv
from surveyloom.functions.arrays import squeezed
from surveyloom.functions.cells import remap


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_columns(truth: Column, guess: Column) -> list[Column]:
    """accuracy, f1, precision and recall as aggregates."""
    tp = F.count_if((truth == 1) & (guess == 1))
    fp = F.count_if((truth != 1) & (guess == 1))
    fn = F.count_if((truth == 1) & (guess != 1))
    return [
        _ratio(F.count_if(truth == guess), F.count("*")).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    ]


def _rmse(truth: Column, guess: Column) -> Column:
    return F.sqrt(F.avg(F.pow(guess - truth, F.lit(2.0))))


def _doubles(label: str, prediction: str) -> tuple[Column, Column]:
    return F.col(label).cast("double"), F.col(prediction).cast("double")


def binary_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    """(accuracy, f1, precision, recall) with 1 as the positive class."""
    return df.groupBy(*(by or [])).agg(*binary_columns(F.col(label), F.col(prediction)))


def label_precision(truth: Column, guess: Column) -> Column:
    """The prediction, or the label itself where rounding would reach it."""
    return F.when(F.rint(guess) == truth, truth).otherwise(guess)


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    truth, guess = _doubles(label, prediction)
    return df.agg(_rmse(truth, guess).alias("rmse"))


def rmse_rounded(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Error of predictions rounded half to even."""
    truth, guess = _doubles(label, prediction)
    return df.agg(_rmse(truth, F.rint(guess)).alias("integerized_rmse"))


def rmse_label_precision(df: DataFrame, label: str, prediction: str) -> DataFrame:
    truth, guess = _doubles(label, prediction)
    return df.agg(_rmse(truth, label_precision(truth, guess)).alias("label_precision_rmse"))


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    """(rmse, integerized_rmse, label_precision_rmse)."""
    truth, guess = _doubles(label, prediction)
    return df.groupBy(*(by or [])).agg(
        _rmse(truth, guess).alias("rmse"),
        _rmse(truth, F.rint(guess)).alias("integerized_rmse"),
        _rmse(truth, label_precision(truth, guess)).alias("label_precision_rmse"),
    )


def relevance_metrics(
    df: DataFrame, label: str, prediction: str, irrelevant: int = fv.IRRELEVANT,
    mapping: dict[int, int] | None = None,
) -> DataFrame:
    """Accuracy on raw codes, binary metrics on relevance, error on relevant rows."""
    mapping = fv.RELEVANCE_MAP if mapping is None else mapping
    truth, guess = F.col(label), F.col(prediction)
    is_relevant = (truth != irrelevant) & (guess != irrelevant)
    squared = F.when(is_relevant, F.pow((guess - truth).cast("double"), F.lit(2.0)))
    relevance = [
        c.alias(f"relevant_{name}")
        for c, name in zip(
            binary_columns(remap(truth, mapping), remap(guess, mapping)),
            ["accuracy", "f1", "precision", "recall"],
        )
    ]
    return df.agg(
        _ratio(F.count_if(truth == guess), F.count("*")).alias("accuracy"),
        *relevance,
        F.sqrt(F.avg(squared)).alias("rmse"),
    )


def metrics_for(
    df: DataFrame, label: str, prediction: str, task_type: str, by: list[str] | None = None
) -> DataFrame:
    """Binary metrics for class tasks, regression metrics for all others; one-element lists are unpacked."""
    if isinstance(df.schema[prediction].dataType, ArrayType):  # models answer with one-element lists
        df = df.withColumn(prediction, squeezed(F.col(prediction)))
    chosen = binary_metrics if task_type == "class" else regression_metrics
    return chosen(df, label, prediction, by)


def best_config(
    ledger: DataFrame, config: list[str], metric: str = "accuracy", maximise: bool = True
) -> DataFrame:
    """The one row with the best metric; equal metrics are ordered by configuration."""
    first = F.col(metric).desc() if maximise else F.col(metric).asc()
    return ledger.orderBy(first, *config).limit(1)
