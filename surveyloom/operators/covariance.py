"""Covariance matrices as long tables, their difference and its norm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.operators.labels import LabelMap, encode_targets


def accepted_rows(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.where(F.col(prediction) == 1)


def covariance_matrix(df: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """(row, col, cov): sample covariance of all pairs from one aggregate.

    Only the upper triangle is computed; the other half is its mirror image.
    """
    names = names or columns
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    wide = df.agg(
        *[
            F.covar_samp(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(
                f"c{i}_{j}"
            )
            for i, j in pairs
        ]
    )
    cells = [
        F.struct(
            F.lit(names[i]).alias("row"),
            F.lit(names[j]).alias("col"),
            F.col(f"c{min(i, j)}_{max(i, j)}").alias("cov"),
        )
        for i in range(k)
        for j in range(k)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def covariance_diff(real: DataFrame, predicted: DataFrame) -> DataFrame:
    """(row, col, true_cov, pred_cov, diff)."""
    return (
        real.withColumnRenamed("cov", "true_cov")
        .join(predicted.withColumnRenamed("cov", "pred_cov"), ["row", "col"])
        .withColumn("diff", F.col("true_cov") - F.col("pred_cov"))
    )


def frobenius_norm(diff: DataFrame) -> DataFrame:
    return diff.agg(F.sqrt(F.sum(F.pow("diff", F.lit(2.0)))).alias("frobenius_norm"))


def clamped(matrix: DataFrame, limit: float = fv.HEAT_LIMIT) -> DataFrame:
    """The matrix within the colour range of a heat map."""
    bound = F.lit(float(limit))
    return matrix.withColumn("cov", F.greatest(-bound, F.least(bound, F.col("cov"))))


def covariance_report(
    real: DataFrame | None, scored: DataFrame, targets: list[str], labels: LabelMap, true_cov: DataFrame | None = None
) -> DataFrame:
    """(row, col, true_cov, pred_cov, diff, frobenius_norm) of accepted candidates against real rows.

    Either table is read once; the norm comes from the rows of the difference, one
    per pair of targets. ``true_cov`` is the covariance matrix of the real rows, where
    it is known already.
    """
    encoded = encode_targets(accepted_rows(scored), targets, labels)
    accepted = covariance_matrix(encoded, [f"{t}_num" for t in targets], targets)
    diff = covariance_diff(covariance_matrix(real, targets) if true_cov is None else true_cov, accepted)
    squares = F.sum(F.pow("diff", F.lit(2.0))).over(Window.partitionBy())
    return diff.withColumn("frobenius_norm", F.sqrt(squares))
