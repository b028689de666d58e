"""Covariance of many columns by partial products.

`covariance_matrix` writes one expression per pair of columns, which suits some dozens.
Here every task works through its rows batch by batch and keeps three k x k arrays: the
rows in which both columns of a pair have a value, the means of a column over these
rows, and the sum of products of deviations. A task sends one line per pair, and lines
are merged by the rule for deviations around different means, so nothing is lost to
cancellation however far the values lie from zero. The plan has the same size for any
number of columns; memory is k x k numbers a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = 1 << 16
PARTIAL = "i int, j int, n double, mean_i double, mean_j double, moment double"

Moments = tuple[np.ndarray, np.ndarray, np.ndarray]  # rows, means of i over the rows of (i, j), products


def batch_moments(values: np.ndarray) -> Moments:
    """Moments of all pairs of columns over the rows of one batch; NaN marks a gap."""
    there = ~np.isnan(values)
    counts = there.sum(0)
    shift = np.where(there, values, 0.0).sum(0) / np.maximum(counts, 1)
    filled = np.where(there, values - shift, 0.0)
    marks = there.astype(np.float64)
    n = marks.T @ marks
    means = filled.T @ marks / np.maximum(n, 1)
    return n, means + shift[:, None], filled.T @ filled - n * means * means.T


def merged(left: Moments, right: Moments) -> Moments:
    n = left[0] + right[0]
    share = right[0] / np.maximum(n, 1)
    apart = right[1] - left[1]
    return n, left[1] + apart * share, left[2] + right[2] + apart * apart.T * left[0] * share


def partial_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, mean_i, mean_j, moment): one line per task and pair i <= j."""
    k = len(columns)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
                found = batch_moments(np.column_stack(own))
                total = found if total is None else merged(total, found)
        if total is not None:
            n, means, moments = total
            i, j = np.triu_indices(k)
            for lo in range(0, len(i), LINES):
                a, b = i[lo : lo + LINES], j[lo : lo + LINES]
                lines = [a.astype(np.int32), b.astype(np.int32), n[a, b], means[a, b], means[b, a], moments[a, b]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in lines], names=[f.split()[0] for f in PARTIAL.split(", ")])

    cells = df.select(*[F.col(c).cast("double").alias(f"c{at}") for at, c in enumerate(columns)])
    return cells.mapInArrow(run, PARTIAL)


def gram_covariance(df: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """(row, col, cov): sample covariance of all pairs of columns over the rows that have both.

    * Null and NaN cells take no part. Fewer than two rows for a pair: null.
    * Empty table: all pairs, null. Other columns are ignored; names must be distinct.
    """
    names = names or columns
    k = len(columns)
    if not k or len(set(names)) != k or len(names) != k:
        raise ValueError("at least one column is needed, and distinct names")
    spark = df.sparkSession
    every = spark.range(k * k).selectExpr(f"cast(id div {k} as int) as i", f"cast(id % {k} as int) as j").where("i <= j")
    nothing = every.select("i", "j", *[F.lit(0.0).alias(c) for c in ("n", "mean_i", "mean_j", "moment")])
    lines = partial_moments(df, columns).unionByName(nothing)
    pair = Window.partitionBy("i", "j")
    overall = lambda c: F.sum(F.col("n") * F.col(c)).over(pair) / F.greatest(F.sum("n").over(pair), F.lit(1.0))
    centred = lines.withColumns({"all_i": overall("mean_i"), "all_j": overall("mean_j")})
    spread = F.col("n") * (F.col("mean_i") - F.col("all_i")) * (F.col("mean_j") - F.col("all_j"))
    sums = centred.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("moment") + spread).alias("moment"))
    upper = sums.select("i", "j", F.when(F.col("n") > 1, F.col("moment") / (F.col("n") - 1)).alias("cov"))
    both = F.array_distinct(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    title = lambda at: F.element_at(F.lit(names), F.col(at) + 1)
    return upper.select(F.explode(both).alias("_p"), "cov").select(
        title("_p.i").alias("row"), title("_p.j").alias("col"), "cov"
    )
