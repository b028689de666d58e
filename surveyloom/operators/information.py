"""Mutual information of every feature with every target, in one scan.

Each row is turned into (feature, value) x (target, value) tuples by two array
explodes, which stay small code for any number of columns, and counted with a
map-side combine; only contingency counts are shuffled. A constant feature and a
constant target ride along, so marginals and the total come out of the very same
count:

    MI(f, t) = [S(f, t) - S(f, -) - S(-, t) + S(-, -)] / n,   S = sum c * ln c

No window or join ever touches the counts of a single value, so a value that
holds a third of the table is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = -1


def _named(position: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (position + 1).cast("int"))


def _tuple_counts(
    df: DataFrame, features: list[str], targets: list[str], margins: bool
) -> DataFrame:
    if not features or not targets:
        raise ValueError("at least one feature and one target are needed")

    def cells(names: list[str]) -> Column:
        extra = [F.lit(0.0)] if margins else []
        return F.array(*[F.col(n).cast("double") for n in names], *extra)

    by_feature = df.select(
        F.posexplode(cells(features)).alias("f", "feature_value"), cells(targets).alias("_targets")
    )
    pairs = by_feature.select(
        "f", "feature_value", F.posexplode("_targets").alias("t", "target_value")
    )
    return pairs.groupBy("f", "t", "feature_value", "target_value").agg(F.count("*").alias("n"))


def contingency(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, target, feature_value, target_value, n) for all pairs."""
    counts = _tuple_counts(df, features, targets, margins=False)
    return counts.select(
        _named(F.col("f"), features).alias("feature"),
        _named(F.col("t"), targets).alias("target"),
        "feature_value",
        "target_value",
        "n",
    )


def mutual_information(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, target, mi) in nats; gaps must already be filled."""
    counts = _tuple_counts(df, features, targets, margins=True)
    n = F.col("n").cast("double")
    sums = counts.groupBy("f", "t").agg(
        F.sum(n * F.log(n)).alias("s"), F.sum("n").cast("double").alias("rows")
    )
    # from here on (features + 1) x (targets + 1) rows
    no_f, no_t = F.lit(len(features)), F.lit(len(targets))
    with_margins = sums.withColumn(
        "s_feature", F.max(F.when(F.col("t") == no_t, F.col("s"))).over(Window.partitionBy("f"))
    ).withColumn(
        "s_target", F.max(F.when(F.col("f") == no_f, F.col("s"))).over(Window.partitionBy("t"))
    )
    total = F.col("rows") * F.log("rows")
    mi = (F.col("s") - F.col("s_feature") - F.col("s_target") + total) / F.col("rows")
    return with_margins.where((F.col("f") != no_f) & (F.col("t") != no_t)).select(
        _named(F.col("f"), features).alias("feature"),
        _named(F.col("t"), targets).alias("target"),
        F.greatest(F.lit(0.0), mi).alias("mi"),
    )


def mi_sum(mi: DataFrame) -> DataFrame:
    """(feature, mi_sum) over all targets."""
    return mi.groupBy("feature").agg(F.sum("mi").alias("mi_sum"))


def mi_table(mi: DataFrame, targets: list[str]) -> DataFrame:
    """One row per feature, one column per target, and their sum."""
    per_target = [F.max(F.when(F.col("target") == t, F.col("mi"))).alias(t) for t in targets]
    return mi.groupBy("feature").agg(*per_target, F.sum("mi").alias("mi_sum"))


def top_k_features(sums: DataFrame, k: int, decimals: int = 12) -> DataFrame:
    """The k best features; equal sums are ordered by name.

    Sums are compared after rounding, since their last digits depend on the
    order in which partial sums were merged.
    """
    return sums.orderBy(F.round("mi_sum", decimals).desc(), "feature").limit(k)


def feature_names(top: DataFrame) -> list[str]:
    """Names on the driver: they shape the schema of what follows."""
    return [row["feature"] for row in top.select("feature").collect()]


def select_features(
    df: DataFrame, targets: list[str], features: list[str], k: int
) -> DataFrame:
    """(feature, mi_sum) of the k features that tell most about the targets."""
    return top_k_features(mi_sum(mutual_information(df, features, targets)), k)
