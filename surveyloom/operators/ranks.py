"""Exact ranks, samples, quotas and folds from one hash order.

The order of rows is the order of ``digest(salt, keys)``. Two tools use it:

* ``hash_rank`` numbers every row. Rows are spread over 16**digits buckets by
  the head of their digest and numbered inside the bucket; bucket offsets come
  from a table of at most 65,536 counts, which is therefore safe to broadcast.
* ``rank_band`` only tells on which side of given ranks a row lies. It looks up
  the digests that sit at those ranks from the (column-pruned) keys and compares
  against them, so the wide rows are never shuffled or sorted. Samples, quotas
  and folds need no more than this.

Keys must be unique: md5 is uniform, so buckets are even whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.hashing import digest, h32, int_div

MIN_DIGITS, MAX_DIGITS = 2, 4
BUCKETS_PER_PARTITION = 8


def rank_digits(df: DataFrame) -> int:
    """Digest digits that name a bucket: several buckets per shuffle partition.

    At least 256 and at most 65,536 buckets; ranks do not depend on the choice.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = MIN_DIGITS
    while digits < MAX_DIGITS and 16**digits < BUCKETS_PER_PARTITION * partitions:
        digits += 1
    return digits


def _running_counts(digests: DataFrame) -> DataFrame:
    """Per bucket: rows in it, rows before it, rows in total.

    The unpartitioned windows run over the bucket table only, at most 65,536 rows.
    """
    counts = digests.groupBy("_bucket").agg(F.count("*").alias("_in_bucket"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return counts.select(
        "_bucket",
        "_in_bucket",
        (F.sum("_in_bucket").over(running) - F.col("_in_bucket")).alias("_before"),
        F.sum("_in_bucket").over(everything).alias("_rows"),
    )


def hash_rank(
    df: DataFrame, keys: list[str], salt: str, name: str = "rank", digits: int | None = None
) -> DataFrame:
    """Add the row's place 0..n-1 in the hash order, without a global sort."""
    digits = digits or rank_digits(df)
    marked = df.withColumn("_digest", digest(salt, *keys)).withColumn(
        "_bucket", F.substring("_digest", 1, digits)
    )
    offsets = _running_counts(marked.select("_bucket")).select("_bucket", "_before")
    inside = Window.partitionBy("_bucket").orderBy("_digest", *keys)
    return (
        marked.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_digest", "_place", "_before")
    )


def rank_cuts(
    df: DataFrame,
    keys: list[str],
    salt: str,
    positions: Callable[[Column], list[Column]],
    digits: int | None = None,
) -> Column:
    """Scalar subquery struct(rows, cuts): the digest at each position, if any.

    ``positions`` maps the row count to the wanted ranks, so the count needs no
    job of its own.
    """
    digits = digits or rank_digits(df)
    marked = df.select(digest(salt, *keys).alias("_digest")).withColumn(
        "_bucket", F.substring("_digest", 1, digits)
    )
    wanted = (
        _running_counts(marked)
        .select("*", F.posexplode(F.array(*positions(F.col("_rows")))).alias("_cut", "_position"))
        .where(
            (F.col("_position") >= F.col("_before"))
            & (F.col("_position") < F.col("_before") + F.col("_in_bucket"))
        )
        .select("_bucket", "_cut", "_rows", (F.col("_position") - F.col("_before")).alias("_place"))
    )
    # the same once more inside the found buckets, so that what is sorted in the end
    # does not grow with the table: counts of at most 65,536 heads per cut
    inside = marked.join(F.broadcast(wanted), "_bucket").withColumn(
        "_head", F.substring("_digest", digits + 1, MAX_DIGITS)
    )
    upto = Window.partitionBy("_cut").orderBy("_head")
    heads = (
        inside.groupBy("_cut", "_head", "_place").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n")))
        .select("_cut", "_head", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    within = Window.partitionBy("_cut").orderBy("_digest")
    found = (
        inside.join(F.broadcast(heads), ["_cut", "_head"])
        .withColumn("_number", F.row_number().over(within) - 1)
        .where(F.col("_number") == F.col("_rest"))
    )
    return found.agg(
        F.struct(
            F.max("_rows").alias("rows"),
            F.map_from_entries(F.collect_list(F.struct("_cut", "_digest"))).alias("cuts"),
        ).alias("_cuts")
    ).scalar()


def _band(order: Column, cuts: Column, n_cuts: int) -> Column:
    """How many of the cut ranks lie at or below the row's own rank."""
    band = F.lit(0)
    for i in range(n_cuts):
        passed = order >= F.try_element_at(cuts.getField("cuts"), F.lit(i))
        band = band + F.when(passed, F.lit(1)).otherwise(F.lit(0))
    return band


def rank_band(
    df: DataFrame,
    keys: list[str],
    salt: str,
    positions: Callable[[Column], list[Column]],
    n_positions: int,
    name: str = "band",
    digits: int | None = None,
) -> DataFrame:
    """Add the number of ``positions`` that are <= the row's hash rank."""
    cuts = rank_cuts(df, keys, salt, positions, digits)
    return (
        df.withColumns({"_cuts": cuts, "_order": digest(salt, *keys)})
        .withColumn(name, _band(F.col("_order"), F.col("_cuts"), n_positions))
        .drop("_cuts", "_order")
    )


def assign_quota(
    df: DataFrame, num: int, keys: list[str], seed: str, name: str = "quota",
    digits: int | None = None,
) -> DataFrame:
    """Spread ``num`` draws evenly: num div rows each, num mod rows get one more."""
    salt = f"{seed}:quota"
    total = F.lit(num).cast("bigint")
    rows = F.col("_cuts").getField("rows")
    extra = F.lit(1) - _band(digest(salt, *keys), F.col("_cuts"), 1)
    return (
        df.withColumn("_cuts", rank_cuts(df, keys, salt, lambda n: [total % n], digits))
        .withColumn(name, (int_div(total, rows) + extra).cast("bigint"))
        .drop("_cuts")
    )


def mark_sample(
    df: DataFrame, n: int, keys: list[str], seed: str, name: str = "sampled",
    digits: int | None = None,
) -> DataFrame:
    """Flag exactly ``n`` rows (all, if there are fewer) without replacement."""
    banded = rank_band(
        df, keys, f"{seed}:sample", lambda _: [F.lit(n).cast("bigint")], 1, name, digits
    )
    return banded.withColumn(name, F.col(name) == 0)


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: str) -> DataFrame:
    return mark_sample(df, n, keys, seed, "_sampled").where("_sampled").drop("_sampled")


def holdout(df: DataFrame, n: int, keys: list[str], seed: str) -> DataFrame:
    """The rows ``exact_sample`` leaves behind: same cut, opposite side, no join."""
    return mark_sample(df, n, keys, seed, "_sampled").where(~F.col("_sampled")).drop("_sampled")


def shuffle_index(df: DataFrame, keys: list[str], seed: str, name: str = "index") -> DataFrame:
    """A full shuffle, expressed as each row's position in it."""
    return hash_rank(df, keys, f"{seed}:shuffle", name)


def kfold_assign(
    df: DataFrame, folds: int, keys: list[str], seed: str, name: str = "fold",
    digits: int | None = None,
) -> DataFrame:
    """Blocks of n div k shuffled rows, the last fold takes the rest."""

    def starts(n: Column) -> list[Column]:
        size = int_div(n, F.lit(folds))
        checked = F.when(size > 0, size).otherwise(
            F.raise_error(F.lit(f"fewer rows than the {folds} folds asked for"))
        )
        return [checked * i for i in range(1, folds)]

    if folds < 2:
        raise ValueError("folds must be at least 2")
    return rank_band(df, keys, f"{seed}:shuffle", starts, folds - 1, name, digits)


def fold_by_source(
    df: DataFrame, folds: int, id_col: str, seed: str, name: str = "fold"
) -> DataFrame:
    """One fold per source row: a respondent and all copies stay together."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    return df.withColumn(name, (h32(f"{seed}:fold", id_col) % folds).cast("int"))


def fold_split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test): the two sides of one predicate on the same rank."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def train_complement(df: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """All rows that are not in the test set, for folds that came as a table."""
    return df.join(test.select(*keys), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; must be empty before anything is ranked."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> None:
    clash = duplicate_keys(df, keys).limit(1).collect()
    if clash:
        raise ValueError(f"{keys} is not unique: {clash[0].asDict()}")
