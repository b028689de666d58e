"""What several operators share: input columns, gapless numbers, byte totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, none for a null text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(text_bytes(doc_id.cast("string"))) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, amount: int, per_part: int) -> int:
    """As many parts as keep each near `per_part`, and no fewer than a shuffle has."""
    return max(shuffle_width(spark), -(-amount // per_part))


def numbered(
    df: DataFrame, keys: list[str], order: list[str], into: str, blocks: int, first: str | None = None
) -> DataFrame:
    """Gapless numbers from 0 within each key, without gathering a key in one task.

    Rows are dealt into blocks by a hash of `order`; the blocks of a key are
    counted, each block starts where the one before it ended, and only rows of one
    block are sorted together. `order` should tell rows apart. `first`, a small
    whole number, puts rows of lower value before all rows of a higher one.
    """
    block = F.pmod(F.xxhash64(F.lit("block"), *order), F.lit(blocks))
    if first:
        block = F.col(first).cast("bigint") * blocks + block
    dealt = df.withColumn("_block", block)
    place = [*keys, "_block"]
    counts = dealt.groupBy(*place).agg(F.count("*").alias("_rows"))
    if not keys:  # a line per block
        counts = counts.withColumn("_all", F.lit(0))
    before = Window.partitionBy(*(keys or ["_all"])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*place, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*place).orderBy(*order)
    return (
        dealt.join(starts, place)
        .withColumn(into, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_block", "_start")
    )
