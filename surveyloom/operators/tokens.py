"""Texts, token lists and batches as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions.arrays import closed_tokens, left_padded, ones_like, supervised_pair
from surveyloom.functions.hashing import int_div
from surveyloom.functions.text import compile_prompt, compile_suffix, json_to_ids, words
from surveyloom.operators.ranks import hash_rank


def with_text(
    df: DataFrame,
    targets: list[str],
    dictionary: dict[str, str],
    id_col: str = fv.ID_COLUMN,
    columns: list[str] | None = None,
    prompt_prefix: str = fv.PROMPT_PREFIX,
    suffix_prefix: str = fv.SUFFIX_PREFIX,
) -> DataFrame:
    """Add ``text``: the sentence for the features followed by that for the targets."""
    body = compile_prompt(columns or df.columns, dictionary, [id_col, *targets], prompt_prefix)
    return df.withColumn("text", F.concat(body, compile_suffix(targets, dictionary, suffix_prefix)))


def typed_label(label: Column, task_type: str) -> Column:
    return label.cast("int" if task_type == "class" else "double")


def token_arrays(
    df: DataFrame,
    text_col: str,
    end_token: str,
    label_col: str | None = None,
    task_type: str = "class",
    cutoff: int | None = None,
) -> DataFrame:
    """Add ``input_ids`` (word tokens of the whole text), ``attention_mask`` and, if given, ``labels``.

    ``cutoff`` keeps the first tokens only, for models with a fixed window.
    """
    tokens = df.withColumn("input_ids", closed_tokens(words(F.col(text_col)), end_token, cutoff))
    tokens = tokens.withColumn("attention_mask", ones_like(F.col("input_ids")))
    if label_col is None:
        return tokens
    return tokens.withColumn("labels", typed_label(F.col(label_col), task_type))


def numeric_arrays(
    df: DataFrame, text_col: str, label_col: str, task_type: str = "class"
) -> DataFrame:
    """The same record from a JSON list of numbers."""
    ids = df.withColumn("input_ids", json_to_ids(F.col(text_col)))
    return ids.withColumn("attention_mask", ones_like(F.col("input_ids"))).withColumn(
        "labels", typed_label(F.col(label_col), task_type)
    )


def supervised_records(
    df: DataFrame,
    prompt_col: str,
    answer_col: str,
    end_token: str,
    ignored: str = str(fv.LOSS_IGNORED),
    cutoff: int | None = None,
    add_end: bool = True,
    train_on_inputs: bool = False,
) -> DataFrame:
    """Add ids, loss-masked labels and mask for a prompt with its answer."""
    ids, labels, mask = supervised_pair(
        words(F.col(prompt_col)), words(F.col(answer_col)), end_token, ignored, cutoff, add_end,
        train_on_inputs,
    )
    return df.withColumns({"input_ids": ids, "labels": labels, "attention_mask": mask})


def pad_batches(
    df: DataFrame, ids_col: str, keys: list[str], batch_size: int, seed: str, padding="0"
) -> DataFrame:
    """Shuffle into batches and left-pad each list to the longest of its batch.

    Batches and their lengths are found on keys and list sizes alone; the lists
    themselves move once, to meet them.
    """
    sizes = df.select(*keys, F.size(ids_col).alias("_size"))
    batch = int_div(F.col("_rank"), F.lit(batch_size).cast("bigint"))
    longest = F.max("_size").over(Window.partitionBy("batch_no"))
    places = (
        hash_rank(sizes, keys, f"{seed}:batch", "_rank")
        .withColumn("batch_no", batch)
        .withColumn("_longest", longest)
        .select(*keys, "batch_no", "_longest")
    )
    return (
        df.join(places, keys)
        .withColumn("_gap", F.col("_longest") - F.size(ids_col))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(0), F.col("_gap")), ones_like(F.col(ids_col))),
        )
        .withColumn(ids_col, left_padded(F.col(ids_col), F.col("_longest"), padding))
        .drop("_longest", "_gap")
    )


def length_histogram(df: DataFrame, length: Column, bins: int = fv.LENGTH_BINS) -> DataFrame:
    """(bin, bin_start, bin_end, n): equal-width bins, the last one closed.

    Every bin is listed, empty ones too. A single distinct length gets a range of
    one around it.
    """
    # one row per distinct length: the texts behind them are read once
    lengths = (
        df.select(length.cast("double").alias("_length"))
        .where(F.col("_length").isNotNull())
        .groupBy("_length")
        .agg(F.count("*").alias("_rows"))
    )
    ends = lengths.agg(F.struct(F.min("_length").alias("low"), F.max("_length").alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    placed = lengths.select("_length", "_rows", (low - half).alias("_low"), (high + half).alias("_high"))
    number = F.floor(
        (F.col("_length") - F.col("_low")) * F.lit(bins) / (F.col("_high") - F.col("_low"))
    )
    counts = placed.groupBy(F.least(number, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum("_rows").alias("n"), F.first("_low").alias("_low"), F.first("_high").alias("_high")
    )
    # at most `bins` rows from here on
    filled = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"),
        F.first("_low").alias("_low"),
        F.first("_high").alias("_high"),
    ).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_high") - F.col("_low")) / F.lit(bins)
    return filled.where(F.col("_low").isNotNull()).select(
        "bin",
        (F.col("_low") + F.col("bin") * width).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0).cast("bigint")).alias("n"),
    )
