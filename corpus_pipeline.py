"""From raw documents to packed training windows, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
is written and read again before the next one. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.decontaminate import with_leaks
from surveyloom.llm.langid import UNKNOWN, fit, identify, training_rows
from surveyloom.llm.neardup import one_of_each
from surveyloom.llm.packing import pack_documents
from surveyloom.llm.quality import keep_fluent
from surveyloom.llm.support import table
from surveyloom.sources.scratch import materialise

MOST_NOISE = 0.5  # share of words that no language explains


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: no null texts, none without letters, not mostly noise."""
    judged = identify(docs, fit(training_rows(docs)))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("noise") <= MOST_NOISE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no less fluent than trusted ones of their language."""
    return keep_fluent(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 in five-word shingles."""
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # learnt models and iterative packing; tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
