"""From a cleaned survey to labelled training rows and held-back candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.config import SurveyConfig
from surveyloom.operators import information, ranks
from surveyloom.operators.candidates import generate_candidates
from surveyloom.operators.clean import candidate_features, project_columns, semi_join_ids
from surveyloom.operators.labels import code_label_join, label_map, reverse_label_map
from surveyloom.operators.tokens import with_text
from surveyloom.sources.scratch import materialise

CANDIDATE_KEY = "draw_no"
REAL = -1


@dataclass(frozen=True)
class TrainingSet:
    """``training`` has real (labels 1) and sampled (labels 0) rows, ``remaining`` the rest."""

    training: DataFrame
    remaining: DataFrame
    features: list[str]


def rank_features(clean: DataFrame, config: SurveyConfig) -> DataFrame:
    """(feature, mi_sum) of all admissible features; independent of how many are kept."""
    features = candidate_features(clean, config.targets, config.excluded_features())
    return information.mi_sum(information.mutual_information(clean, features, config.targets))


def select_features(clean: DataFrame, config: SurveyConfig, k: int) -> DataFrame:
    return information.top_k_features(rank_features(clean, config), k)


def number_dataset(clean: DataFrame, config: SurveyConfig, features: list[str]) -> DataFrame:
    return project_columns(clean, [config.id_col, *features, *config.targets])


def text_dataset(
    text: DataFrame, clean: DataFrame, config: SurveyConfig, features: list[str]
) -> DataFrame:
    """Spelled-out rows of the respondents that survived cleaning."""
    wanted = project_columns(text, [config.id_col, *features, *config.targets])
    return semi_join_ids(wanted, clean, config.id_col)


def labelled_union(real: DataFrame, sampled: DataFrame) -> DataFrame:
    """Real rows as 1 and sampled candidates as 0, matched by column name.

    Real rows get draw number -1, which keeps (id, draw_no) a key of the union.
    """
    ones = real.withColumn(CANDIDATE_KEY, F.lit(REAL).cast("bigint"))
    return ones.withColumn("labels", F.lit(1)).unionByName(sampled.withColumn("labels", F.lit(0)))


def build_training_set(
    real: DataFrame,
    candidates: DataFrame,
    config: SurveyConfig,
    dictionary: dict[str, str],
    features: list[str],
    train_candidates: int = fv.DEFAULT_TRAIN_CANDIDATES,
) -> TrainingSet:
    """Label, sample, unite and write out as text.

    The shuffled order is kept as a key-derived rank that folds are cut from, so
    nothing is physically reordered here. Pass ``candidates`` as a written table:
    it is read for the sample's cut, the training rows and the remainder.
    """
    keys = [config.id_col, CANDIDATE_KEY]
    marked = ranks.mark_sample(candidates, train_candidates, keys, config.seed, "_sampled")
    sampled = marked.where("_sampled").drop("_sampled")
    remaining = marked.where(~F.col("_sampled")).drop("_sampled")

    def spelled(df: DataFrame) -> DataFrame:
        return with_text(
            df, config.targets, dictionary, config.id_col,
            columns=[config.id_col, *features, *config.targets],
            prompt_prefix=config.prompt_prefix, suffix_prefix=config.suffix_prefix,
        )

    training = spelled(labelled_union(real, sampled)).dropna(subset=["text"])
    return TrainingSet(training, spelled(remaining), features)


def training_set(
    clean: DataFrame,
    text: DataFrame,
    config: SurveyConfig,
    dictionary: dict[str, str],
    k: int = fv.DEFAULT_FEATURE_COUNT,
    num: int = fv.DEFAULT_CANDIDATES,
    train_candidates: int = fv.DEFAULT_TRAIN_CANDIDATES,
    spread: int | None = None,
) -> TrainingSet:
    """All steps from the cleaned and the spelled-out table."""
    features = information.feature_names(select_features(clean, config, k))
    real = text_dataset(text, clean, config, features)
    candidates = materialise(
        generate_candidates(
            real, config.targets, config.labels, num, config.id_col, "text", config.seed, spread
        ),
        "candidates",
    )
    return build_training_set(real, candidates, config, dictionary, features, train_candidates)


def assign_folds(
    training: DataFrame, folds: int, config: SurveyConfig, fold_by: str = "id"
) -> DataFrame:
    """Add ``fold``: by source respondent (no leakage) or by shuffled row (equal blocks)."""
    if fold_by == "id":
        return ranks.fold_by_source(training, folds, config.id_col, config.seed)
    if fold_by == "row":
        return ranks.kfold_assign(training, folds, [config.id_col, CANDIDATE_KEY], config.seed)
    raise ValueError(f"unknown fold_by {fold_by!r}")


def build_label_maps(
    num: DataFrame, text: DataFrame, config: SurveyConfig, include_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(code -> label, label -> code) of the targets, from the two survey tables."""
    cells = code_label_join(num, text, config.targets, config.id_col)
    labels = label_map(cells, config.id_col, include_missing)
    return labels, reverse_label_map(labels)
