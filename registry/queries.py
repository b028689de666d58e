"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.config import ExperimentConfig, PlausibilityParams
from surveyloom.functions import arrays, cells, text
from surveyloom.functions.hashing import h32
from surveyloom.operators import (
    candidates,
    clean,
    covariance,
    factors,
    gram,
    grid,
    information,
    labels,
    metrics,
    plausibility,
    ranks,
    tokens,
    vocabulary,
)
from surveyloom.plans import tasks as task_plan
from surveyloom.plans import experiment as experiment_plan
from surveyloom.plans import training_set as study
from surveyloom.sources import demo, readers, scratch, writers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

T, FEATURES, LABELS, CONFIG = demo.TARGETS, demo.FEATURES, demo.LABELS, demo.CONFIG
SEED = CONFIG.seed
FOLDS = 5
END = "</s>"
MARKER = ".\n"
WITH_INPUT = "Task:\n{instruction}\n\nContext:\n{input}\n\nAnswer:\n"
WITHOUT_INPUT = "Task:\n{instruction}\n\nAnswer:\n"
LENGTH_LIMITS = [500, 1000, 2000, 4000]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# -- shared inputs -------------------------------------------------------------


def _num(spark: SparkSession, sf: str) -> DataFrame:
    return demo.survey_num(spark, sf)


def _text(spark: SparkSession, sf: str) -> DataFrame:
    return demo.survey_text(spark, sf)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The coded survey as a written table, for queries that read it several times."""
    return scratch.materialise(_num(spark, sf), "survey")


def _answered(num: DataFrame) -> DataFrame:
    """Coded rows with all targets answered."""
    return clean.drop_missing(clean.filter_applicable(clean.codes_to_null(num), T), T)


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return clean.prepare(_num(spark, sf), T)


def _real(num: DataFrame) -> DataFrame:
    """Spelled-out rows with all targets answered."""
    text_rows = clean.project_columns(demo.spelled_out(num), ["id", *FEATURES, *T])
    return clean.semi_join_ids(text_rows, _answered(num))


def _draws(rows: int) -> int:
    return rows + rows // 2


def _candidates(num: DataFrame, mode: str = "text") -> DataFrame:
    source = _real(num) if mode == "text" else _answered(num).select("id", *FEATURES, *T)
    source = scratch.materialise(source, "source")  # counted, cut and expanded
    return candidates.generate_candidates(
        source, T, LABELS, _draws(source.count()), mode=mode, seed=SEED
    )


def _rule_scored(num: DataFrame) -> DataFrame:
    """Candidates with a stand-in prediction that SQL can repeat."""
    guess = F.when(h32("accept", "id", "draw_no") % 3 == 0, 1).otherwise(0)
    return _candidates(num).withColumn("prediction", guess)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their length."""
    return demo.table(spark, sf, "labels").join(
        demo.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _joined(tokens_col: Column) -> Column:
    return F.array_join(tokens_col, " ")


# -- sources and sinks ---------------------------------------------------------


@query
def scan_numeric(spark, sf):
    path = scratch.scratch_path(spark, "num_csv")
    table = _num(spark, sf)
    writers.write_csv(table, path)
    return readers.read_survey_csv(spark, path, table.columns)


@query
def scan_text(spark, sf):
    path = scratch.scratch_path(spark, "text_csv")
    writers.write_csv(_text(spark, sf), path)
    return readers.read_survey_csv(spark, path)


@query
def variable_dictionary(spark, sf):
    named = demo.table(spark, sf, "part").select(
        F.col("p_brand").alias("name"), F.col("p_name").alias("simplab"), "p_partkey"
    )
    return labels.variable_dictionary(named, "p_partkey")


@query
def code_map_scan(spark, sf):
    path = scratch.scratch_path(spark, "label_map")
    num = _stored(spark, sf)
    built, _ = study.build_label_maps(num, demo.spelled_out(num), CONFIG)
    writers.write_code_map(built, path)
    return readers.read_code_map(spark, path)


@query
def split_read(spark, sf):
    path = scratch.scratch_path(spark, "splits")
    folded = ranks.kfold_assign(_answered(_stored(spark, sf)).select("id", *T), FOLDS, ["id"], SEED)
    split = F.when(F.col("fold") == 0, "test").otherwise("train")
    writers.write_table(folded.withColumn("split", split), path, ["split"])
    parts = [
        part.select(F.lit(name).alias("split"), "id", "fold")
        for name, part in readers.read_splits(spark, path).items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def candidate_scan(spark, sf):
    path = scratch.scratch_path(spark, "candidates")
    writers.write_run(_candidates(_stored(spark, sf), "num"), path, "f4-0")
    return readers.read_candidates(spark, path, "f4-0").select("id", "draw_no", *T)


@query
def sink_roundtrip(spark, sf):
    path = scratch.scratch_path(spark, "number_dataset")
    numbers = study.number_dataset(_prepared(spark, sf), CONFIG, FEATURES)
    writers.write_run(numbers, path, "f4-0", "full")
    writers.write_run(numbers, path, "f4-0", "full")  # repeating a run replaces it
    return readers.read_table(spark, path).select("run_id", "split", "id", *FEATURES, *T)


@query
def code_map_json(spark, sf):
    num = _stored(spark, sf)
    built, _ = study.build_label_maps(num, demo.spelled_out(num), CONFIG)
    return labels.code_map_json(built)


@query
def code_map_lines(spark, sf):
    """The label map written as a JSON line per feature, and read back."""
    path = scratch.scratch_path(spark, "label_map_lines")
    num = _stored(spark, sf)
    built, _ = study.build_label_maps(num, demo.spelled_out(num), CONFIG)
    writers.write_code_map_lines(built, path)
    return readers.read_code_map_lines(spark, path)


def _length_rule(judged: DataFrame, limit: int) -> DataFrame:
    return judged.withColumn("prediction", (F.col("n_chars") >= limit).cast("int"))


def _ledger(spark, sf) -> DataFrame:
    """One line per rule, appended one after the other, read back."""
    path = scratch.scratch_path(spark, "ledger")
    judged = _judged(spark, sf)
    for grid_no, limit in enumerate(LENGTH_LIMITS):
        line = metrics.binary_metrics(_length_rule(judged, limit), "quality", "prediction")
        writers.append_rows(
            line.select(
                F.lit(grid_no).alias("grid_no"), F.lit(limit).alias("length_limit"), "accuracy", "f1"
            ),
            path,
        )
    return _rounded(readers.read_table(spark, path), ["accuracy", "f1"])


@query
def result_ledger(spark, sf):
    return _ledger(spark, sf)


# -- projection, filter, cleaning ------------------------------------------------


@query
def project_columns(spark, sf):
    return clean.project_columns(_prepared(spark, sf), ["id", "nation", "yr", *T])


@query
def drop_columns(spark, sf):
    return clean.drop_columns(_prepared(spark, sf), [*T, "wt", "pricegrp"])


@query
def feature_stoplist(spark, sf):
    nulled = clean.codes_to_null(_num(spark, sf))
    kept = clean.candidate_features(nulled, T, CONFIG.excluded_features())
    return clean.null_profile(nulled.select(*kept))


@query
def filter_applicable(spark, sf):
    return clean.filter_applicable(_num(spark, sf), T)


@query
def dropna_targets(spark, sf):
    return clean.drop_missing(clean.codes_to_null(_num(spark, sf)), T)


@query
def codes_to_null(spark, sf):
    return clean.codes_to_null(_num(spark, sf))


@query
def fill_sentinel(spark, sf):
    return clean.fill_sentinel(clean.codes_to_null(_num(spark, sf)))


@query
def to_numeric(spark, sf):
    return clean.numeric_cells(_num(spark, sf))


@query
def is_code(spark, sf):
    return _num(spark, sf).select("id", *[cells.is_code(F.col(v)).alias(v) for v in demo.VARIABLES])


@query
def accepted_rows(spark, sf):
    return covariance.accepted_rows(_rule_scored(_stored(spark, sf))).select("id", "draw_no", *T)


@query
def value_remap(spark, sf):
    codes = _prepared(spark, sf)
    changed = cells.remap(F.col("balbin").cast("int"), fv.RELEVANCE_MAP)
    return codes.select("id", F.col("balbin").cast("int").alias("code"), changed.alias("remapped"))


@query
def fold_split(spark, sf):
    folded = ranks.kfold_assign(_answered(_stored(spark, sf)).select("id"), FOLDS, ["id"], SEED)
    train, test = ranks.fold_split(folded, FOLDS - 1)
    return train.withColumn("split", F.lit("train")).unionAll(
        test.withColumn("split", F.lit("test"))
    )


@query
def encode_targets(spark, sf):
    encoded = covariance.encode_targets(_rule_scored(_stored(spark, sf)), T, LABELS)
    return encoded.select("id", "draw_no", *[f"{t}_num" for t in T])


# -- joins -----------------------------------------------------------------------


@query
def semi_join_ids(spark, sf):
    num = _stored(spark, sf)
    return clean.semi_join_ids(demo.spelled_out(num), clean.prepare(num, T))


@query
def holdout_anti_join(spark, sf):
    num = _stored(spark, sf)
    drawn = scratch.materialise(_candidates(num), "candidates")
    n = _answered(num).count() // 2
    return ranks.holdout(drawn, n, ["id", "draw_no"], SEED).select("id", "draw_no", *T)


@query
def train_complement(spark, sf):
    folded = ranks.kfold_assign(_answered(_stored(spark, sf)).select("id"), FOLDS, ["id"], SEED)
    _, test = ranks.fold_split(folded, 0)
    return ranks.train_complement(folded, test, ["id"])


@query
def code_label_join(spark, sf):
    num = _stored(spark, sf)
    return labels.code_label_join(num, demo.spelled_out(num), T)


@query
def label_to_code(spark, sf):
    return labels.label_to_code(_text(spark, sf), T, LABELS).select("id", *T)


@query
def code_to_label(spark, sf):
    return labels.code_to_label(_num(spark, sf), T, LABELS).select("id", *T)


def _fold_sizes(spark, sf) -> DataFrame:
    folded = ranks.fold_by_source(_answered(_stored(spark, sf)).select("id"), FOLDS, "id", SEED)
    return folded.groupBy("fold").agg(F.count("*").alias("test_rows"))


@query
def fold_by_source(spark, sf):
    return ranks.fold_by_source(_answered(_stored(spark, sf)).select("id"), FOLDS, "id", SEED)


@query
def param_grid(spark, sf):
    return grid.param_grid(
        _fold_sizes(spark, sf),
        {"cutoff_len": fv.TRAINING_DEFAULTS["cutoff_len"]},
        feature_count=fv.FEATURE_COUNTS,
        num_epochs=fv.GRID_EPOCHS,
        learning_rate=fv.GRID_LEARNING_RATES,
    )


@query
def expand_draws(spark, sf):
    source = _answered(_stored(spark, sf)).select("id")
    quotas = ranks.assign_quota(source, _draws(source.count()), ["id"], SEED)
    return candidates.expand_draws(quotas, ["id"])


# -- aggregations ------------------------------------------------------------------


@query
def contingency(spark, sf):
    return information.contingency(_prepared(spark, sf), FEATURES, T)


def _mi(spark, sf) -> DataFrame:
    return information.mutual_information(_prepared(spark, sf), FEATURES, T)


@query
def mutual_information(spark, sf):
    return _rounded(_mi(spark, sf), ["mi"])


@query
def mi_sum(spark, sf):
    wide = information.mi_table(_mi(spark, sf), T)
    return _rounded(wide, [*T, "mi_sum"])


@query
def missing_code_counts(spark, sf):
    return clean.missing_code_counts(_num(spark, sf))


@query
def null_profile(spark, sf):
    return clean.null_profile(clean.codes_to_null(_num(spark, sf)))


@query
def split_counts(spark, sf):
    folded = ranks.kfold_assign(_answered(_stored(spark, sf)).select("id"), FOLDS, ["id"], SEED)
    return folded.groupBy("fold").agg(F.count("*").alias("rows"))


def _label_map(spark, sf) -> DataFrame:
    num = _stored(spark, sf)
    cells_ = labels.code_label_join(num, demo.spelled_out(num), T)
    return labels.label_map(cells_)


@query
def feature_domains(spark, sf):
    return labels.feature_domains(_label_map(spark, sf)).withColumn(
        "domain", F.array_join(F.col("domain").cast("array<string>"), ",")
    )


@query
def label_map(spark, sf):
    return _label_map(spark, sf)


@query
def reverse_label_map(spark, sf):
    """With the missing codes, where several codes may share a label."""
    num = _stored(spark, sf)
    cells_ = labels.code_label_join(num, demo.spelled_out(num), T)
    shared = cells_.withColumn(
        "label", F.when(F.startswith("code", F.lit(".")), "no valid answer").otherwise(F.col("label"))
    )
    return labels.reverse_label_map(labels.label_map(shared, include_missing=True))


@query
def covariance_matrix(spark, sf):
    return _rounded(covariance.covariance_matrix(_prepared(spark, sf), T), ["cov"], 4)


ANSWERS = [(t, code) for t in T for code in LABELS[t]] + [("mon", m) for m in range(1, 13)] + [("nation", n) for n in range(25)]


@query
def covariance_of_answers(spark, sf):
    """All pairs of answers, a 0/1 column each: 81 columns, 6,561 cells."""
    names = [f"{variable}={code}" for variable, code in ANSWERS]
    marks = [(F.col(v) == F.lit(float(code))).cast("int").alias(n) for (v, code), n in zip(ANSWERS, names)]
    return _rounded(gram.gram_covariance(_prepared(spark, sf).select(*marks), names), ["cov"])


@query
def covariance_continuous(spark, sf):
    lines = demo.table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _rounded(covariance.covariance_matrix(lines, columns), ["cov"], 4)


def _report(spark, sf) -> DataFrame:
    num = _stored(spark, sf)
    scored = scratch.materialise(_rule_scored(num).select(*T, "prediction"), "scored")
    return covariance.covariance_report(clean.prepare(num, T), scored, T, LABELS)


@query
def covariance_diff(spark, sf):
    return _rounded(_report(spark, sf).select("row", "col", "diff"), ["diff"], 4)


@query
def covariance_frobenius(spark, sf):
    norm = covariance.frobenius_norm(_report(spark, sf))
    return _rounded(norm, ["frobenius_norm"], 4)


@query
def binary_metrics(spark, sf):
    judged = _length_rule(_judged(spark, sf), 1000)
    result = metrics.binary_metrics(judged, "quality", "prediction")
    return _rounded(result, result.columns)


def _estimated(spark, sf) -> DataFrame:
    """Labelled documents with a real-valued guess that often lies at a half."""
    return _judged(spark, sf).withColumn("guess", F.floor(F.col("n_chars") / 500) / 4)


@query
def rmse(spark, sf):
    return _rounded(metrics.rmse(_estimated(spark, sf), "quality", "guess"), ["rmse"])


@query
def rmse_rounded(spark, sf):
    result = metrics.rmse_rounded(_estimated(spark, sf), "quality", "guess")
    return _rounded(result, result.columns)


@query
def rmse_label_precision(spark, sf):
    result = metrics.rmse_label_precision(_estimated(spark, sf), "quality", "guess")
    return _rounded(result, result.columns)


@query
def relevance_metrics(spark, sf):
    coded = _judged(spark, sf).select(
        F.when(F.col("toxic") == 1, -9).otherwise(F.col("quality") - 1).alias("truth"),
        F.when(F.col("n_chars") % 7 == 0, -9)
        .otherwise((F.col("n_chars") % 4 - 2).cast("int"))
        .alias("guess"),
    )
    result = metrics.relevance_metrics(coded, "truth", "guess")
    return _rounded(result, result.columns)


@query
def token_length_histogram(spark, sf):
    records = tokens.token_arrays(demo.table(spark, sf, "documents"), "text", END)
    return _rounded(tokens.length_histogram(records, F.size("input_ids")), ["bin_start", "bin_end"])


@query
def best_config(spark, sf):
    return metrics.best_config(_ledger(spark, sf), ["length_limit"])


# -- rank, sampling, shuffling, draws -------------------------------------------------


@query
def assign_quota(spark, sf):
    source = _answered(_stored(spark, sf)).select("id")
    return ranks.assign_quota(source, 2 * source.count() + 7, ["id"], SEED)


@query
def exact_sample(spark, sf):
    source = _answered(_stored(spark, sf)).select("id", *T)
    return ranks.exact_sample(source, source.count() // 3, ["id"], SEED)


@query
def shuffle_index(spark, sf):
    return ranks.shuffle_index(_answered(_stored(spark, sf)).select("id", *T), ["id"], SEED)


@query
def kfold_assign(spark, sf):
    return ranks.kfold_assign(_answered(_stored(spark, sf)).select("id"), FOLDS, ["id"], SEED)


@query
def draw_alternative(spark, sf):
    """One draw per respondent, on codes."""
    return candidates.redraw_targets(
        _answered(_num(spark, sf)).select("id", *T), T, LABELS, ["id"], "num", SEED
    )


@query
def generate_candidates(spark, sf):
    return _candidates(_stored(spark, sf))


# -- sort, set operations ---------------------------------------------------------------


@query
def top_k_features(spark, sf):
    return _rounded(information.top_k_features(information.mi_sum(_mi(spark, sf)), 3), ["mi_sum"])


@query
def labelled_union(spark, sf):
    num = _stored(spark, sf)
    drawn = scratch.materialise(_candidates(num), "candidates")
    real = _real(num)
    sampled = ranks.exact_sample(drawn, real.count() // 2, ["id", "draw_no"], SEED)
    return study.labelled_union(real, sampled)


# -- text, JSON, arrays -------------------------------------------------------------------


@query
def compile_prompt(spark, sf):
    table = _text(spark, sf)
    prompt = text.compile_prompt(table.columns, demo.DICTIONARY, ["id", *T])
    return table.select("id", prompt.alias("prompt"))


@query
def compile_suffix(spark, sf):
    return _text(spark, sf).select("id", text.compile_suffix(T, demo.DICTIONARY).alias("suffix"))


@query
def compile_text(spark, sf):
    return tokens.with_text(_text(spark, sf), T, demo.DICTIONARY).select("id", "text")


@query
def row_to_json(spark, sf):
    return _text(spark, sf).select("id", text.row_to_json([*FEATURES, *T]).alias("json"))


@query
def json_to_ids(spark, sf):
    listed = demo.table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit("["), F.get_json_object("props", "$.k"), F.lit(", "),
            F.col("user_id").cast("string"), F.lit("]"),
        ).alias("text"),
        "value",
    )
    records = tokens.numeric_arrays(listed, "text", "value", "continuous")
    return records.select(
        "event_id",
        _joined(F.col("input_ids").cast("array<string>")).alias("input_ids"),
        _joined(F.col("attention_mask").cast("array<string>")).alias("attention_mask"),
        "labels",
    )


def _turns(spark, sf) -> DataFrame:
    """Each user turn with the turn before and the answer after it, if any."""
    turns = demo.table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    after = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    key = ["conv_id", "turn"]
    return asked.join(before, key, "left").join(after, key, "left")


@query
def fill_template(spark, sf):
    filled = text.fill_template(
        WITH_INPUT, WITHOUT_INPUT, F.col("text"), F.col("context"), F.col("answer")
    )
    return _turns(spark, sf).select("conv_id", "turn", filled.alias("prompt"))


@query
def extract_response(spark, sf):
    documents = demo.table(spark, sf, "documents")
    return documents.select("doc_id", text.extract_response(F.col("text"), MARKER).alias("response"))


@query
def token_arrays(spark, sf):
    documents = demo.table(spark, sf, "documents").withColumn("label", F.col("n_chars") % 2)
    records = tokens.token_arrays(documents, "text", END, "label")
    return records.select(
        "doc_id",
        _joined(F.col("input_ids")).alias("input_ids"),
        F.size("attention_mask").alias("mask_length"),
        "labels",
    )


@query
def loss_mask(spark, sf):
    answered = _turns(spark, sf).where(F.col("answer").isNotNull())
    records = tokens.supervised_records(answered, "text", "answer", END)
    return records.select(
        "conv_id",
        "turn",
        _joined(F.col("input_ids")).alias("input_ids"),
        _joined(F.col("labels")).alias("labels"),
        F.size("attention_mask").alias("mask_length"),
    )


@query
def pad_batches(spark, sf):
    records = tokens.token_arrays(
        demo.table(spark, sf, "documents").select("doc_id", "text"), "text", END
    ).drop("text")
    padded = tokens.pad_batches(records, "input_ids", ["doc_id"], 32, SEED)
    return padded.select(
        "doc_id",
        "batch_no",
        F.size("input_ids").alias("length"),
        F.array_size(F.filter("attention_mask", lambda m: m == 0)).alias("padding"),
        F.md5(_joined(F.col("input_ids")).cast("binary")).alias("ids_md5"),
    )


@query
def argmax_scores(spark, sf):
    return demo.table(spark, sf, "embeddings").select(
        "vec_id", arrays.argmax(F.col("embedding")).alias("prediction")
    )


@query
def covariance_clamped(spark, sf):
    return _rounded(
        covariance.clamped(covariance.covariance_matrix(_prepared(spark, sf), T)), ["cov"], 4
    )


# -- learning and scoring -----------------------------------------------------------------

PARAMS = PlausibilityParams(num_epochs=2)
TRIALS = 4
SEARCHED_EPOCHS = (1, 4)


def _vectors(spark, sf, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """(labelled rows with fold and vector, held-back candidates with vector)."""
    real = _spelled(spark, sf)
    n = real.count()
    drawn = scratch.materialise(
        candidates.generate_candidates(real, T, LABELS, _draws(n), seed=SEED), "candidates"
    )
    built = study.build_training_set(real, drawn, CONFIG, demo.DICTIONARY, FEATURES, n // 2)
    folded = study.assign_folds(built.training, folds, CONFIG)
    vectors = plausibility.with_vectors(folded, FEATURES, T, PARAMS)
    return (
        scratch.materialise(vectors.select("id", "draw_no", "labels", "fold", "features"), "vectors"),
        plausibility.with_vectors(built.remaining, FEATURES, T, PARAMS),
    )


def _beats_majority(result: DataFrame) -> DataFrame:
    """What SQL can state of held-out folds, and whether the model did better than the larger class."""
    better = (F.col("accuracy") > F.col("majority_rate")).alias("beats_majority")
    return _rounded(result.select("fold", "test_rows", "positives", "majority_rate", better), ["majority_rate"])


def _sound(scored: DataFrame) -> Column:
    return F.col("plausibility").between(0, 1) & F.col("prediction").isin(0, 1)


@query
def train_plausibility(spark, sf):
    vectors, _ = _vectors(spark, sf)
    scored = plausibility.score(plausibility.train_plausibility(vectors, PARAMS), vectors)
    right = F.avg((F.col("prediction") == F.col("labels")).cast("int"))
    return scored.groupBy("labels").agg(F.count("*").alias("rows"), (right > 0.5).alias("mostly_right"))


@query
def evaluate_fold(spark, sf):
    vectors, _ = _vectors(spark, sf)
    train, test = ranks.fold_split(vectors, 0)
    scored, _ = plausibility.evaluate(plausibility.train_plausibility(train, PARAMS), test)
    return _beats_majority(plausibility.fold_metrics(scored, by=["fold"]))


@query
def score_candidates(spark, sf):
    vectors, remaining = _vectors(spark, sf)
    train, _ = ranks.fold_split(vectors, 0)
    scored = plausibility.score(plausibility.train_plausibility(train, PARAMS), remaining)
    return scored.select("id", "draw_no", *T, _sound(scored).alias("sound"))


@query
def score_saved_model(spark, sf):
    """The same rows, scored by a model that was written and read again."""
    vectors, remaining = _vectors(spark, sf)
    out = scratch.scratch_path(spark, "saved")
    model = plausibility.train_plausibility(ranks.fold_split(vectors, 0)[0], PARAMS)
    plausibility.save_model(model, writers.run_path(f"{out}/models", "f4-0-0"))
    rows = remaining.drop("features")
    scored = experiment_plan.score_saved_model(spark, out, "f4-0-0", rows, FEATURES, CONFIG, PARAMS)
    return scored.select("id", "draw_no", *T, _sound(scored).alias("sound"))


@query
def cross_validate(spark, sf):
    vectors, _ = _vectors(spark, sf, 3)
    return _beats_majority(plausibility.cross_validate(vectors, PARAMS, [0, 1, 2]))


@query
def search_best(spark, sf):
    """The drawn settings of every trial, tried on all folds."""
    vectors, _ = _vectors(spark, sf, 2)
    trials = plausibility.drawn_trials(spark, PARAMS, TRIALS, SEED, SEARCHED_EPOCHS)
    _, table = plausibility.search_best(vectors, trials, [0, 1], parallel=2)
    better = (F.col("accuracy") > F.col("majority_rate")).alias("beats_majority")
    return table.select("trial", "num_epochs", "weight_decay", better)


FACTORS = factors.FactorParams(num_epochs=4, batch_size=16, warmup_steps=4)


def _spelled(spark, sf) -> DataFrame:
    return scratch.materialise(_real(_stored(spark, sf)), "real")


@query
def token_vocabulary(spark, sf):
    """All `column=value` tokens of the answered rows, counted and numbered."""
    return vocabulary.token_vocabulary(_spelled(spark, sf), plausibility.value_tokens([*FEATURES, *T]), SEED)


@query
def token_numbers(spark, sf):
    rows = _spelled(spark, sf)
    tokens_of = plausibility.value_tokens([*FEATURES, *T])
    words = scratch.materialise(vocabulary.token_vocabulary(rows, tokens_of, SEED), "vocabulary")
    numbers = vocabulary.token_numbers(rows, tokens_of, words, ["id"])
    return numbers.select("id", _joined(F.col("numbers").cast("array<string>")).alias("numbers"))


@query
def exact_vectors(spark, sf):
    """Tokens and crosses as sparse vectors with a place of its own for each."""
    rows = _spelled(spark, sf)
    tokens_of = plausibility.crossed_tokens(plausibility.value_tokens([*FEATURES, *T]), len(FEATURES), len(T))
    words = scratch.materialise(vocabulary.token_vocabulary(rows, tokens_of, SEED), "vocabulary")
    vectors = vocabulary.with_exact_vectors(rows.select("id", *FEATURES, *T), tokens_of, words, ["id"])
    written = F.regexp_extract(F.col("features").cast("string"), r"\[([^\]]*)\]", 1)
    return vectors.select("id", F.regexp_extract(F.col("features").cast("string"), r"^\((\d+),", 1).cast("bigint").alias("size"), written.alias("places"))


def _numbered(spark, sf, folds: int) -> tuple[DataFrame, int]:
    """(labelled rows with fold and token numbers, size of the vocabulary)."""
    real = _spelled(spark, sf)
    n = real.count()
    drawn = scratch.materialise(candidates.generate_candidates(real, T, LABELS, _draws(n), seed=SEED), "candidates")
    built = study.build_training_set(real, drawn, CONFIG, demo.DICTIONARY, FEATURES, n // 2)
    rows = scratch.materialise(study.assign_folds(built.training, folds, CONFIG), "rows")
    keys, tokens_of = ["id", "draw_no"], plausibility.value_tokens([*FEATURES, *T])
    words = scratch.materialise(vocabulary.token_vocabulary(rows, tokens_of, SEED), "vocabulary")
    numbers = vocabulary.token_numbers(rows, tokens_of, words, keys)
    return scratch.materialise(rows.select(*keys, "labels", "fold").join(numbers, keys), "numbered"), words.count()


@query
def factor_cross_validate(spark, sf):
    """Factorisation machines on all folds, trained side by side."""
    rows, size = _numbered(spark, sf, 3)
    result = factors.cross_validate_factors(rows, ["id", "draw_no"], size, [FACTORS], [0, 1, 2])
    positives = rows.groupBy("fold").agg(F.sum("labels").cast("bigint").alias("positives"))
    return _beats_majority(result.join(positives, "fold"))


@query
def factor_search(spark, sf):
    """The whole search space: epochs, decay, rate, warm-up and batch size of every trial, on all folds."""
    rows, size = _numbered(spark, sf, 2)
    one_search = spark.range(1).withColumnRenamed("id", "search")
    drawn = scratch.materialise(grid.param_draws(one_search, 8, SEED, ["search"]).drop("search"), "trials")
    settings = factors.drawn_settings(drawn, FACTORS)
    _, means = factors.search_factors(rows, ["id", "draw_no"], size, settings, [0, 1])
    # slow rates learn little from few rows; what must hold is that the setting the search finds is a good one
    best = means.agg(F.max_by(F.col("accuracy") > F.col("majority_rate"), "accuracy")).scalar()
    return drawn.join(means.select(F.col("setting").alias("trial")), "trial").select(
        *drawn.columns, best.alias("best_beats_majority")
    )


@query
def task_models(spark, sf):
    """A class, a continuous and an ordered target, each by the model and the metrics of its described task."""
    num = _answered(_num(spark, sf)).select("id", *FEATURES, *T)
    rows = num.withColumn("west", (F.col("region") <= 2).cast("int"))
    for name in ("region", "seg"):
        rows = rows.withColumn(name, F.col(name).cast("int") - 1)
    rows = scratch.materialise(rows.withColumn("price", F.col("region") * 1.5), "rows")
    folded = scratch.materialise(ranks.fold_by_source(rows, 2, "id", SEED), "folded")
    described = {
        "west": {"task_type": "class", "num_labels": 2}, "price": {"task_type": "continuous", "num_labels": 1},
        "region": {"task_type": "sequence", "num_labels": 5}, "seg": {"task_type": "class", "num_labels": 5},
    }
    path = scratch.scratch_path(spark, "tasks")
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(path)
    tasks = readers.read_tasks(spark, path)
    result = task_plan.run_tasks(folded, tasks, FEATURES, ["id"], FACTORS, [0, 1])
    below = F.col("metric").isin("accuracy", "rmse") & F.when(F.col("feature") == "seg", F.col("value") > 0.1).when(
        F.col("task_type") == "class", F.col("value") > 0.9
    ).otherwise(F.col("value") < F.col("spread"))
    sound = F.when(F.col("metric").isin("accuracy", "rmse"), below).otherwise(F.col("value") >= 0)
    return result.select("feature", "task_type", "fold", "test_rows", "metric", sound.alias("sound"))


@query
def param_draws(spark, sf):
    return grid.param_draws(_fold_sizes(spark, sf), 8, SEED, ["fold"])


@query
def score_with_user_model(spark, sf):
    """A caller's batch scorer: here the share of long answers in a document."""
    judged = _judged(spark, sf).select("doc_id", "n_chars", "quality")
    scored = plausibility.score_with(judged, lambda b: (b["n_chars"] >= 1000).astype("int32"), dtype="int")
    return scored


@query
def metrics_by_task(spark, sf):
    estimated = _length_rule(_estimated(spark, sf), 1000)
    parts = None
    for task_type, guess in [("class", "prediction"), ("continuous", "guess")]:
        result = metrics.metrics_for(estimated, "quality", guess, task_type)
        long = result.unpivot([], result.columns, "metric", "value").withColumn(
            "task_type", F.lit(task_type)
        )
        parts = long if parts is None else parts.unionByName(long)
    return _rounded(parts, ["value"])


# -- whole plans ----------------------------------------------------------------------------


@query
def prepare_numeric(spark, sf):
    return _prepared(spark, sf)


@query
def select_features(spark, sf):
    return _rounded(study.select_features(_prepared(spark, sf), CONFIG, 3), ["mi_sum"])


def _training_set(spark, sf) -> study.TrainingSet:
    num = _stored(spark, sf)
    prepared = scratch.materialise(clean.prepare(num, T), "clean")
    rows = prepared.count()
    return study.training_set(
        prepared, demo.spelled_out(num), CONFIG, demo.DICTIONARY, len(FEATURES), _draws(rows), rows // 2
    )


@query
def training_set(spark, sf):
    return _training_set(spark, sf).training.select("id", "labels", "text")


@query
def remaining_candidates(spark, sf):
    return _training_set(spark, sf).remaining.select("id", "text", *T)


@query
def covariance_report(spark, sf):
    return _rounded(_report(spark, sf), ["true_cov", "pred_cov", "diff", "frobenius_norm"], 4)


@query
def label_maps(spark, sf):
    num = _stored(spark, sf)
    forward, reverse = study.build_label_maps(num, demo.spelled_out(num), CONFIG)
    return (
        forward.select("feature", F.col("code").alias("key"), F.col("label").alias("value"))
        .withColumn("map", F.lit("label_map"))
        .unionByName(
            reverse.select("feature", F.col("label").alias("key"), F.col("code").alias("value"))
            .withColumn("map", F.lit("reverse_label_map"))
        )
    )


@query
def encode_by_map(spark, sf):
    """Every spelled-out column turned into codes by the written map of the same columns."""
    num = _stored(spark, sf)
    spelled, columns = demo.spelled_out(num), [*FEATURES, *T]
    cells = labels.code_label_join(num, spelled, columns)
    reverse = scratch.materialise(labels.reverse_label_map(labels.label_map(cells)), "reverse_label_map")
    return labels.encode_by_map(spelled, columns, reverse, ["id"])


@query
def experiment(spark, sf):
    """Every grid point on every fold."""
    num = scratch.materialise(_num(spark, sf), "num")
    rows = _answered(num).count()
    names = spark.createDataFrame(list(demo.DICTIONARY.items()), "name string, simplab string")
    sizes = ExperimentConfig(
        feature_counts=[2, 4], candidates=_draws(rows), train_candidates=rows // 2, folds=3, base=PARAMS,
        parallel_fits=4,
    )
    ledger = experiment_plan.run_experiment(
        spark, num, demo.spelled_out(num), names, scratch.scratch_path(spark, "run"), CONFIG, sizes
    )
    complete = F.lit(True)
    for name in ("accuracy", "f1", "precision", "recall", "accepted", "frobenius_norm", "token_collisions"):
        complete = complete & F.col(name).isNotNull()
    points = ledger.select(
        "feature_count", "grid_no", "num_epochs", "weight_decay", "fold", "test_rows", "majority_rate",
        complete.alias("complete"),
    )
    return _rounded(points, ["majority_rate"])
