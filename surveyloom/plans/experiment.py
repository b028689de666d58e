"""The whole study over a grid of feature counts and classifier settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.config import ExperimentConfig, PlausibilityParams, SurveyConfig
from surveyloom.operators import clean, information, ranks
from surveyloom.operators.candidates import generate_candidates
from surveyloom.operators.covariance import covariance_matrix, covariance_report
from surveyloom.operators.labels import dictionary_of, domain_violations, variable_dictionary
from surveyloom.operators.plausibility import (
    SCORE,
    drawn_trials,
    fold_metrics,
    grid_of,
    load_model,
    of_model,
    save_model,
    score,
    score_by_all,
    search_best,
    side_by_side,
    token_collisions,
    train_plausibility,
    used_places,
    with_vectors,
)
from surveyloom.plans.training_set import (
    assign_folds,
    build_training_set,
    number_dataset,
    rank_features,
    text_dataset,
)
from surveyloom.sources.readers import read_candidates, read_run
from surveyloom.sources.scratch import materialise
from surveyloom.sources.writers import run_name, run_path, write_run

LEDGER_SCHEMA = (
    "feature_count int, grid_no int, num_epochs int, weight_decay double, fold int, test_rows bigint, "
    "accuracy double, f1 double, precision double, recall double, majority_rate double, "
    "accepted bigint, frobenius_norm double, token_collisions double"
)


def _require_legal_targets(real: DataFrame, config: SurveyConfig) -> None:
    bad = domain_violations(real, config.targets, config.labels).where("rows > 0").collect()
    if bad:
        raise ValueError(f"rows outside the legal answers: {[r.asDict() for r in bad]}")


def _write_profile(num: DataFrame, out_dir: str) -> None:
    """What the raw table lacks: missing codes, nulls and cells that are no number."""
    write_run(clean.missing_code_counts(num), f"{out_dir}/missing_codes", "input")
    write_run(clean.null_profile(num), f"{out_dir}/nulls", "input")
    write_run(clean.unparseable_counts(num), f"{out_dir}/unparseable", "input")


def run_experiment(
    spark: SparkSession,
    num: DataFrame,
    text: DataFrame,
    dictionary: DataFrame,
    out_dir: str,
    config: SurveyConfig | None = None,
    sizes: ExperimentConfig | None = None,
    search_trials: int = 0,
    resume: bool = False,
) -> DataFrame:
    """Prepare, generate, train, evaluate, score and compare; returns the ledger.

    What does not depend on the grid point is done once: cleaning, the feature
    ranking, the join with the texts, the candidates, their vectors. Every grid
    point and fold has its own folder in each output table, which a repetition
    replaces, and its own line in the ledger. With ``search_trials`` the grid is
    replaced by the best of that many drawn settings. With ``resume`` points that an
    interrupted run with the same inputs and settings has finished are not run again.
    """
    config, sizes = config or SurveyConfig(), sizes or ExperimentConfig()
    targets, id_col = config.targets, config.id_col
    labels_of_names = dictionary_of(variable_dictionary(dictionary))
    _write_profile(num, out_dir)
    cleaned = materialise(clean.prepare(num, targets, id_col), "clean")
    ranks.require_unique(cleaned, [id_col])
    sums = materialise(rank_features(cleaned, config), "mi")

    # the largest feature set holds every smaller one, and candidates do not depend
    # on the features at all: join and draw once, then read fewer columns
    ranked = information.feature_names(
        information.top_k_features(sums, max(sizes.feature_counts))
    )
    all_real = materialise(text_dataset(text, cleaned, config, ranked), "real")
    _require_legal_targets(all_real, config)
    all_candidates = materialise(
        generate_candidates(
            all_real, targets, config.labels, sizes.candidates, id_col, "text", config.seed,
            sizes.candidate_partitions,
        ),
        "candidates",
    )

    true_cov = materialise(covariance_matrix(cleaned.select(*targets), targets), "true_cov")
    done = finished_runs(spark, out_dir) if resume else set()

    points, left = [], []
    for k in sizes.feature_counts:
        features = ranked[:k]
        columns = [id_col, *features, *targets]
        write_run(number_dataset(cleaned, config, features), f"{out_dir}/number_dataset", f"f{k}")
        built = build_training_set(
            all_real.select(*columns), all_candidates.select(*columns, "draw_no"), config,
            labels_of_names, features, sizes.train_candidates,
        )
        write_run(built.remaining, f"{out_dir}/remain_dataset", f"f{k}", varied=["text"])
        folded = assign_folds(built.training, sizes.folds, config, sizes.fold_by)
        write_run(folded, f"{out_dir}/text_dataset", f"f{k}", varied=["text"])
        # hashed on the way to each step that needs them, which are few whatever the grid:
        # stored vectors cost more to write and read than the rows cost to hash
        training = read_run(spark, f"{out_dir}/text_dataset", f"f{k}")
        vectors = with_vectors(training, features, targets, sizes.base)
        remaining = read_candidates(spark, f"{out_dir}/remain_dataset", f"f{k}")
        remaining = with_vectors(remaining, features, targets, sizes.base)
        selector = used_places(vectors)
        collisions = token_collisions(training, features, targets, sizes.base)
        folds = list(range(sizes.folds)) if sizes.run_folds is None else sizes.run_folds
        grid = grid_of(sizes.base, sizes.epochs, sizes.weight_decays)
        if search_trials:
            drawn = drawn_trials(spark, sizes.base, search_trials, config.seed, sizes.search_epochs)
            tried = materialise(vectors.select("labels", "fold", "features"), "vectors")
            best, trials = search_best(tried, drawn, folds, parallel=sizes.parallel_fits)
            write_run(trials, f"{out_dir}/search", f"f{k}")
            grid = [best]
        mine = [Point(k, grid_no, params, fold, collisions) for grid_no, params in enumerate(grid) for fold in folds]
        points += mine
        mine = [point for point in mine if point.settings not in done]
        if not mine:
            continue
        # all models of a table learn in the same scans, and score its rows in one
        models = train_plausibility(vectors, [p.params for p in mine], selector=selector, unseen=[p.fold for p in mine])
        varied = ["text", *[f"{SCORE}{i}" for i in range(len(models))]]
        tested = materialise(score_by_all(models, vectors), "tested", varied, ["fold"])
        judged = materialise(score_by_all(models, remaining), "judged", varied)
        for i, (point, model) in enumerate(zip(mine, models)):
            own = of_model(ranks.fold_split(tested, point.fold)[1], i)
            left.append((point, model, own, of_model(judged, i)))

    def run(work: tuple) -> None:
        point, *rest = work
        point.run(*rest, out_dir, config, true_cov)

    side_by_side(run, left, sizes.parallel_fits)
    paths = [run_path(f"{out_dir}/ledger", point.run_id) for point in points]
    return spark.read.schema(LEDGER_SCHEMA).parquet(*paths)


def finished_runs(spark: SparkSession, out_dir: str) -> set[tuple]:
    """Settings of the points in the ledger. A point's line is written last, so one that was cut short has none."""
    try:
        lines = spark.read.schema(LEDGER_SCHEMA).parquet(f"{out_dir}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {tuple(r) for r in lines.select("feature_count", "grid_no", "num_epochs", "weight_decay", "fold").collect()}


class Point:
    """One model: a grid point on one fold."""

    def __init__(self, k: int, grid_no: int, params: PlausibilityParams, fold: int, collisions: float):
        self.k, self.grid_no, self.params, self.fold = k, grid_no, params, fold
        self.collisions = collisions
        self.run_id = run_name(k, grid_no, fold)
        self.settings = (k, grid_no, params.num_epochs, params.weight_decay, fold)

    def run(
        self, model, test: DataFrame, remaining: DataFrame, out_dir: str, config: SurveyConfig, true_cov: DataFrame
    ) -> None:
        """Store the model, its scores of the fold and of the held-back rows, compare, note the result."""
        save_model(model, run_path(f"{out_dir}/models", self.run_id))
        write_run(test, f"{out_dir}/scored_test", self.run_id, varied=["text", "plausibility"])
        write_run(remaining, f"{out_dir}/scored_candidates", self.run_id, varied=["text", "plausibility"])
        spark = test.sparkSession
        tested = read_run(spark, f"{out_dir}/scored_test", self.run_id)
        scored = read_run(spark, f"{out_dir}/scored_candidates", self.run_id)
        diff = materialise(covariance_report(None, scored, config.targets, config.labels, true_cov), "covariance")
        write_run(diff, f"{out_dir}/covariance", self.run_id)
        accepted = scored.agg(F.count_if(F.col("prediction") == 1)).scalar()
        # undefined where fewer than two candidates were accepted: NaN, not absent
        norm = F.coalesce(diff.agg(F.first("frobenius_norm")).scalar(), F.lit(float("nan")))
        line = fold_metrics(tested).select(
            F.lit(self.k).alias("feature_count"),
            F.lit(self.grid_no).alias("grid_no"),
            F.lit(self.params.num_epochs).alias("num_epochs"),
            F.lit(self.params.weight_decay).alias("weight_decay"),
            F.lit(self.fold).alias("fold"),
            "test_rows", "accuracy", "f1", "precision", "recall", "majority_rate",
            accepted.alias("accepted"),
            norm.alias("frobenius_norm"),
            F.lit(self.collisions).alias("token_collisions"),
        )
        write_run(line, f"{out_dir}/ledger", self.run_id)


def score_saved_model(
    spark: SparkSession, out_dir: str, run_id: str, rows: DataFrame, features: list[str],
    config: SurveyConfig, params: PlausibilityParams,
) -> DataFrame:
    """Score spelled-out rows with the model that a run has saved."""
    model = load_model(run_path(f"{out_dir}/models", run_id))
    return score(model, with_vectors(rows, features, config.targets, params))
