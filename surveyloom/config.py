"""Settings of a survey and of the plausibility classifier."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from surveyloom import fixed_values as fv


@dataclass(frozen=True)
class SurveyConfig:
    """What the engine must know about a survey table besides its rows."""

    targets: list[str] = field(default_factory=lambda: fv.OBJECTIVE_TARGETS + fv.OPINION_TARGETS)
    id_col: str = fv.ID_COLUMN
    weight_cols: list[str] = field(default_factory=lambda: fv.ID_AND_WEIGHT_COLUMNS[1:])
    near_duplicates: dict[str, list[str]] = field(default_factory=lambda: dict(fv.NEAR_DUPLICATES))
    labels: dict[str, dict[str, str]] = field(default_factory=lambda: dict(fv.TARGET_LABELS))
    prompt_prefix: str = fv.PROMPT_PREFIX
    suffix_prefix: str = fv.SUFFIX_PREFIX
    seed: str = "42"

    def excluded_features(self) -> list[str]:
        """Columns that must not compete in the feature ranking."""
        stop = [c for t in self.targets for c in self.near_duplicates.get(t, [])]
        return [self.id_col, *self.weight_cols, *stop]


@dataclass(frozen=True)
class PlausibilityParams:
    """Hyper-parameters of the real-versus-generated classifier.

    One epoch stands for ``steps_per_epoch`` optimiser iterations, weight decay is
    the strength of the L2 penalty. MLlib's optimiser finds its own step size over
    whole passes, so a learning rate, warm-up and batch size have no counterpart.
    ``hash_dimensions`` is the length of the token vectors; the ledger tells what
    share of the tokens has to share a place.
    """

    num_epochs: int = fv.TRAINING_DEFAULTS["num_epochs"]
    weight_decay: float = fv.DEFAULT_WEIGHT_DECAY
    steps_per_epoch: int = 10
    hash_dimensions: int = 1 << 20
    crosses: bool = True

    @property
    def max_iter(self) -> int:
        return self.num_epochs * self.steps_per_epoch

    def with_values(self, **values) -> PlausibilityParams:
        return replace(self, **values)


@dataclass(frozen=True)
class ExperimentConfig:
    """Sizes and grid of one experiment run."""

    feature_counts: list[int] = field(default_factory=lambda: list(fv.FEATURE_COUNTS))
    epochs: list[int] = field(default_factory=lambda: list(fv.GRID_EPOCHS))
    weight_decays: list[float] = field(default_factory=lambda: [fv.DEFAULT_WEIGHT_DECAY])
    candidates: int = fv.DEFAULT_CANDIDATES
    train_candidates: int = fv.DEFAULT_TRAIN_CANDIDATES
    folds: int = fv.DEFAULT_FOLDS
    run_folds: list[int] | None = None
    fold_by: str = "id"
    search_epochs: tuple[int, int] = fv.SEARCH_EPOCH_RANGE
    candidate_partitions: int | None = None  # deal the draws out first, where few rows become many
    parallel_fits: int = 1  # points stored and compared at the same time; their models train in the same scans
    base: PlausibilityParams = field(default_factory=PlausibilityParams)
