"""Parameter grids and drawn parameter tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions.hashing import h32


def grid_rows(defaults: dict, **axes: list) -> list[dict]:
    """One settings dict per grid point: defaults overridden by the axis values."""
    names = list(axes)
    return [
        {**defaults, **dict(zip(names, point))} for point in itertools.product(*axes.values())
    ]


def param_grid(folds: DataFrame, defaults: dict, **axes: list) -> DataFrame:
    """Every row of ``folds`` with every grid point; ``grid_no`` numbers the points.

    The grid is an array literal that is exploded in place, so no join is needed.
    """
    points = [
        F.struct(F.lit(i).alias("grid_no"), *[F.lit(v).alias(n) for n, v in point.items()])
        for i, point in enumerate(grid_rows(defaults, **axes))
    ]
    return folds.select("*", F.explode(F.array(*points)).alias("_point")).select(
        *folds.columns, "_point.*"
    )


def log_uniform_int(u: Column, low: int, high: int) -> Column:
    """Whole number in [low, high], uniform on the log scale, for u in [0, 1)."""
    start, span = math.log(low), math.log(high + 1) - math.log(low)
    value = F.floor(F.exp(F.lit(start) + u * F.lit(span)))
    return F.greatest(F.lit(low), F.least(F.lit(high), value)).cast("int")


def chosen(u: Column, choices: list) -> Column:
    place = F.floor(u * F.lit(len(choices))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(c) for c in choices]), place)


def param_draws(
    df: DataFrame,
    trials: int,
    seed: str,
    keys: list[str],
    choices: dict[str, list] | None = None,
    ranges: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """``trials`` drawn settings per row of ``df``, reproducible from seed and keys."""
    choices = fv.SEARCH_CHOICES if choices is None else choices
    ranges = {"num_train_epochs": fv.SEARCH_EPOCH_RANGE} if ranges is None else ranges
    drawn = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))

    def unit(name: str) -> Column:
        return h32(f"{seed}:{name}", *keys, "trial") / F.lit(float(1 << 32))

    columns = {name: chosen(unit(name), options) for name, options in choices.items()}
    columns |= {name: log_uniform_int(unit(name), *limits) for name, limits in ranges.items()}
    return drawn.withColumns(columns)
