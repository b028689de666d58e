"""Candidate rows: copies of real rows with every target redrawn.

A row's draws depend on its key and draw number only. All targets of a candidate
are drawn from one 60-bit hash, read as a mixed-radix number, as long as the
combined number of choices stays far below 2**60; further targets take a further
hash.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.hashing import h60, int_div
from surveyloom.operators.labels import LabelMap, reverse_of
from surveyloom.operators.ranks import assign_quota

CHOICES_PER_HASH = 1 << 32
DRAWS_PER_STEP = 1000


def draw_groups(sizes: dict[str, int]) -> list[list[str]]:
    """Targets, in order, grouped so that a group's choices fit one hash."""
    groups: list[list[str]] = []
    for target, size in sizes.items():
        if size < 2:
            raise ValueError(f"target {target} has no alternative to its only value")
        last = groups[-1] if groups else None
        if last and prod(sizes[t] - 1 for t in last) * (size - 1) <= CHOICES_PER_HASH:
            last.append(target)
        else:
            groups.append([target])
    return groups


def draw_choices(
    sizes: dict[str, int], keys: list[str], seed: str
) -> tuple[dict[str, Column], dict[str, Column]]:
    """(hash columns, choices): per target a uniform whole number in [0, size - 1).

    The choices of a group are the digits of its hash column in mixed radix.
    """
    hashes, choices = {}, {}
    for number, group in enumerate(draw_groups(sizes)):
        name, divisor = f"_hash{number}", 1
        hashes[name] = h60(f"{seed}:draw{number}", *keys)
        for target in group:
            alternatives = sizes[target] - 1
            rest = F.col(name) if divisor == 1 else int_div(F.col(name), F.lit(divisor))
            choices[target] = rest % alternatives
            divisor *= alternatives
    return hashes, choices


def draw_alternative(current: Column, values: list, own: list, choice: Column) -> Column:
    """The value at place ``choice`` among ``values`` without the current one.

    ``own`` holds, at each place, the text by which that place is recognised as
    the current value (null if it never is). A current value outside the domain
    stops the job.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in own]), current.cast("string"))
    pick = choice + 1 + F.when(choice + 1 >= place, F.lit(1)).otherwise(F.lit(0))
    drawn = F.element_at(F.array(*[F.lit(v) for v in values]), pick.cast("int"))
    stop = F.raise_error(
        F.concat(F.lit("value outside its domain: "), F.coalesce(current.cast("string"), F.lit("null")))
    )
    return F.when(place > 0, drawn).otherwise(stop)


def redraw_targets(
    df: DataFrame, targets: list[str], labels: LabelMap, keys: list[str], mode: str, seed: str
) -> DataFrame:
    """Replace every target by a different legal value.

    ``mode='num'`` reads and writes codes; ``mode='text'`` reads and writes labels
    and draws among the codes behind them.
    """
    if mode not in ("num", "text"):
        raise ValueError(f"unknown mode {mode!r}")
    reverse = reverse_of(labels)
    codes = {t: sorted(labels[t], key=int) for t in targets}
    hashes, choices = draw_choices({t: len(codes[t]) for t in targets}, keys, seed)
    types = dict(df.dtypes)
    replaced = {}
    for t in targets:
        if mode == "num":
            current = F.col(t) if types[t] == "string" else F.col(t).cast("int")
            drawn = draw_alternative(current, codes[t], codes[t], choices[t]).cast(types[t])
        else:
            text = [labels[t][c] for c in codes[t]]
            own = [labels[t][c] if reverse[t][labels[t][c]] == c else None for c in codes[t]]
            drawn = draw_alternative(F.col(t), text, own, choices[t])
        replaced[t] = drawn
    # hashes first, so that each is computed once; then one select, so that all
    # draws read the original cells
    return df.withColumns(hashes).select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns])


def expand_draws(
    df: DataFrame,
    keys: list[str],
    quota: str = "quota",
    draw: str = "draw_no",
    spread: int | None = None,
) -> DataFrame:
    """One row per draw, numbered from 0; rows without quota vanish.

    The expansion goes by steps of at most ``DRAWS_PER_STEP`` draws. When few
    source rows must become very many candidates, ``spread`` names the number of
    partitions over which the steps (not the candidates) are dealt out first.
    """
    last = F.col(quota) - 1
    steps = df.where(F.col(quota) > 0).withColumn(
        "_step", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(DRAWS_PER_STEP).cast("bigint")))
    )
    if spread:
        steps = steps.repartition(spread, *keys, "_step")
    until = F.least(F.col("_step") + (DRAWS_PER_STEP - 1), last)
    return steps.withColumn(draw, F.explode(F.sequence(F.col("_step"), until))).drop("_step", quota)


def generate_candidates(
    df: DataFrame,
    targets: list[str],
    labels: LabelMap,
    num: int,
    id_col: str = "id",
    mode: str = "text",
    seed: str = "42",
    spread: int | None = None,
) -> DataFrame:
    """``num`` candidates keyed by (id, draw_no), evenly spread over the rows."""
    quotas = assign_quota(df, num, [id_col], seed)
    drawn = expand_draws(quotas, [id_col], spread=spread)
    return redraw_targets(drawn, targets, labels, [id_col, "draw_no"], mode, seed)
