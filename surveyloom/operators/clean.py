"""Cleaning a coded survey table: missing codes, sentinels, numbers, profiles.

Everything here is a narrow, one-select transformation; no operator shuffles
more than one row of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv
from surveyloom.functions.cells import code_to_null, sentinel_filled, to_number


def checked_columns(df: DataFrame, columns: list[str]) -> list[str]:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")
    return columns


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*checked_columns(df, columns))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*checked_columns(df, columns))


def candidate_features(df: DataFrame, targets: list[str], excluded: list[str]) -> list[str]:
    """Columns that may be ranked: everything but targets and the stop list."""
    checked_columns(df, targets)
    out = set(targets) | set(excluded)
    return [c for c in df.columns if c not in out]


def filter_applicable(df: DataFrame, targets: list[str]) -> DataFrame:
    """Keep rows where no target has the inapplicable code (null passes)."""
    for target in checked_columns(df, targets):
        df = df.where(~F.col(target).cast("string").eqNullSafe(F.lit(fv.INAPPLICABLE_CODE)))
    return df


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=checked_columns(df, columns))


def _each_cell(df: DataFrame, columns: list[str], change) -> DataFrame:
    chosen = set(columns)
    return df.select(
        *[change(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def _cells(df: DataFrame, id_col: str) -> list[str]:
    return [c for c in df.columns if c != id_col]


def codes_to_null(df: DataFrame, id_col: str = fv.ID_COLUMN) -> DataFrame:
    return _each_cell(df, _cells(df, id_col), code_to_null)


def fill_sentinel(df: DataFrame, id_col: str = fv.ID_COLUMN) -> DataFrame:
    return _each_cell(df, _cells(df, id_col), sentinel_filled)


def numeric_cells(df: DataFrame, id_col: str = fv.ID_COLUMN) -> DataFrame:
    """Every cell as a number; cells that are none become null."""
    return _each_cell(df, _cells(df, id_col), to_number)


def prepare(
    df: DataFrame, targets: list[str], id_col: str = fv.ID_COLUMN
) -> DataFrame:
    """Rows with all targets answered, every cell a number, gaps as the sentinel.

    The row filter is stated on the raw cells, so it reaches the scan; being in no
    list is unknown for null, which drops the row as well. Cells that parse as no
    number end as the sentinel and are counted by ``unparseable_counts``.
    """
    gaps = [fv.INAPPLICABLE_CODE, *fv.MISSING_CODES]
    kept = df
    for target in checked_columns(df, targets):
        kept = kept.where(~F.col(target).cast("string").isin(gaps))

    def number(cell: Column) -> Column:
        return F.coalesce(to_number(cell), F.lit(float(fv.SENTINEL)))

    return _each_cell(kept, _cells(df, id_col), number)


def prepare_numeric(df: DataFrame, targets: list[str], id_col: str = fv.ID_COLUMN) -> DataFrame:
    """The same as ``prepare``, step by step from the single operators."""
    answered = drop_missing(filter_applicable(codes_to_null(df, id_col), targets), targets)
    numbers = numeric_cells(fill_sentinel(answered, id_col), id_col)
    return numbers.fillna(float(fv.SENTINEL), subset=_cells(df, id_col))


def missing_code_counts(df: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(code, cells): how often each missing code occurs in the whole table."""
    codes = fv.PROFILED_CODES if codes is None else codes
    cells = F.array(*[F.col(c).cast("string") for c in df.columns])
    wide = df.select(F.explode(cells).alias("cell")).agg(
        *[F.count_if(F.col("cell") == code).alias(f"n{i}") for i, code in enumerate(codes)]
    )
    entries = [
        F.struct(F.lit(code).alias("code"), F.col(f"n{i}").alias("cells"))
        for i, code in enumerate(codes)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def _per_column(df: DataFrame, test, name: str) -> DataFrame:
    wide = df.agg(*[F.count_if(test(F.col(c))).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("variable"), F.col(c).alias(name)) for c in df.columns]
    return wide.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def null_profile(df: DataFrame) -> DataFrame:
    """(variable, nulls) in one aggregate."""
    return _per_column(df, lambda cell: cell.isNull(), "nulls")


def unparseable_counts(df: DataFrame) -> DataFrame:
    """(variable, cells) that are neither a number nor a known missing code."""
    gaps = [fv.INAPPLICABLE_CODE, *fv.MISSING_CODES]
    return _per_column(
        df,
        lambda cell: cell.isNotNull()
        & ~cell.cast("string").isin(gaps)
        & cell.cast("string").try_cast("double").isNull(),
        "cells",
    )


def semi_join_ids(df: DataFrame, kept: DataFrame, id_col: str = fv.ID_COLUMN) -> DataFrame:
    """Rows of ``df`` whose id survived in ``kept``."""
    return df.join(kept.select(id_col), id_col, "left_semi")
