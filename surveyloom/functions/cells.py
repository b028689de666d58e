"""Column expressions for single survey cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv


def code_to_null(cell: Column) -> Column:
    """The twelve missing codes become null; the inapplicable code stays."""
    return F.when(~cell.cast("string").isin(fv.MISSING_CODES), cell)


def sentinel_filled(cell: Column) -> Column:
    """Inapplicable or absent becomes the sentinel category, as text."""
    answer = F.nullif(cell.cast("string"), F.lit(fv.INAPPLICABLE_CODE))
    return F.coalesce(answer, F.lit(str(fv.SENTINEL)))


def to_number(cell: Column) -> Column:
    return cell.try_cast("double")


def is_code(cell: Column) -> Column:
    """True for cells that hold a whole-number answer code."""
    return cell.try_cast("bigint").isNotNull()


def remap(value: Column, mapping: dict) -> Column:
    """Replace listed values; anything else passes through."""
    groups: dict = {}
    for old, new in mapping.items():
        groups.setdefault(new, []).append(old)
    branches = None
    for new, olds in groups.items():
        hit = value.isin(olds)
        branches = F.when(hit, F.lit(new)) if branches is None else branches.when(hit, F.lit(new))
    return value if branches is None else branches.otherwise(value)
