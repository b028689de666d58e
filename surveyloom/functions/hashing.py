"""Reproducible randomness: every draw is a function of a salt and row keys.

Nothing here depends on partitioning, task order or retries, so a lost executor
recomputes exactly the rows it held.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DRAW_RANGE = 1 << 60


def digest(salt: str, *keys: str | Column) -> Column:
    """32 hex digits of md5('salt:key1:key2...'); keys must not be null."""
    parts = [F.lit(salt)]
    for key in keys:
        parts.append((F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hex_to_long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def h32(salt: str, *keys: str | Column) -> Column:
    """Uniform integer in [0, 2**32)."""
    return hex_to_long(F.substring(digest(salt, *keys), 1, 8))


def h60(salt: str, *keys: str | Column) -> Column:
    """Uniform integer in [0, 2**60): enough for several draws by mixed radix."""
    return hex_to_long(F.substring(digest(salt, *keys), 1, 15))


def int_div(a: Column, b: Column) -> Column:
    """Whole-number quotient, exact over the full bigint range."""
    return F.call_function("div", a, b)
