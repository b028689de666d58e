"""Writers. Run suffixes and split names are partition columns, not file names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from surveyloom.operators.labels import code_map_lines, code_map_text
from surveyloom.sources.scratch import without_dictionary


def run_name(feature_count: int, grid_no: int, fold: int | None = None) -> str:
    return f"f{feature_count}-{grid_no}" if fold is None else f"f{feature_count}-{grid_no}-{fold}"


def run_path(path: str, run_id: str, split: str | None = None) -> str:
    """A run's own folder, named so that reading ``path`` finds run and split as columns."""
    return f"{path}/run_id={run_id}" if split is None else f"{path}/run_id={run_id}/split={split}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table, or only the partitions that ``df`` has rows for."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_run(
    df: DataFrame, path: str, run_id: str, split: str | None = None, varied: list[str] | None = None
) -> None:
    """One run's rows, in its own folder; repeating a run replaces it, also by no rows. ``varied`` columns get no dictionary."""
    writer = df.write.mode("overwrite").options(**without_dictionary(varied or []))
    writer.parquet(run_path(path, run_id, split))


def append_rows(df: DataFrame, path: str) -> None:
    """Add lines to a metrics or result table."""
    df.write.mode("append").parquet(path)


def write_code_map(labels: DataFrame, path: str, key: str = "code", value: str = "label") -> None:
    """The nested map as one JSON line, as configuration files have it; one entry per target and code."""
    code_map_text(labels, key, value).coalesce(1).write.mode("overwrite").text(path)


def write_code_map_lines(
    labels: DataFrame, path: str, parts: int | None = None, key: str = "code", value: str = "label"
) -> None:
    """The map as one JSON line per feature, in files by ranges of features; `parts` bounds their number."""
    lines = code_map_lines(labels, key, value)
    ranged = lines.repartitionByRange(parts, "feature") if parts else lines.repartitionByRange("feature")
    ranged.sortWithinPartitions("feature").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
