"""Readers. Survey cells are read as text: codes and missing codes share columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from surveyloom import fixed_values as fv
from surveyloom.operators.labels import code_map_rows, task_rows


def read_survey_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    id_col: str = fv.ID_COLUMN,
    empty_cells: list[str] | None = None,
) -> DataFrame:
    """A survey table with a header line; every cell text, the id a whole number.

    ``columns`` are taken by the names in the header, whatever their order there.
    Files whose headers differ from the first one's, and lines with too few or too
    many cells, are errors. Cells that usual survey readers take for empty become null.
    """
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    schema = StructType([StructField(c, StringType()) for c in reader.csv(path).columns])
    raw = reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    if columns is not None:
        raw = raw.select(*columns)
    empty = fv.EMPTY_CELLS if empty_cells is None else empty_cells
    return raw.select(
        *[
            F.col(c).cast("bigint").alias(c)
            if c == id_col
            else F.when(~F.col(c).isin(empty), F.col(c)).alias(c)
            for c in raw.columns
        ]
    )


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Named splits of one table; validation and test are the same rows."""
    table = read_table(spark, path)
    parts = {s: table.where(F.col("split") == s).drop("split") for s in ("train", "test")}
    return {"train": parts["train"], "validate": parts["test"], "test": parts["test"]}


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run's rows. Its own folder is read, since runs differ in their feature columns."""
    return spark.read.parquet(f"{path}/run_id={run_id}")


def read_candidates(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, path) if run_id is None else read_run(spark, path, run_id)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(feature, code, label) from a nested JSON file of at most config size."""
    return code_map_rows(spark.read.text(path, wholetext=True))


def read_code_map_lines(spark: SparkSession, path: str) -> DataFrame:
    """(feature, code, label) from JSON lines, one feature each, of any number."""
    return code_map_rows(spark.read.text(path))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(feature, task_type, num_labels, range) from the JSON metadata file."""
    return task_rows(spark.read.text(path, wholetext=True))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path).select("name", "simplab")
