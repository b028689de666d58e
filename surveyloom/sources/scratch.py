"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, a folder in the warehouse.

    Both are places that the driver and all executors reach. A folder of the
    machine's own temporary space is never taken.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get(WAREHOUSE_CONF).rstrip('/')}/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/surveyloom/{uuid.uuid4().hex}/{name}"


def materialise(
    df: DataFrame, name: str = "table", varied: list[str] | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """Write the rows once as Parquet and go on from the written table.

    Cuts the lineage for good, survives lost executors, and later steps read only
    the columns they use. ``varied`` columns are written without a dictionary.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.options(**without_dictionary(varied or []))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written.select(*df.columns) if partition_by else written


def without_dictionary(columns: list[str]) -> dict[str, str]:
    """Settings of a Parquet writer for columns whose values are nearly all different."""
    return {f"parquet.enable.dictionary#{c}": "false" for c in columns}
