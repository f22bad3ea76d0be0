"""Folders for intermediate tables, shared by all executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of the session: `spark.checkpoint.dir`, or what setCheckpointDir() named."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError(f"set {SETTING} or call setCheckpointDir() with a folder that all executors share")
    return base.rstrip("/")


def ensure_scratch(spark: SparkSession) -> None:
    """Where the session names no folder, use one in its warehouse, which its executors share."""
    try:
        scratch_base(spark)
    except RuntimeError:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write rows that several passes will read, and return the written table.

    Survives the loss of executors, unlike cached blocks, and gives the planner the
    real size. Tables of texts take about half the disk with the compression `zstd`.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
