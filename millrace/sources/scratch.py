"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names, or one in the warehouse, which all executors share too.

    A warehouse left at a local folder is shared only where driver and
    executors are one process; elsewhere it is refused.
    """
    root = spark.conf.get(_SETTING, None)
    return (root or shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"), spark.conf.get("spark.master", ""))).rstrip("/")


def shared_warehouse(folder: str, master: str) -> str:
    one_process = master == "local" or master.startswith("local[")
    if folder.startswith("file:") and not one_process:
        raise ValueError(f"{_SETTING} is not set and the warehouse {folder} is a local folder: name a folder that all executors share in {_SETTING}")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the table once and go on from the files.

    Cuts the lineage, survives lost executors, and lets each later pass read
    only the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
