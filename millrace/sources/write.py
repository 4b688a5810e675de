"""Write results, logs and catalogue entries."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, is_nested
from .read import read_delimited

RUNS = ("run_id string, status string, trigger string, started_at timestamp, finished_at timestamp, "
        "rows_in bigint, rows_out bigint, duration_s double, output_path string")
RUN_LOG = "run_id string, ts timestamp, level string, step string, message string"
CHECKS = ("run_id string, success boolean, total bigint, passed bigint, failed bigint, success_pct double, "
          "checks array<struct<expectation:string,column:string,success:boolean,observed:double>>")
DATASETS = ("dataset_id string, name string, path string, format string, rows bigint, cols bigint, "
            "created_at timestamp")


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since a delimited file has only texts."""
    return df.select(*[F.to_json(col(f.name)).alias(f.name) if is_nested(f.dataType) else col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    _flat(df).write.mode(mode).option("escape", '"').csv(path, header=True)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_both(df: DataFrame, folder: str, base_name: str, mode: str = "errorifexists") -> dict:
    """Write Parquet, then CSV from those files: the table is computed once."""
    base = f"{folder.rstrip('/')}/{safe_name(base_name)}_cleaned"
    write_parquet(df, base + ".parquet", mode)
    stored = df.sparkSession.read.schema(df.schema).parquet(base + ".parquet")
    write_csv(stored, base + ".csv", mode)
    files = df.sparkSession.read.format("binaryFile").load(base + ".csv").select("path", "length")
    size = files.agg(F.sum("length")).first()[0] or 0
    return {"csv_path": base + ".csv", "parquet_path": base + ".parquet", "rows": stored.count(),
            "cols": len(df.columns), "csv_size_kb": round(size / 1024, 1)}


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    write_parquet(read_delimited(spark, csv_path), parquet_path)
    return spark.read.parquet(parquet_path)


def stage_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store as a table of the catalogue; with a path, in that folder."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def now() -> datetime:
    return datetime.now(timezone.utc)


def append_rows(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    """Append bookkeeping rows of one run in one write."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def register_dataset(spark: SparkSession, catalogue: str, name: str, path: str, fmt: str, rows: int, cols: int) -> str:
    dataset_id = uuid.uuid4().hex
    append_rows(spark, catalogue, DATASETS, [(dataset_id, name, path, fmt, rows, cols, now())])
    return dataset_id


def save_join(df: DataFrame, folder: str, catalogue: str, name: str = "joined") -> dict:
    """Write a join result as CSV and enter it into the dataset catalogue."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex[:10]}_{safe_name(name)}.csv"
    seen = Observation("joined")
    write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    rows = seen.get["rows"]
    dataset_id = register_dataset(df.sparkSession, catalogue, name, path, "csv", rows, len(df.columns))
    return {"dataset_id": dataset_id, "path": path, "rows": rows, "cols": len(df.columns)}
