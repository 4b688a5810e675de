"""Whole runs: read, report, clean, check, write, and keep a record."""

from __future__ import annotations

import time
import uuid
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shape
from ..reports import profile as prof
from ..reports import quality
from ..sources import write
from ..sources.read import file_name, list_files, read_by_header, read_dataset, read_delimited, suffix, with_file_name
from ..sources.scratch import settle
from . import models
from .steps import run_steps
from .templates import BATCH_STEPS, DEFAULT_STEPS


class Journal:
    """Log lines of one run, written with one append at its end."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), uuid.uuid4().hex
        self.started, self.clock, self.lines = write.now(), time.monotonic(), []

    def note(self, level: str, step: str, message: str) -> None:
        self.lines.append((self.run_id, write.now(), level, step, message))

    def close(self, status: str, rows_in: int | None, rows_out: int | None, output: str | None, trigger: str) -> None:
        took = round(time.monotonic() - self.clock, 2)
        write.append_rows(self.spark, f"{self.folder}/run_logs", write.RUN_LOG, self.lines)
        write.append_rows(self.spark, f"{self.folder}/runs", write.RUNS, [
            (self.run_id, status, trigger, self.started, write.now(), rows_in, rows_out, took, output)])


def table_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Profile, missing values, duplicates, outliers and correlations, measured once."""
    measured = prof.column_stats(df)
    return {
        "profile": prof.profile(df, measured),
        "missing": df.sparkSession.createDataFrame(
            [(s["column"], s["missing"], s["missing_pct"]) for s in measured], "column string, count bigint, pct double"),
        "duplicates": prof.duplicate_report(df),
        "outliers": prof.outlier_report(df, measured),
        "correlation": prof.correlation(df, [s["column"] for s in measured if s["kind"] == "numeric"]),
        "checks": quality.automatic_checks(df, measured),
    }


def _record_checks(journal: Journal, results: DataFrame) -> dict:
    rows = results.collect()  # one row per check
    passed = sum(r.success for r in rows)
    score = round(passed / len(rows) * 100, 2) if rows else 0.0
    write.append_rows(journal.spark, f"{journal.folder}/check_results", write.CHECKS, [
        (journal.run_id, passed == len(rows), len(rows), passed, len(rows) - passed, score,
         [(r.expectation, r.column, r.success, r.observed) for r in rows])])
    return {"success": passed == len(rows), "success_pct": score, "total": len(rows)}


def run_stages(spark: SparkSession, source: str | DataFrame, stages: list[dict], folder: str,
               reports: bool = True, trigger: str = "manual") -> dict[str, Any]:
    """Run typed stages over a dataset and write the outcome as CSV.

    Stage types: `transform` (a list of operations), `spark_transform` (one
    operation), `dq_check` (a suite), `model` (staging or category summary).
    Unknown types are logged and skipped.  A failure is recorded, then raised.
    """
    journal = Journal(spark, folder)
    rows_in, status = None, "success"
    try:
        df = source if isinstance(source, DataFrame) else read_dataset(spark, source)
        rows_in = df.count()
        journal.note("INFO", "extract", f"loaded {rows_in} rows, {len(df.columns)} columns")
        summary: dict[str, Any] = table_reports(df) if reports else {}
        journal.note("INFO", "profile", f"{len(df.columns)} columns profiled")
        for i, stage in enumerate(stages):
            kind, config, name = stage.get("type", ""), stage.get("config") or {}, stage.get("name", f"step_{i + 1}")
            journal.note("INFO", name, f"starting [{kind}]")
            if kind in ("transform", "spark_transform"):
                done = run_steps(df, config.get("operations", []) if kind == "transform" else [config])
                df = settle(done.df)
                status = "partial" if done.status == "partial" else status
                summary[f"{kind}_{i}"] = done.log
                journal.note("INFO", name, f"{df.count()} rows out")
            elif kind == "dq_check":
                results = quality.run_suite(df, config["suite"] if "suite" in config else quality.default_suite(df))
                score = _record_checks(journal, results)
                summary[f"dq_{i}"] = results
                journal.note("INFO" if score["success"] else "WARN", name, f"{score['success_pct']}% of checks passed")
            elif kind == "model":
                df = {"staging": models.staging_model, "summary": models.category_summary}[config["model"]](df)
                journal.note("INFO", name, f"model {config['model']} applied")
            else:
                journal.note("WARN", name, f"unknown stage type '{kind}', skipped")
        output = f"{folder.rstrip('/')}/output_{journal.run_id}.csv"
        settled = settle(df)  # a stage after the last transform may read the table anew
        rows_out = settled.count()
        write.write_csv(settled, output)
        journal.note("INFO", "load", f"{rows_out} rows written")
    except Exception as e:
        journal.note("ERROR", "engine", str(e).splitlines()[0])
        journal.close("failed", rows_in, None, None, trigger)
        raise
    journal.close(status, rows_in, rows_out, output, trigger)
    return {"run_id": journal.run_id, "rows_in": rows_in, "rows_out": rows_out, "output_path": output, "summary": summary}


def run_report(spark: SparkSession, source: str | DataFrame, folder: str, steps: list[dict] | None = None,
               name: str = "dataset", staging: bool = False) -> dict[str, Any]:
    """Read, profile, check, clean and write a dataset; everything found comes back."""
    journal = Journal(spark, folder)
    rows_in = None
    try:
        df = source if isinstance(source, DataFrame) else read_dataset(spark, source)
        rows_in = df.count()
        found = table_reports(df)
        done = run_steps(df, steps or DEFAULT_STEPS, metrics=True)
        for entry in done.log:
            journal.note("INFO", entry["step"], f"{entry['status']}: {entry.get('rows_before')} to {entry.get('rows_after')}")
        applied = [e["step"] for e in done.log if e["status"] == "success"]
        model = shape.staging_model_text(done.df, name, applied) if staging else None
        written = write.write_both(done.df, folder, name)
    except Exception as e:
        journal.note("ERROR", "engine", str(e).splitlines()[0])
        journal.close("failed", rows_in, None, None, "manual")
        raise
    journal.close(done.status, rows_in, written["rows"], written["csv_path"], "manual")
    return {
        "run_id": journal.run_id, "input_rows": rows_in, "output_rows": written["rows"],
        "rows_removed": rows_in - written["rows"], "log": done.log_frame(spark), "reports": found, "model": model,
        "files": written, "preview": shape.preview(spark.read.parquet(written["parquet_path"]))}


def preview_steps(df: DataFrame, steps: list[dict], order_by: list[str] | None = None, n: int = 100) -> dict[str, Any]:
    """Row and column counts before and after the steps, their log, and the first rows."""
    done = run_steps(df, steps, metrics=True)
    after = done.log_frame(df.sparkSession)
    last = [e["rows_after"] for e in done.log if e.get("rows_after") is not None]
    rows_before = df.count()
    counts = df.sparkSession.createDataFrame(
        [(rows_before, last[-1] if last else rows_before, len(df.columns), len(done.df.columns))],
        "rows_before bigint, rows_after bigint, cols_before int, cols_after int")
    return {"counts": counts, "log": after, "preview": shape.preview(done.df, n, order_by=order_by)}


def join_report(left: DataFrame, right: DataFrame, joined: DataFrame) -> DataFrame:
    """Row counts of both sides and of the join, and its columns."""
    sides = {"left_rows": left, "right_rows": right, "output_rows": joined}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name)) for name, df in sides.items()]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return every.agg(*[F.max(F.when(F.col("side") == name, F.col("n"))).alias(name) for name in sides]).select(
        *sides, F.lit(len(joined.columns)).cast("bigint").alias("output_cols"), F.lit(",".join(joined.columns)).alias("new_columns"))


def clean_files(spark: SparkSession, folder: str | list[str], out: str, steps: list[dict] | None = None) -> list[dict]:
    """Clean every data file of a folder (or each listed path) on its own, as ``clean_<file>``.

    Each file has its own columns and its own statistics, so each is one Spark
    run; a file that cannot be read is reported and the others go on.
    """
    report = []
    for path in list_files(spark, folder) if isinstance(folder, str) else folder:
        name = file_name(path)
        try:
            df = read_dataset(spark, path) if suffix(path) != "tsv" else read_delimited(spark, path, sep="\t")
            done = run_steps(df, steps or BATCH_STEPS)
            target = write.write_csv(done.df, f"{out.rstrip('/')}/clean_{name}", "overwrite")
            errors = "; ".join(f"{e['step']}: {e['error']}" for e in done.log if e["status"] == "failed")
            report.append({"file": name, "status": done.status, "path": target, "error": errors or None})
        except Exception as e:  # noqa: BLE001 - the other files go on
            report.append({"file": name, "status": "failed", "path": None, "error": str(e).splitlines()[0]})
    return report


def summarise_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file, status, rows, cols, columns, missing, dupes, error) of every data file of a folder, and of all of them.

    Status is ok, failed (with the error and no counts) or total, the row
    without a file that adds the others up. Delimited files are read by
    header, as many together as have the same one; each JSON file has its own
    columns and is read by itself. A file without rows has zeros, one of blank
    lines has failed, one of no bytes is not in Spark's listing; a folder
    without data files gives the total row alone.
    """
    files = list_files(spark, folder)
    read: list[tuple[list[str], DataFrame | Exception]] = []
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        some = [f for f in files if suffix(f) == kind]
        read += read_by_header(spark, some, sep) if some else []
    for path in files:
        if suffix(path) not in ("csv", "tsv"):
            try:
                read.append(([path], with_file_name(read_dataset(spark, path))))
            except Exception as e:  # noqa: BLE001 - the other files go on
                read.append(([path], e))
    known, counted = [], []
    for names, df in read:
        failed = isinstance(df, Exception)
        columns = None if failed else [c for c in df.columns if c != "file_name"]
        error = str(df) if failed else None
        known += [(file_name(unquote(f)), "failed" if failed else "ok", columns, error) for f in names]
        if not failed:
            counted.append(prof.file_summary(df).select("file", "rows", "missing", "dupes"))
    listed = spark.createDataFrame(known, "file string, status string, columns array<string>, error string")
    none = spark.createDataFrame([], "file string, rows bigint, missing bigint, dupes bigint")
    counts = settle(reduce(lambda a, b: a.unionByName(b), counted, none), "counts")
    ok = F.col("status") == "ok"
    numbers = [F.when(ok, F.coalesce(c, F.lit(0))).alias(c) for c in ("rows", "missing", "dupes")]
    each = listed.join(counts, "file", "left").select(
        "file", "status", numbers[0], F.when(ok, F.size("columns")).cast("bigint").alias("cols"), "columns", *numbers[1:], "error")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "missing", "dupes")]
    total = counts.agg(*sums).select(
        F.lit(None).cast("string").alias("file"), F.lit("total").alias("status"), "rows", F.lit(None).cast("bigint").alias("cols"),
        F.lit(None).cast("array<string>").alias("columns"), "missing", "dupes", F.lit(None).cast("string").alias("error"))
    return each.unionByName(total)
