"""Staging and reporting models as SQL over tables handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def staging_model(raw: DataFrame, with_load_time: bool = True) -> DataFrame:
    """Typed and trimmed records with an id; reads id, name, created_at, category, value."""
    staged = raw.sparkSession.sql("""
        SELECT lower(trim(CAST(id AS STRING))) AS record_id, trim(CAST(name AS STRING)) AS name,
               CAST(created_at AS TIMESTAMP) AS created_at, nullif(trim(CAST(category AS STRING)), '') AS category,
               CAST(value AS DECIMAL(38, 9)) AS value
        FROM {raw} WHERE id IS NOT NULL""", raw=raw)
    return staged.withColumn("loaded_at", F.current_timestamp()) if with_load_time else staged


def category_summary(staged: DataFrame, with_refresh_time: bool = True) -> DataFrame:
    """Count, range, sum and time span of each category, largest first."""
    made = staged.sparkSession.sql("""
        SELECT category, count(*) AS record_count, avg(value) AS avg_value, min(value) AS min_value,
               max(value) AS max_value, sum(value) AS total_value,
               min(created_at) AS earliest_record, max(created_at) AS latest_record
        FROM {staged} WHERE category IS NOT NULL GROUP BY category""", staged=staged)
    if with_refresh_time:
        made = made.withColumn("refreshed_at", F.current_timestamp())
    return made.orderBy(F.desc("record_count"), "category")


def run_summary(runs: DataFrame, datasets: DataFrame, users: DataFrame, quality: DataFrame) -> DataFrame:
    """Every run with its dataset, user and check results, newest first."""
    return runs.sparkSession.sql("""
        SELECT r.run_id, u.username, d.name AS dataset_name, d.file_format, r.started_at, r.duration_s, r.status,
               r.input_rows, r.output_rows, r.rows_removed,
               round(100.0 * r.rows_removed / nullif(r.input_rows, 0), 2) AS pct_rows_removed,
               q.success_pct AS quality_success_pct, q.passed AS quality_checks_passed,
               q.failed AS quality_checks_failed, q.total_expectations
        FROM {runs} r JOIN {datasets} d ON d.id = r.dataset_id JOIN {users} u ON u.id = r.user_id
        LEFT JOIN {quality} q ON q.run_id = r.run_id
        ORDER BY r.started_at DESC, r.run_id""", runs=runs, datasets=datasets, users=users, quality=quality)


def run_dashboard(runs: DataFrame) -> DataFrame:
    """Runs by outcome, success rate, and rows in, out and removed."""
    total, good = F.count(F.lit(1)), F.count_if(F.col("status") == "success")
    rows_in, rows_out = (F.coalesce(F.sum(c), F.lit(0)) for c in ("rows_in", "rows_out"))
    return runs.agg(
        total.alias("total_runs"), good.alias("success_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.coalesce(F.bround(F.try_divide(good * 100.0, total).cast("double"), 1), F.lit(0.0)).alias("success_rate"),
        rows_in.alias("rows_in"), rows_out.alias("rows_out"), (rows_in - rows_out).alias("rows_removed"))


def runs_of(runs: DataFrame, jobs: DataFrame, user_id) -> DataFrame:
    """Runs a user started, or of a job the user owns; runs without a job count too.

    Reads runs (job_id, user_id, ...) and jobs (job_id, owner_id).
    """
    owned = jobs.select(col("job_id").alias("_job"), col("owner_id").alias("_owner"))
    joined = runs.join(owned, F.col("job_id") == F.col("_job"), "left")
    return joined.filter((F.col("user_id") == user_id) | (F.col("_owner") == user_id)).drop("_job", "_owner")


def runs_of_jobs(runs: DataFrame, jobs: DataFrame, owner_id) -> DataFrame:
    """Runs of the jobs a user owns."""
    owned = jobs.filter(col("owner_id") == owner_id).select("job_id")
    return runs.join(owned, "job_id")
