"""What changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import CATEGORICAL, NUMERIC, col, kinds
from ..functions.stats import value
from ..sources.write import append_rows, now, read_rows
from .profile import pct

LIGHT = "column string, dtype string, kind string, missing_pct double, min double, max double, mean double, unique bigint"
HISTORY = ("baseline_id string, new_id string, baseline_name string, new_name string, drift_score double, "
           "severity string, compared_at timestamp")

# Points per kind of change, over the share of columns, and the limits of the severities.
POINTS = {"added": 25, "removed": 30, "type_changes": 25, "nullable_changes": 10, "range_changes": 10}
NULL_POINTS, RANGE_SHARE = 10, 0.2
LOW, MEDIUM = 15, 45


def light_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, null share, and range or distinct count of every column."""
    by_kind = kinds(df)
    wanted = {None: F.count(F.lit(1))}
    for c, k in by_kind.items():
        v = value(df, c)
        wanted[c, "n"] = F.count(v)
        if k == NUMERIC:
            wanted |= {(c, "min"): F.min(v), (c, "max"): F.max(v), (c, "mean"): F.avg(v.cast("double"))}
    got = stats.measure(df, wanted, fields=1)
    unique = stats.distinct_counts(df, [c for c, k in by_kind.items() if k != NUMERIC], approx)
    rows = []
    for f in df.schema:
        c, numeric = f.name, by_kind[f.name] == NUMERIC
        ends = [None if got.get((c, m)) is None else float(got[c, m]) + 0.0 for m in ("min", "max", "mean")]
        rows.append((c, f.dataType.simpleString(), NUMERIC if numeric else CATEGORICAL,
                     pct(got[None] - got[c, "n"], got[None]), *ends, unique.get(c)))
    return df.sparkSession.createDataFrame(rows, LIGHT)


def column_sets(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Every column of either table and where it occurs."""
    spark = baseline.sparkSession
    a = spark.createDataFrame([(c, True) for c in baseline.columns], "column string, in_baseline boolean")
    b = spark.createDataFrame([(c, True) for c in new.columns], "column string, in_new boolean")
    both = a.join(b, "column", "full").na.fill(False)
    change = (F.when(~F.col("in_baseline"), "added").when(~F.col("in_new"), "removed").otherwise("common"))
    return both.withColumn("change", change)


def compare(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Column by column, both sides' profile; `baseline` and `new` are light profiles."""
    def side(p: DataFrame, name: str) -> DataFrame:
        return p.select("column", F.lit(True).alias(f"in_{name}"), *[
            col(c).alias(f"{name}_{to}") for c, to in
            (("dtype", "dtype"), ("kind", "kind"), ("missing_pct", "null_pct"), ("min", "min"), ("max", "max"))])

    both = side(baseline, "baseline").join(side(new, "new"), "column", "full")
    both = both.na.fill(False, ["in_baseline", "in_new"]).na.fill(0.0, ["baseline_null_pct", "new_null_pct"])
    common = F.col("in_baseline") & F.col("in_new")
    width = F.col("baseline_max") - F.col("baseline_min")
    numeric = (F.col("baseline_kind") == NUMERIC) & (F.col("new_kind") == NUMERIC) & (width > 0)

    def shift(end: str):
        return F.try_divide(F.abs(F.col(f"new_{end}") - F.col(f"baseline_{end}")), width)

    moved = numeric & ((shift("min") > RANGE_SHARE) | (shift("max") > RANGE_SHARE))
    null_moved = F.abs(F.col("new_null_pct") - F.col("baseline_null_pct")) > NULL_POINTS
    return both.select(
        "column", "in_baseline", "in_new",
        F.coalesce("baseline_dtype", F.lit("—")).alias("baseline_dtype"), F.coalesce("new_dtype", F.lit("—")).alias("new_dtype"),
        "baseline_null_pct", "new_null_pct", "baseline_min", "baseline_max", "new_min", "new_max",
        F.coalesce(common & (F.col("baseline_dtype") != F.col("new_dtype")), F.lit(False)).alias("dtype_changed"),
        F.coalesce(common & null_moved, F.lit(False)).alias("null_rate_changed"),
        F.coalesce(common & moved, F.lit(False)).alias("range_changed"))


def drift_score(comparison: DataFrame) -> DataFrame:
    """Counts of each change, the score from 0 to 100, and its severity."""
    counted = comparison.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(~F.col("in_baseline")).alias("added"), F.count_if(~F.col("in_new")).alias("removed"),
        F.count_if("dtype_changed").alias("type_changes"), F.count_if("null_rate_changed").alias("nullable_changes"),
        F.count_if("range_changed").alias("range_changes"))
    share = F.greatest(F.col("columns"), F.lit(1))
    points = sum((F.col(c) / share * w for c, w in POINTS.items()), F.lit(0.0))
    scored = counted.withColumn("drift_score", F.least(F.bround(points, 1), F.lit(100.0)))
    severity = (F.when(F.col("drift_score") == 0, "none").when(F.col("drift_score") <= LOW, "low")
                .when(F.col("drift_score") <= MEDIUM, "medium").otherwise("critical"))
    return scored.withColumn("severity", severity).drop("columns")


def record_drift(spark: SparkSession, path: str, baseline: tuple[str, str], new: tuple[str, str], score: DataFrame) -> None:
    """Append one comparison, (id, name) of both tables, to the history."""
    s = score.first()
    append_rows(spark, path, HISTORY, [(baseline[0], new[0], baseline[1], new[1], s.drift_score, s.severity, now())])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, HISTORY)


def drift_history(history: DataFrame, dataset_id) -> DataFrame:
    """Comparisons in which a dataset took part, newest first."""
    return history.filter((F.col("baseline_id") == dataset_id) | (F.col("new_id") == dataset_id)).orderBy(F.desc("compared_at"))
