"""Columns that look like personal data, by name and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.columns import col, flat
from .profile import sample_values

FINDING = "column string, pii_type string, confidence string, match_count bigint"

# Parts of a column name that give it away, and the shares that flag and confirm.
NAME_PARTS = ("name", "email", "phone", "ssn", "mobile", "address", "birth")
FLAGGED, CONFIRMED = 0.3, 0.7


def sensitive_columns(df: DataFrame, sample: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Findings, at most one per column: its name, or the first pattern that enough values start with.

    The whole column is tested, in one pass for all columns and patterns;
    `sample` limits the test to the first non-null values by `order_by`.
    """
    spoken = [c for c in df.columns if any(part in c.lower() for part in NAME_PARTS)]
    others = [c for c in df.columns if c not in spoken]

    def tests(source: DataFrame, c: str) -> dict:
        shown = flat(source, c).cast("string")
        return {(c, None): F.count(shown), **{
            (c, kind): F.count_if(F.coalesce(text.starts_with_match(shown, pattern), F.lit(False)))
            for kind, pattern in text.SENSITIVE_PATTERNS.items()}}

    got = {}
    if sample is None:
        got = stats.measure(df, {k: v for c in others for k, v in tests(df, c).items()}) if others else {}
        spoken_n = stats.null_counts(df, spoken) if spoken else (0, {})
        named = {c: spoken_n[0] - spoken_n[1][c] for c in spoken}
    else:
        if not order_by:
            raise ValueError("a sample needs order_by")
        first = sample_values(df, order_by, sample)
        hits = [F.count_if(F.coalesce(text.starts_with_match(F.col("value"), p), F.lit(False))).alias(kind)
                for kind, p in text.SENSITIVE_PATTERNS.items()]
        found = {r["column"]: r for r in first.groupBy("column").agg(F.count("value").alias("n"), *hits).collect()}
        named = {c: found[c].n if c in found else 0 for c in spoken}
        for c in others:
            got |= {(c, None): found[c].n if c in found else 0,
                    **{(c, kind): found[c][kind] if c in found else 0 for kind in text.SENSITIVE_PATTERNS}}
    rows = []
    for c in df.columns:
        if c in named:
            rows.append((c, "name_based", "high", named[c]))
            continue
        for kind in text.SENSITIVE_PATTERNS:
            if got[c, kind] > got[c, None] * FLAGGED:
                rows.append((c, kind, "high" if got[c, kind] > got[c, None] * CONFIRMED else "medium", got[c, kind]))
                break
    return df.sparkSession.createDataFrame(rows, FINDING)


def pattern_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column start with each kind of sensitive text."""
    got = stats.measure(df, {(c, kind): F.count_if(F.coalesce(text.starts_with_match(col(c), p), F.lit(False)))
                             for c in columns for kind, p in text.SENSITIVE_PATTERNS.items()})
    return df.sparkSession.createDataFrame([(c, k, n) for (c, k), n in got.items()],
                                           "column string, pii_type string, match_count bigint")


def risk_level(findings: DataFrame, columns_scanned: int) -> DataFrame:
    n = F.count(F.lit(1))
    return findings.agg(n.alias("pii_count")).select(
        "pii_count", F.when(F.col("pii_count") > 2, "high").when(F.col("pii_count") > 0, "medium").otherwise("low").alias("risk_level"),
        F.lit(columns_scanned).cast("bigint").alias("columns_scanned"))
