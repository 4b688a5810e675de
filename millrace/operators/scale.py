"""Bring numeric columns to a common scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, replace_columns
from ..functions.stats import measure, value


def fit_scale(df: DataFrame, method: str, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """(offset, width) per column; constant and empty columns are left out."""
    cols = numeric_columns(df, columns)
    if not cols:
        return {}
    v = {c: value(df, c).cast("double") for c in cols}
    if method == "normalize":
        got = measure(df, {**{(c, 0): F.min(v[c]) for c in cols}, **{(c, 1): F.max(v[c]) for c in cols}}, fields=1)
        return {c: (got[c, 0], got[c, 1] - got[c, 0]) for c in cols if got[c, 0] is not None and got[c, 1] != got[c, 0]}
    got = measure(df, {**{(c, 0): F.avg(v[c]) for c in cols}, **{(c, 1): F.stddev_samp(v[c]) for c in cols}})
    return {c: (got[c, 0], got[c, 1]) for c in cols if got[c, 1]}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {
        c: (value(df, c).cast("double") - F.lit(offset)) / F.lit(width)
        for c, (offset, width) in fitted.items() if c in df.columns})


def normalize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Smallest value to 0, largest to 1; nulls stay, constant columns are untouched."""
    return apply_scale(df, fit_scale(df, "normalize", columns))


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distance from the mean in sample deviations; constant columns are untouched."""
    return apply_scale(df, fit_scale(df, "standardize", columns))
