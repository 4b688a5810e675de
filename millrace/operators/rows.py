"""Steps that keep or drop rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.columns import col, flat, is_floating, is_nested, numeric_columns
from ..functions.stats import measure, moments, quantiles
from ..functions.stats import value as value_of


def _comparable(df: DataFrame, name: str, wanted, convert: bool = False) -> Column | None:
    """The value as a literal that compares with the column, if there is one."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        if isinstance(wanted, str) and not convert:
            return None
        try:
            if isinstance(wanted, str):
                wanted = int(wanted) if re.fullmatch(r"\s*[+-]?\d+\s*", wanted) else float(wanted)
            return F.lit(wanted if isinstance(wanted, (int, float)) else float(wanted))
        except (TypeError, ValueError):
            return None
    if isinstance(dtype, T.StringType):
        return F.lit(wanted) if isinstance(wanted, str) else None
    return F.lit(wanted).cast(dtype)


def filter_rows(df: DataFrame, column: str | None = None, operator: str | None = None, value=None,
                condition: str | None = None) -> DataFrame:
    """Keep rows by a test on one column; an unknown column or test keeps all.

    `neq` keeps nulls; every other comparison drops them.
    """
    test = operator or condition
    if not column or column not in df.columns:
        return df
    c = col(column)
    if test in ("gt", "gte", "lt", "lte"):
        limit = _comparable(df, column, value, convert=True)
        if limit is None:
            raise ValueError(f"{column!r} does not compare with {value!r}")
        kept = df.filter({"gt": c > limit, "gte": c >= limit, "lt": c < limit, "lte": c <= limit}[test])
        # Not-a-number is above everything, yet passes no comparison.
        return kept.filter(~F.isnan(c)) if test in ("gt", "gte") and is_floating(df.schema[column].dataType) else kept
    if test == "eq":
        wanted = _comparable(df, column, value)
        return df.filter(F.lit(False) if wanted is None else c == wanted)
    if test == "neq":
        wanted = _comparable(df, column, value)
        return df if wanted is None else df.filter(~c.eqNullSafe(wanted))
    if test == "contains":
        return df.filter(text.found_in(c, str(value)))
    if test == "not_null":
        return df.filter(c.isNotNull())
    if test == "is_null":
        return df.filter(c.isNull())
    return df


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    if columns and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"columns not found: {missing}")
    return df.dropna(how="any", subset=columns or None)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One copy of each row, or of each key; nulls equal each other.

    With a subset, `order_by` says which row of a key comes first; without it
    any one row of the key stays.  The window keeps one row per key in every
    task before it shuffles, so many copies of one key do not meet in one task.
    """
    if subset and (missing := [c for c in subset if c not in df.columns]):
        raise ValueError(f"columns not found: {missing}")
    if not subset:
        nested = [f.name for f in df.schema if is_nested(f.dataType)]
        return df.dropDuplicates() if not nested else _distinct_by_text(df)
    if not order_by:
        return df.dropDuplicates(subset)
    first = W.partitionBy(*[col(c) for c in subset]).orderBy(*[col(c) for c in order_by])
    return df.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


def _distinct_by_text(df: DataFrame) -> DataFrame:
    keys = [flat(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    kept = df.groupBy(*keys).agg(F.first(F.struct(*[col(c) for c in df.columns])).alias("row"))
    return kept.select("row.*")


def latest_per_name(df: DataFrame, name: str, newest_by: list[str]) -> DataFrame:
    """The newest row of each name, names compared without case and outer blanks."""
    key = F.lower(text.strip(F.coalesce(col(name), F.lit(""))))
    newest = W.partitionBy("_key").orderBy(*[col(c).desc_nulls_last() for c in newest_by])
    return (df.withColumn("_key", key).withColumn("_first", F.row_number().over(newest))
            .filter("_first = 1").drop("_first", "_key"))


def outlier_bounds(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                   threshold: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """Per numeric column the inclusive range of values to keep."""
    cols = numeric_columns(df, columns)
    if method == "iqr":
        out = {}
        for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75]).items():
            out[c] = (None, None) if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return out
    if method == "zscore":
        got = measure(df, {**{(c, "mean"): F.avg(value_of(df, c)) for c in cols},
                           **{(c, "std"): F.stddev_samp(value_of(df, c)) for c in cols}})
        return {c: (got[c, "mean"], got[c, "std"]) for c in cols}
    return {}


def keep_within(df: DataFrame, fitted: dict, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Keep rows whose every measured column is inside its range.

    A null passes the quartile test; in the deviation test it does not.
    """
    for c, (a, b) in fitted.items():
        if c not in df.columns:
            continue
        if method == "iqr":
            low, high = (a, b) if a is None or not isinstance(df.schema[c].dataType, T.IntegralType) else (math.ceil(a), math.floor(b))
            v = value_of(df, c)
            # Whole bounds for whole numbers need no cast and reach the scan.  Not-a-number is above every
            # lower bound, which so stays a bare comparison; the upper one has to let it pass.
            inside = v.isNull() if a is None else ((col(c) >= F.lit(low)) | col(c).isNull()) & ((v <= F.lit(high)) | v.isNull())
        else:
            inside = F.lit(False) if a is None or not b else F.abs((value_of(df, c) - F.lit(a)) / F.lit(b)) <= threshold
        df = df.filter(inside)
    return df


def remove_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                    threshold: float = 1.5) -> DataFrame:
    threshold = float(threshold)
    return keep_within(df, outlier_bounds(df, columns, method, threshold), method, threshold)


def rows_where(df: DataFrame, column: str, sign: str, number: float) -> DataFrame:
    """Rows above, below or at a number."""
    c, n = col(column), F.lit(number)
    return df.filter({">": c > n, "<": c < n, "==": c == n}[sign])


def since(log: DataFrame, run_id, since_id: int, run: str = "run_id", id: str = "id") -> DataFrame:
    """Log rows of one run after the last id that was seen, in order."""
    return log.filter((col(run) == run_id) & (col(id) > since_id)).orderBy(col(id))


def search_catalogue(table: DataFrame, category: str | None = None, q: str | None = None,
                     name: str = "name", description: str = "description", tags: str = "tags",
                     category_column: str = "category") -> DataFrame:
    """Entries of a category whose name, description or any tag contains the text."""
    if category:
        table = table.filter(col(category_column) == category)
    if q:
        sought = F.lit(q.lower())
        in_tags = F.exists(col(tags), lambda tag: F.contains(tag, sought))
        table = table.filter(F.contains(F.lower(col(name)), sought) | F.contains(F.lower(col(description)), sought) | in_tags)
    return table
