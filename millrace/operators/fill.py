"""Fill missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..functions.columns import NUMERIC, col, is_nested, is_whole, kinds, present, replace_columns
from ..functions.ordered import carry_values
from ..functions.stats import ROW_LIMIT, measure, modes, null_counts, quantiles, value

UNKNOWN = "Unknown"


def fit_fill(df: DataFrame, strategy: str = "median", columns: list[str] | None = None, value_=None,
             only_missing: bool = True, row_limit: int = ROW_LIMIT) -> dict:
    """What each column's nulls become.

    Columns without nulls are left out, unless the result is meant for rows that
    are still to come (`only_missing=False`).
    """
    cols = present(df, columns)
    known = None
    if only_missing:
        total, nulls = null_counts(df, cols)
        cols = [c for c in cols if nulls[c]]
        known = {c: total - nulls[c] for c in cols}
    numeric = [c for c in cols if kinds(df)[c] == NUMERIC]
    whole = [] if only_missing else _complete_whole(df, numeric)
    others = [c for c in cols if c not in numeric]
    if strategy == "median":
        found = {c: q[0] for c, q in quantiles(df, numeric, [0.5], row_limit, known).items()}
        return {**_keep_whole(found, whole), **dict.fromkeys(others, UNKNOWN)}
    if strategy == "mean":
        found = measure(df, {c: F.avg(value(df, c).cast("double")) for c in numeric}) if numeric else {}
        return {**_keep_whole(found, whole), **dict.fromkeys(others, UNKNOWN)}
    if strategy == "mode":
        found = modes(df, [c for c in cols if not is_nested(df.schema[c].dataType)])
        return {c: UNKNOWN if v is None else v for c, v in found.items()}
    if strategy == "constant":
        return dict.fromkeys(cols, UNKNOWN if value_ is None else value_)
    return dict.fromkeys(cols, UNKNOWN)


def _complete_whole(df: DataFrame, cols: list[str]) -> list[str]:
    """Whole-number columns without nulls: they keep their type."""
    whole = [c for c in cols if is_whole(df.schema[c].dataType)]
    return [c for c, n in null_counts(df, whole)[1].items() if not n] if whole else []


def _keep_whole(found: dict, whole: list[str]) -> dict:
    return {c: round(v) if c in whole and v is not None else v for c, v in found.items()}


def apply_fill(df: DataFrame, fitted: dict, strategy: str = "median") -> DataFrame:
    """Replace nulls by fitted values; a value that is not of the column's type is skipped."""
    new = {}
    for c, v in fitted.items():
        if c not in df.columns or v is None:
            continue
        dtype = df.schema[c].dataType
        filled = value(df, c)
        if strategy in ("median", "mean") and isinstance(dtype, T.NumericType) and not isinstance(v, int):
            new[c] = F.coalesce(filled.cast("double"), F.lit(float(v)))
            continue
        literal = F.lit(v).cast(dtype) if strategy == "mode" and v != UNKNOWN else convert.constant(v, dtype)
        if literal is not None:
            new[c] = F.coalesce(filled, literal.cast(dtype))
    return replace_columns(df, new)


def fill_missing(df: DataFrame, strategy: str = "median", columns: list[str] | None = None, value=None,
                 order_by: list[str] | None = None, partition_by: list[str] | None = None,
                 ranges: int | None = None) -> DataFrame:
    """Fill nulls by median, mean, mode, constant, or the neighbouring row.

    `ffill` and `bfill` need `order_by`, since a Spark table has no row order;
    it should name the rows uniquely.
    """
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by")
        keys = partition_by or []
        cols = [c for c in present(df, columns) if c not in {*order_by, *keys}]
        return carry_values(df, keys, order_by, cols, backward=strategy == "bfill", ranges=ranges)
    return apply_fill(df, fit_fill(df, strategy, columns, value), strategy)


def fill_by_type(df: DataFrame) -> DataFrame:
    """Numbers by their median; texts by a mark, then stripped."""
    return apply_by_type(df, fit_by_type(df))


def fit_by_type(df: DataFrame, only_missing: bool = True) -> dict:
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    return fit_fill(df, "median", cols, only_missing=only_missing) if cols else {}


def apply_by_type(df: DataFrame, fitted: dict) -> DataFrame:
    from .shape import trim_strings

    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    return trim_strings(apply_fill(df, fitted, "median")) if cols else df


def fill_report(df: DataFrame, strategy: str = "median", columns: list[str] | None = None, value=None) -> DataFrame:
    """How many cells of each column the fill replaces."""
    total, nulls = null_counts(df, present(df, columns))
    fitted = fit_fill(df, strategy, columns, value)
    able = {c for c, v in fitted.items() if v is not None and _fillable(df, c, v, strategy)}
    rows = [(c, strategy, n if c in able else 0) for c, n in nulls.items()]
    return df.sparkSession.createDataFrame(rows, "column string, strategy string, filled bigint")


def _fillable(df: DataFrame, c: str, v, strategy: str) -> bool:
    dtype = df.schema[c].dataType
    if strategy in ("median", "mean", "mode") and v != UNKNOWN:
        return True
    return convert.constant(v, dtype) is not None
