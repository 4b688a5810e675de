"""Questions one asks of a table, each as a small query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import col, numeric_columns
from ..functions.ordered import group_quantiles
from ..functions.stats import value
from .profile import pearson


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns."""
    cols = numeric_columns(df, columns)
    got = stats.moments(df, cols)
    quarts = stats.quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, got[c]["n"], *[None if x is None else float(x) for x in (
        got[c]["mean"], got[c]["std"], got[c]["min"], *quarts[c], got[c]["max"])]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def total_of(df: DataFrame, column: str, fn: str, by: str | None = None) -> DataFrame:
    """mean, sum, min, max or median of a column, for the table or per group."""
    if fn == "median" and by is not None:
        found = group_quantiles(df.dropna(subset=[by]), [by], column, [0.5])
        every = df.dropna(subset=[by]).select(col(by)).distinct().join(
            found.withColumnsRenamed({by: "_by"}), col(by).eqNullSafe(F.col("_by")), "left")
        return every.select(col(by), F.col("quantiles")[0].alias("median")).orderBy(col(by))
    if fn == "median":
        return df.sparkSession.createDataFrame([(stats.quantiles(df, [column], [0.5])[column][0],)], "median double")
    made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[fn](value(df, column)).alias(fn)
    if by is None:
        return df.agg(made)
    return df.dropna(subset=[by]).groupBy(col(by)).agg(made).orderBy(col(by))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def shape(df: DataFrame) -> DataFrame:
    return row_count(df).withColumn("cols", F.lit(len(df.columns)).cast("bigint"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counted = df.filter(value(df, column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), col(column))


group_size = value_counts


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(value(df, column).alias(column)).distinct()


def correlation_of(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(pearson(value(df, a), value(df, b)).alias("r"))


def missing_counts(df: DataFrame, column: str | None = None) -> DataFrame:
    _, nulls = stats.null_counts(df, [column] if column else None)
    return df.sparkSession.createDataFrame(list(nulls.items()), "column string, missing bigint")


def sort_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last())


def top(df: DataFrame, column: str, n: int = 5, then_by: list[str] | None = None) -> DataFrame:
    return df.orderBy(col(column).desc_nulls_last(), *[col(c) for c in then_by or []]).limit(n)


def bottom(df: DataFrame, column: str, n: int = 5, then_by: list[str] | None = None) -> DataFrame:
    return df.orderBy(col(column).asc_nulls_last(), *[col(c) for c in then_by or []]).limit(n)


def head(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def tail(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(c).desc() for c in order_by]).limit(n)


def newest(df: DataFrame, time: str, n: int = 50, then_by: list[str] | None = None) -> DataFrame:
    return df.orderBy(col(time).desc_nulls_last(), *[col(c) for c in then_by or []]).limit(n)
