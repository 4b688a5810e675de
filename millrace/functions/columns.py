"""Column names, kinds and expressions that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, DATETIME, CATEGORICAL = "numeric", "datetime", "categorical"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    return DATETIME if isinstance(dtype, _TIMES) else CATEGORICAL


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, _WHOLE)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema}


def present(df: DataFrame, wanted: list[str] | None) -> list[str]:
    """The wanted columns the table has; all of its columns if none are named."""
    if not wanted:
        return df.columns
    if isinstance(wanted, str):
        wanted = [wanted]
    have = set(df.columns)
    return [c for c in dict.fromkeys(wanted) if c in have]


def numeric_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    by_name = kinds(df)
    return [c for c in present(df, wanted) if by_name[c] == NUMERIC]


def string_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema}
    return [c for c in present(df, wanted) if isinstance(types[c], (T.StringType, T.VarcharType, T.CharType))]


def flat(df: DataFrame, name: str) -> Column:
    """The column as something that can be grouped: nested values as JSON text."""
    return F.to_json(col(name)) if is_nested(df.schema[name].dataType) else col(name)


def refuse_case_twins(names: list[str]) -> None:
    """Spark resolves names without regard to case, so `A` beside `a` cannot work."""
    seen: dict[str, str] = {}
    for name in names:
        other = seen.setdefault(name.lower(), name)
        if other != name:
            raise ValueError(f"columns {other!r} and {name!r} differ only by case")
    if len(set(names)) != len(names):
        raise ValueError(f"column names repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")


def snake_case(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def word_name(name: str) -> str:
    """Lower case with every run of other characters as one underscore."""
    return re.sub(r"\W+", "_", name.lower())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number is the missing marker of floating columns; Spark's is NULL."""
    floating = {f.name for f in df.schema if is_floating(f.dataType)}
    if not floating:
        return df
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floating else col(c) for c in df.columns])


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps the order."""
    if not new:
        return df
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
