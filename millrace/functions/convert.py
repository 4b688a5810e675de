"""Lenient conversions: what does not convert becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
# What a text must look like before it is parsed by a format; a failed parse is slow.
_TIME_FORMATS = {
    "M/d/yyyy HH:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d\d:\d\d:\d\d$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d HH:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d\d:\d\d:\d\d$", "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}


def to_double(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.nanvl(c.cast("double"), F.lit(None))
    return F.lit(None).cast("double")


def to_long(c: Column, dtype: T.DataType) -> Column:
    """Whole numbers only: a fraction has no place in a whole-number column."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("bigint")
    number = to_double(c, dtype)
    through_double = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(c.try_cast("bigint"), through_double) if isinstance(dtype, T.StringType) else through_double


def to_timestamp(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(c.try_cast("timestamp"), *[
            F.when(c.rlike(looks), F.try_to_timestamp(c, F.lit(f))) for f, looks in _TIME_FORMATS.items()])
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c if not isinstance(dtype, T.DateType) else c.cast("timestamp")
    if isinstance(dtype, T.NumericType):  # a bare number counts nanoseconds since 1970
        return F.timestamp_micros((c / 1000).try_cast("bigint"))
    return F.lit(None).cast("timestamp")


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    """Truth of a value: non-zero numbers and non-empty texts."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.NumericType):
        return c != 0
    return F.length(c.cast("string")) > 0


def constant(value, dtype: T.DataType) -> Column | None:
    """The value as the column's type, or None where it does not convert."""
    if value is None:
        return None
    text = str(value)
    if isinstance(dtype, T.StringType):
        return F.lit(text)
    try:
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            number = float(value)
            return F.lit(int(value) if isinstance(value, int) else int(number)).cast(dtype) if number == int(number) else None
        if isinstance(dtype, T.NumericType):
            return F.lit(float(value)).cast(dtype)
    except (TypeError, ValueError, OverflowError):
        return None
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) and not isinstance(value, (int, float, bool)):
        import pandas as pd

        moment = pd.to_datetime(text, errors="coerce")
        return None if moment is pd.NaT else F.lit(moment.isoformat()).cast(dtype)
    return None
