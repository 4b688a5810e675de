"""Steps that change which columns there are, and their names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert, text
from ..functions.columns import (
    col, is_floating, is_whole, present, refuse_case_twins, replace_columns, snake_case, string_columns, word_name,
)
from ..functions.stats import null_counts


def drop_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    gone = set(columns or [])
    return df.select(*[col(c) for c in df.columns if c not in gone])


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    mapping = mapping or {}
    names = [mapping.get(c, c) for c in df.columns]
    refuse_case_twins(names)
    return df.toDF(*names)


def snake_case_columns(df: DataFrame) -> DataFrame:
    names = [snake_case(c) for c in df.columns]
    refuse_case_twins(names)
    return df.toDF(*names)


def cast_types(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Convert columns; a value that does not convert becomes null."""
    new = {}
    for name, wanted in (mapping or {}).items():
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType
        if wanted in ("int", "integer", "int64"):
            new[name] = convert.to_long(col(name), dtype)
        elif wanted in ("float", "float64"):
            new[name] = convert.to_double(col(name), dtype)
        elif wanted in ("str", "string"):
            new[name] = col(name).cast("string")
        elif wanted == "datetime":
            new[name] = convert.to_timestamp(col(name), dtype)
        elif wanted in ("bool", "boolean"):
            new[name] = convert.to_boolean(col(name), dtype)
    return replace_columns(df, new)


def derive_column(df: DataFrame, name: str = "new_col", expression: str = "") -> DataFrame:
    """A column from a Spark SQL expression over the row."""
    return df.withColumn(name, F.expr(expression)) if name and expression else df


def bucket_column(df: DataFrame, name: str, column: str, cuts: list[tuple[float, str]], otherwise: str) -> DataFrame:
    """The label of the first cut that the value is above, in the given order."""
    made: Column | None = None
    for above, label in cuts:
        test = col(column) > above
        made = F.when(test, label) if made is None else made.when(test, label)
    return df.withColumn(name, F.lit(otherwise) if made is None else made.otherwise(otherwise))


def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return replace_columns(df, {c: text.strip(col(c)) for c in string_columns(df, columns)})


def sparse_columns(df: DataFrame, above: float, inclusive: bool = False) -> list[str]:
    """Columns whose null share is above a limit (or at it), from one counting pass."""
    total, nulls = null_counts(df)
    shares = {c: n / total for c, n in nulls.items()} if total else {}
    return [c for c, share in shares.items() if share > above or (inclusive and share == above)]


def drop_missing(df: DataFrame, threshold_pct: float = 50) -> DataFrame:
    """Drop columns with more than this percentage of nulls."""
    return drop_columns(df, sparse_columns(df, threshold_pct / 100))


def drop_high_null(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return drop_columns(df, sparse_columns(df, threshold))


def keep_low_null(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Keep columns strictly below this null share."""
    return drop_columns(df, sparse_columns(df, threshold, inclusive=True))


def repartition(df: DataFrame, partitions: int = 4) -> DataFrame:
    return df.repartition(partitions)


def passthrough(df: DataFrame) -> DataFrame:
    return df


def preview(df: DataFrame, rows: int = 100, columns: int | None = 25, order_by: list[str] | None = None) -> DataFrame:
    """First rows and columns as text, nulls as empty text."""
    top = df.orderBy(*[col(c) for c in order_by]).limit(rows) if order_by else df.limit(rows)
    return top.select(*[
        F.coalesce(_as_text(df, c), F.lit("")).alias(c) for c in df.columns[: columns or len(df.columns)]])


def _as_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(col(name)) if nested else col(name).cast("string")


def staging_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, SQL expression, staged name) for the typed staging projection."""
    out = []
    for f in df.schema:
        quoted = "`" + f.name.replace("`", "``") + "`"
        if is_whole(f.dataType):
            made = f"TRY_CAST({quoted} AS INT)"
        elif is_floating(f.dataType):
            made = f"CAST({quoted} AS FLOAT)"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            made = f"CAST({quoted} AS TIMESTAMP)"
        else:
            made = f"TRIM(CAST({quoted} AS STRING))"
        out.append((f.name, made, word_name(f.name)))
    refuse_case_twins([name for _, _, name in out])
    return out


def staging_projection(df: DataFrame) -> DataFrame:
    """Every column cast or trimmed by its type, under a plain lower-case name."""
    return df.selectExpr(*[f"{made} AS `{name}`" for _, made, name in staging_columns(df)])


def staging_model_text(df: DataFrame, name: str, applied: list[str] | None = None) -> dict:
    """The staging projection as SQL and column documentation, to keep under version control."""
    table = word_name(name)
    select = ",\n".join(f"  {made} AS {staged}" for _, made, staged in staging_columns(df))
    docs = "\n".join(f"      - name: {staged}\n        description: \"{c}\"" for c, _, staged in staging_columns(df))
    return {
        "model_name": table,
        "sql": f"-- steps applied before: {', '.join(applied or []) or 'none'}\nSELECT\n{select}\nFROM raw.{table}\n",
        "schema_yaml": f"version: 2\nmodels:\n  - name: {table}\n    columns:\n{docs}\n",
        "columns": df.columns,
    }


def staging_trimmed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns as trimmed text, names lower case with underscores."""
    return df.select(*[
        F.trim(col(c).cast("string")).alias(c.lower().replace(" ", "_")) for c in present(df, columns)])
