"""Read tables by format, leniently where the files are hand-made."""

from __future__ import annotations

import csv
import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..functions.columns import col, nan_to_null, refuse_case_twins
from ..functions.stats import measure
from .records import is_one_value, one_per_line, text_lines, whole_values
from .scratch import scratch_path

# Cell texts that stand for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_DELIMITERS = (",", "\t", ";", "|")
_UNEVEN = "_uneven_row"
_SMALL_FILE = 32 << 20  # bytes that a task may hold as one text


def _split_header(line: str, sep: str, quote: str = '"') -> list[str]:
    return next(csv.reader([line], delimiter=sep, quotechar=quote), [])


def sniff_delimiter(line: str, default: str = "\t") -> str:
    """The delimiter that splits the line into most fields, quotes respected."""
    fields = {sep: len(_split_header(line, sep)) for sep in _DELIMITERS}
    best = max(fields, key=lambda sep: (fields[sep], sep == default))
    return best if fields[best] > 1 else default


def _layouts(spark: SparkSession, path) -> list[tuple[str, bool, list[str]]]:
    """(first line, whether a record goes over several lines, files) of each kind of file, from one pass over the lines."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    files = lines.groupBy("file").agg(
        F.min_by("value", F.when(F.trim("value") != "", F.col("at"))).alias("first"), F.max(quotes % 2 == 1).alias("open"))
    found: dict[tuple[str, bool], list[str]] = {}
    for r in files.orderBy("file").collect():  # one row per file, as in the listing
        if r.first is not None:
            found.setdefault((r.first.lstrip("\ufeff").rstrip("\r"), r.open), []).append(unquote(r.file))
    return [(first, many, names) for (first, many), names in found.items()]


def _header_names(raw: list[str]) -> list[str]:
    names, seen = [], {}
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def _cells(spark: SparkSession, path, header: str, sep: str | None, multi_line: bool) -> DataFrame:
    """Cells of files with one header as text, under the header's names."""
    sep = sep or sniff_delimiter(header)
    if multi_line and header.count('"') % 2:
        raise ValueError("the header goes over several lines")
    names = _header_names(_split_header(header, sep))
    refuse_case_twins(names)
    slots = [f"c{i}" for i in range(len(names))]
    text_schema = T.StructType([T.StructField(c, T.StringType()) for c in [*slots, _UNEVEN]])
    raw = (spark.read.schema(text_schema).option("header", True).option("sep", sep).option("multiLine", multi_line)
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _UNEVEN).option("enforceSchema", True).csv(path))
    # The reader marks rows of another length and gives their text; the short ones stay.
    unquoted = F.regexp_replace(_UNEVEN, r'"([^"]|"")*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    first = F.col("c0")  # a test has to name a real column too, or a count would read only the mark
    kept = raw.filter((F.col(_UNEVEN).isNull() | (fields <= len(slots))) & (first.isNull() | (F.length(first) >= 0)))
    return kept.select(*[F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)).alias(n) for c, n in zip(slots, names)])


def read_delimited(spark: SparkSession, path, sep: str | None = ",", infer: bool = True,
                   schema: T.StructType | str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Header files: rows with too many fields are left out, short rows are padded with null.

    Files of a folder may differ in header: columns are matched by name, and one
    that a file lacks is null there.  With `infer`, columns become bigint,
    double, boolean or text from one counting pass; dates stay text.  Files are
    split among tasks unless some of their records goes over several lines
    (`multi_line=None` looks for that, file by file).
    """
    layouts = _layouts(spark, path)
    parts = [_cells(spark, files if len(layouts) > 1 else path, header, sep, open_ if multi_line is None else multi_line)
             for header, open_, files in layouts]
    if not parts:
        return spark.createDataFrame([], schema or T.StructType([]))
    by_name = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = by_name.columns
    refuse_case_twins(names)
    slots = [f"c{i}" for i in range(len(names))]
    cells = by_name.toDF(*slots)
    if schema is not None:
        given = spark.createDataFrame([], schema).schema
        types = {c: f.dataType.simpleString() for c, f in zip(slots, given)}
        names = given.names
    else:
        types = _infer(cells, slots) if infer else dict.fromkeys(slots, "string")
    return cells.select(*[_as(c, types[c]).alias(n) for c, n in zip(slots, names)])


def read_by_header(spark: SparkSession, files: list[str], sep: str | None = ",") -> list[tuple[list[str], DataFrame | Exception]]:
    """Header files, those with one header read together: (files, table with `file_name`), or the error in place of the table.

    The number of jobs follows the headers, not the files. Where files cannot
    be read together each is read alone, so that only those at fault have an
    error. A file without a header line is at fault.
    """
    found = _layouts(spark, files)
    known = {file_name(f) for _, _, some in found for f in some}
    out: list[tuple[list[str], DataFrame | Exception]] = [([f], ValueError("no header line")) for f in files if file_name(unquote(f)) not in known]
    todo = list(reversed(found))
    while todo:
        header, open_, some = todo.pop()
        try:
            cells = _cells(spark, some, header, sep, open_)
            names, slots = cells.columns, [f"c{i}" for i in range(len(cells.columns))]
            cells = cells.toDF(*slots)
            types = _infer(cells, slots)
            out.append((some, with_file_name(cells.select(*[_as(c, types[c]).alias(n) for c, n in zip(slots, names)]))))
        except Exception as e:  # noqa: BLE001 - the other files go on
            if len(some) == 1:
                out.append((some, e))
            else:
                todo += [(header, open_, [f]) for f in reversed(some)]
    return out


def _as(slot: str, type_name: str) -> Column:
    c = F.col(slot)
    if type_name == "bigint":
        return F.trim(c).try_cast("bigint")
    if type_name == "double":
        return F.nanvl(convert.to_double(c, T.StringType()), F.lit(None))
    return c if type_name == "string" else F.trim(c).try_cast(type_name)


def _infer(cells: DataFrame, slots: list[str]) -> dict[str, str]:
    """bigint needs every cell present, as a missing one makes a number column floating."""
    tests = {None: F.count(F.lit(1))}
    for c in slots:
        v = F.col(c)
        tests |= {
            (c, "n"): F.count(v),
            (c, "long"): F.count(F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("bigint"))),
            (c, "double"): F.count(convert.to_double(v, T.StringType())),
            (c, "bool"): F.count_if(v.isin("True", "TRUE", "true", "False", "FALSE", "false")),
        }
    got = measure(cells, tests, fields=1)
    out = {}
    for c in slots:
        n, whole = got[c, "n"], got[None] == got[c, "n"]
        if n == 0:
            out[c] = "double"
        elif got[c, "long"] == n and whole:
            out[c] = "bigint"
        elif got[c, "double"] == n:
            out[c] = "double"
        elif got[c, "bool"] == n and whole:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def read_csv_spark(spark: SparkSession, path) -> DataFrame:
    """Spark's own reader with header and inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path, schema=None, by_line: bool | None = None) -> DataFrame:
    """A top-level array gives one row per element, an object one row.

    Files with one value on each line are read as they are. In others values
    are told by their brackets, so that they may go over several lines, follow
    one another on a line or be the elements of one array; they are written
    once, one to a line, and read from there (so `_metadata` names that file). Neither kind needs a file in one
    task. What is no value stays as a row, with its text in `_corrupt_record`.
    `by_line` says that all files (True) or no files (False: each is one
    document) have a value on each line.
    """
    if by_line is not None:
        return _read_json(spark, path, by_line, schema)
    lines = text_lines(spark, path)
    kinds = lines.groupBy("file").agg(F.min(is_one_value(F.col("value"))).alias("plain")).orderBy("file").collect()  # one row per file, as in the listing
    plain, other = ([unquote(r.file) for r in kinds if r.plain == is_plain] for is_plain in (True, False))
    if other:
        made = scratch_path(spark, "values")
        # Small files are each told apart as one text, without a shuffle; those that are not all values, and large ones, by lines.
        left = whole_values(spark, other if plain else path, _SMALL_FILE, made)
        if left:
            one_per_line(text_lines(spark, [unquote(f) for f in left])).write.mode("append").text(made)
        plain.append(made)
    found = _read_json(spark, plain or path, True, schema)
    if found.columns == ["_corrupt_record"]:  # Spark does not answer with nothing but broken lines
        return text_lines(spark, plain).select(F.col("value").alias("_corrupt_record"))
    return found


def _read_json(spark: SparkSession, path, by_line: bool, schema) -> DataFrame:
    reader = spark.read.option("multiLine", not by_line)
    schema = schema or (None if by_line else _document_schema(spark, path))
    return (reader.schema(schema) if schema else reader).json(path)


def _document_schema(spark: SparkSession, path) -> T.StructType | None:
    """The schema that Spark infers for files of one document each.

    Its own pass puts all files of 128 MB together into one task, so that
    thousands of small ones queue up there. They are read as texts here, which
    are dealt out file by file. Files over 32 MB, and those with a text that is
    not UTF-8 or broken, are left to Spark's pass (None).
    """
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if largest is None or largest > _SMALL_FILE:
        return None
    texts = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    found = spark.read.json(texts.rdd.map(lambda r: r.value)).schema
    return None if not found or "_corrupt_record" in found.names else found


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in os.path.basename(path.rstrip("/")) else ""


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, use_spark: bool = False,
                 unknown: str = "error", nan_as_null: bool = True) -> DataFrame:
    """Read a file or folder by its suffix.

    `unknown` decides about other suffixes: an error, or a delimiter sniffed
    from the first line.
    """
    fmt = (fmt or suffix(path)).lower()
    if fmt == "csv":
        return read_csv_spark(spark, path) if use_spark else read_delimited(spark, path)
    if fmt in ("tsv", "txt"):
        return read_delimited(spark, path, sep=None)
    if fmt == "json":
        return _read_json(spark, path, False, None) if use_spark else read_json(spark, path)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return nan_to_null(df) if nan_as_null else df
    if unknown == "sniff":
        return read_delimited(spark, path, sep=None)
    raise ValueError(f"unsupported format: .{fmt}")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the catalogue."""
    return spark.table(name)


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("csv", "json", "tsv")) -> list[str]:
    """The data files of a raw folder, in name order; their content is not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return [r.path for r in listing.select("path").orderBy("path").collect()]


def read_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("csv", "json", "tsv")) -> dict[str, DataFrame]:
    """The data files of a folder, those of one suffix as one table.

    Columns and types follow from all files of a suffix, so that a file
    without rows, or without a value in some column, decides nothing. The number
    of jobs follows the headers, not the files.
    """
    kinds: dict[str, list[str]] = {}
    for path in list_files(spark, folder, suffixes):
        kinds.setdefault(suffix(path), []).append(path)
    readers = {"csv": read_delimited, "tsv": lambda s, some: read_delimited(s, some, sep=None), "json": read_json}
    return {kind: readers[kind](spark, some) for kind, some in kinds.items()}


def file_name(path: str) -> str:
    return re.sub(r"^.*/", "", path)


def require_rows(df: DataFrame) -> DataFrame:
    """Refuse an empty table."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def extract_report(df: DataFrame, fmt: str, engine: str = "spark") -> DataFrame:
    """Rows, columns and format of what was read."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("cols"), F.lit(fmt).alias("format"), F.lit(engine).alias("engine"))


def with_file_name(df: DataFrame) -> DataFrame:
    """The name of each row's file before its columns, as it is in the folder."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select(name.alias("file_name"), *[col(c) for c in df.columns])
