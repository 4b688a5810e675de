"""JSON values of files whatever lines they are written over, one value to a line."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import settle

# Possessive, so that Java neither recurses nor goes back over a long string.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def text_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, id, value): the lines of files that are not blank, in the order of (block, id), without byte order mark."""
    value = F.col("value")  # patterns are slow, so only lines that need it go through one, here and below
    line = F.when(value.startswith("\ufeff") | value.endswith("\r"), F.regexp_replace(value, "^\ufeff|\r$", "")).otherwise(value)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), line.alias("value")).filter(F.trim("value") != "")


def _any(text: Column, found: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in found])


def _without(text: Column, letters: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), letters, text)


def _with_brackets(lines: DataFrame) -> DataFrame:
    """The lines with `delta`, the brackets that each opens less those that it closes. No string goes over a line's end."""
    value = F.col("value")
    bare = F.when(_any(value, "[]{}"), F.regexp_replace(value, _STRING, "")).otherwise(F.lit(""))
    lines = lines.withColumn("_bare", bare)  # a column of its own, so that it is made once
    return lines.withColumn("delta", (F.octet_length(_without(F.col("_bare"), "]}")) - F.octet_length(_without(F.col("_bare"), "[{"))).cast("long")).drop("_bare")


def is_one_value(line: Column) -> Column:
    """Whether the line is one object or array.

    The parser stops behind the first value, so the line is parsed as the only
    element of an array that has something behind it.
    """
    whole = F.trim(line)
    parsed = F.try_parse_json(F.concat(F.lit('{"v":['), whole, F.lit('],"e":1}')))
    # The parser is slow on what is no value: it is asked once, and only where the outer brackets are there.
    alone = F.exists(F.array(parsed), lambda p: F.try_variant_get(p, "$.e", "int").isNotNull() & F.try_variant_get(p, "$.v[1]", "variant").isNull())
    bracketed = (whole.startswith("[") & whole.endswith("]")) | (whole.startswith("{") & whole.endswith("}"))
    return F.when(bracketed, alone).otherwise(F.lit(False))


#: More brackets than are open anywhere.
_FAR = 1 << 60


@dataclass(frozen=True)
class _Place:
    """What the lines of a block must know of their file."""

    lines: int
    carry: int  # brackets open before the block
    in_array: bool
    span: int  # the block that the span began in which is open before this one
    closed: int  # the last line of the block that is not behind all closed spans
    first: bool
    last: bool


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """((file, block), its rows); a block is read by one task, in order."""
    def slices():
        for batch in batches:
            if batch.num_rows:
                files, blocks = batch.column("file").to_numpy(), batch.column("block").to_numpy()
                turns = [int(i) + 1 for i in np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0))]
                for a, b in zip([0, *turns], [*turns, batch.num_rows]):
                    yield (int(files[a]), int(blocks[a])), batch.slice(a, b - a)

    for at, rows in groupby(slices(), key=itemgetter(0)):
        yield at, map(itemgetter(1), rows)


def _block_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its lines, the sum of its brackets, the least sum behind a line (of all, and of all but the last) and the last line that has it."""
    for (file, block), parts in _by_block(batches):
        n = total = last_low = 0
        low = low_before_last = _FAR
        opens = False
        for rows in parts:
            opens = rows.column("opens")[0].as_py() if n == 0 else opens
            sums = total + np.cumsum(rows.column("delta").to_numpy())
            low_before_last = min(low, int(sums[:-1].min(initial=_FAR)))
            if sums.min() <= low:
                low, last_low = int(sums.min()), n + len(sums) - 1 - int(sums[::-1].argmin())
            n, total = n + len(sums), int(sums[-1])
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "n": [n], "total": [total], "low": [low],
                                          "low_before_last": [low_before_last], "last_low": [last_low], "opens": [opens]})


def _places(rows: list[Row]) -> dict[tuple[int, int], _Place]:
    """Brackets and spans carried from block to block of each file; closing brackets without an opening one count for nothing."""
    out = {}
    for file, found in groupby(sorted(rows, key=lambda r: (r.file, r.block)), key=lambda r: r.file):
        blocks, carries = list(found), [0]
        for b in blocks:
            carries.append(carries[-1] + b.total - min(0, carries[-1] + b.low))
        closing = [i for i, b in enumerate(blocks) if carries[i] + b.low <= 0]
        end = len(blocks) - 1
        in_array = blocks[0].opens and closing == [end] and carries[end] + blocks[end].low_before_last > 0 and sum(b.n for b in blocks) > 1
        closed = closing[-1] if closing else -1
        span = -1
        for i, b in enumerate(blocks):
            out[file, b.block] = _Place(b.n, carries[i], in_array, span, b.n if i < closed else b.last_low if i == closed else -1, i == 0, i == end)
            span = b.block if carries[i] + b.low <= in_array else span
    if len(out) != len(rows):
        raise RuntimeError("two files have one hash")
    return out


def _with_line(values: pa.Array, at: int, pattern: str) -> pa.Array:
    """The lines, one of them without what the pattern finds."""
    made = pa.array([re.sub(pattern, "", values[at].as_py(), flags=re.ASCII)], values.type)
    return pa.concat_arrays([values[:at], made, values[at + 1:]])


def _block_spans(file: int, block: int, place: _Place, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans inside a block; what it begins and ends with is a part of a span over blocks and says of which (`span`)."""
    def made(texts, closed=True, span=None, at=0):
        same = {"file": (file, pa.int64()), "in_array": (place.in_array, pa.bool_()), "closed": (closed, pa.bool_()),
                "span": (span, pa.int64()), "block": (block, pa.int64()), "at": (at, pa.int64())}
        return pa.RecordBatch.from_pydict({**{c: pa.repeat(pa.scalar(*v), len(texts)) for c, v in same.items()}, "texts": texts})

    def as_one(some):
        texts = pa.concat_arrays(some)
        return pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)

    n = total = start = 0
    low, ended, held = _FAR, False, []
    for rows in parts:
        values, size = rows.column("value"), rows.num_rows
        sums = total + np.cumsum(rows.column("delta").to_numpy())
        lows = np.minimum.accumulate(np.minimum(sums, low))
        depth = place.carry + sums - np.minimum(0, place.carry + lows)
        if place.in_array and place.first and n == 0:
            values = _with_line(values, 0, r"^\s*\[")
        if place.in_array and place.last and n + size == place.lines:
            values = _with_line(values, size - 1, r"\]\s*\Z")
        closed = min(max(place.closed + 1 - n, 0), size)
        ends = np.flatnonzero(depth[:closed] <= place.in_array).astype(np.int32) + 1
        if len(ends):
            yield made(as_one([*held, values[:ends[0]]]), span=None if ended else place.span, at=start)
            yield made(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            ended, held, start = True, [], n + int(ends[-1])
        from_ = int(ends[-1]) if len(ends) else 0
        if from_ < closed:
            held.append(values[from_:closed])
        if closed < size:
            yield made(pa.ListArray.from_arrays(pa.array(np.arange(closed, size + 1), pa.int32()), values), closed=False)
        n, total, low = n + size, int(sums[-1]), int(lows[-1])
    if n != place.lines:
        raise RuntimeError("a file was cut into other blocks in the second pass")
    if held:
        yield made(as_one(held), span=block if ended else place.span, at=start)


def spans(lines: DataFrame) -> DataFrame:
    """(file, in_array, closed, texts) of lines as `text_lines` gives them: what stands between two places at which no bracket is open.

    A file that is one array is taken element by element, so that it need not
    be in one task; `in_array` says so. A span that is never closed is given
    line by line, since no value can be made of it. `file` is the hash of its name.

    Two passes over the lines, in which nothing is shuffled but the parts of
    spans that go over the end of a block: the first gives one row per block,
    from which the brackets open before each block follow.
    """
    lines = _with_brackets(lines).withColumn("file", F.xxhash64("file"))  # the name on every line would cost as much as the rest
    opens = F.startswith(F.ltrim("value"), F.lit("[")).alias("opens")
    sums = lines.select("file", "block", "delta", opens).mapInArrow(
        _block_sums, "file long, block long, n long, total long, low long, low_before_last long, last_low long, opens boolean")
    places = _places(sums.collect())  # one row per block

    def of_blocks(batches):
        for at, parts in _by_block(batches):
            yield from _block_spans(*at, places[at], parts)

    found = lines.select("file", "block", "value", "delta").mapInArrow(
        of_blocks, "file long, in_array boolean, closed boolean, span long, block long, at long, texts array<string>")
    over = found.where("span IS NOT NULL").groupBy("file", "in_array", "span").agg(F.sort_array(F.collect_list(F.struct("block", "at", "texts"))).alias("l"))
    return found.where("span IS NULL").select("file", "in_array", "closed", "texts").union(
        over.select("file", "in_array", F.lit(True).alias("closed"), F.flatten("l.texts").alias("texts")))


_DECODER = json.JSONDecoder(strict=False)


def _values(text: str, decoder: json.JSONDecoder = _DECODER) -> tuple[list[str], str]:
    """The objects and arrays that a text begins with, in any white space and commas, and what is left."""
    found, at = [], 0
    while at < len(text):
        if text[at] in " \t\r\n,":
            at += 1
            continue
        if text[at] not in "{[":
            break
        try:
            _, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            break
        found.append(text[at:end])
        at = end
    return found, text[at:]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    """The values of spans that are not one; where there is something else, those of each line and what is left of it."""
    def pieces(lines):
        whole, left = _values("\n".join(lines))
        if not left:
            return whole
        return [piece for line in lines for found, rest in [_values(line)] for piece in [*found, rest] if piece]

    return texts.map(pieces, na_action="ignore")


def one_per_line(lines: DataFrame) -> DataFrame:
    """(value): the values of lines (file, block, id, value), each on one line, and lines that are no values."""
    found = spans(lines)
    made = found.select("texts", F.array_join("texts", " ").alias("joined"))
    outer = F.trim(F.col("joined"), F.lit(" \t\n\x0b\f\r"))
    joined = F.trim(F.when(outer.startswith(",") | outer.endswith(","), F.regexp_replace("joined", r"^\s*,|,\s*$", "")).otherwise(F.col("joined")))
    made = made.select("texts", joined.alias("joined"))
    made = made.select("texts", F.when(is_one_value(F.col("joined")), F.col("joined")).alias("one"))
    made = made.select("one", _pieces(F.when(F.col("one").isNull(), F.col("texts"))).alias("v"))
    made = made.select(F.explode(F.when(F.col("one").isNull(), F.col("v")).otherwise(F.array("one"))).alias("value"))
    return made.select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).filter(F.trim("value") != "")


_STRICT = json.JSONDecoder()


def _all_values(text: str) -> list[str] | None:
    """The values of a text, or the elements of the one array that it is; None where there is anything else.

    As the lines of the text would give them: a string that goes over a line's end is not taken.
    """
    found, left = _values(text, _STRICT)
    if left:
        return None
    if len(found) == 1 and found[0].startswith("["):
        found, left = _values(found[0][1:-1], _STRICT)
        if left:
            return None
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole(texts: pd.Series) -> pd.Series:
    return texts.map(_all_values)


def whole_values(spark: SparkSession, path, most: int, out: str) -> list[str]:
    """Write the values of files of up to `most` bytes, one to a line; the files (as `_metadata` names them) that are larger or hold anything else come back."""
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    small, large = ([r.file for r in sizes.where(test).collect()] for test in (F.col("length") <= most, F.col("length") > most))  # one row per file
    if not small:
        return large
    texts = spark.read.text([unquote(f) for f in small] if large else path, wholetext=True)
    texts = texts.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    made = settle(texts.select("file", _whole("value").alias("v")), "texts")
    made.select(F.explode("v").alias("value")).select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).write.text(out)
    return large + [r.file for r in made.where("v IS NULL").select("file").collect()]
