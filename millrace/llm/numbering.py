"""Places of rows within their group, however large a group is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle


def same_as_before(column: pa.Array, before: pa.Scalar) -> np.ndarray:
    """Whether each value equals the one ahead of it, the first one `before`; null equals null."""
    ahead = pa.concat_arrays([pa.array([before.as_py()], column.type), column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, ahead), False)
    return pc.or_(equal, pc.and_(pc.is_null(column), pc.is_null(ahead))).to_numpy(zero_copy_only=False)


def _counted(batches, group: str):
    """Each sorted partition's rows with `_seq`, their place in their group's rows there, and `_head`, the number of groups ahead of them, 0 or 1."""
    before, seen, ahead = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(batch.schema.get_field_index(group))
        same = same_as_before(own, own[0] if before is None else before)
        at = np.arange(len(same))
        started = np.maximum.accumulate(np.where(same, -1, at))
        seq = np.where(started < 0, at + seen, at - started)
        other = np.minimum(ahead + np.cumsum(~same), 1)
        before, seen, ahead = own[-1], int(seq[-1]) + 1, int(other[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64()), pa.array(other == 0)], names=[*batch.schema.names, "_seq", "_head"])


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "pos") -> DataFrame:
    """All rows, with their place from 0 on in their group by `order`; nulls come first.

    Rows are dealt into ranges of (group, order), so that a group of any size
    is spread over tasks, and are written once. Only the group that a range
    begins with can have rows in earlier ones: a row per range says how many.
    Rows that `order` does not tell apart get any of their places.
    """
    df = df.select(*df.columns)
    laid = df.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    laid = laid.mapInArrow(lambda b: _counted(b, group), f"{fields}, _seq long, _head boolean")
    laid = settle(laid.withColumn("_part", F.spark_partition_id()), "numbered")
    # Of each range: its first group, whether it has another, and the rows that its last group has there.
    last = F.max_by(F.struct(F.col(group).alias("g"), (F.col("_seq") + 1).alias("n")), F.struct(~F.col("_head"), F.col(group).isNotNull(), F.col(group), F.col("_seq")))
    ranges = laid.groupBy("_part").agg(F.min(~F.col("_head")).alias("x"), F.max(~F.col("_head")).alias("more"), last.alias("last"),
                                       F.max_by(F.struct(F.col(group).alias("g")), F.col("_head")).alias("first")).orderBy("_part").collect()
    carry, open_group, open_rows = [], None, 0
    for r in ranges:
        ahead = open_rows if open_group is not None and open_group[0] == r["first"]["g"] else 0
        if ahead:
            carry.append((r["_part"], ahead))
        open_group, open_rows = (r["last"]["g"],), r["last"]["n"] + (0 if r["more"] else ahead)
    if not carry:
        return laid.select(*df.columns, F.col("_seq").alias(name))
    given = F.broadcast(df.sparkSession.createDataFrame(carry, "_part int, _ahead long"))  # a row per range at most
    place = F.col("_seq") + F.when(F.col("_head"), F.coalesce("_ahead", F.lit(0))).otherwise(0)
    return laid.join(given, "_part", "left").select(*df.columns, place.alias(name))
