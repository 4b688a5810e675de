"""Running values in row order that never put one group into one task.

Groups of bounded size use an ordinary window.  When a group is larger than a
task should sort (or there is no grouping at all) the rows are range-partitioned
on group and order, written with their range number, computed inside each range,
and completed with what the earlier ranges of the same group leave over.  That
carry has at most two rows per range, so it is safe to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .columns import col
from .stats import value

GROUP_LIMIT = 5_000_000  # rows of one group that one task may sort
_RANGE = "_range"


def same(left: list[Column], right: list[Column]) -> Column:
    """All pairs equal, with null equal to null."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)], F.lit(True))


def has_large_group(df: DataFrame, keys: list[str], limit: int) -> bool:
    if not keys:
        return True
    largest = df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit


def ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows in ranges of group and order, as many as the row count asks for."""
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // GROUP_LIMIT + 1)
    by = [col(c) for c in [*keys, *order]]
    return settle(df.repartitionByRange(n, *by).withColumn(_RANGE, F.spark_partition_id()), "ranged")


def _edges(t: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row per range for its first and its last group: at most two per range."""
    made = [a.alias(n) for n, a in aggregates.items()]
    if not keys:
        return t.groupBy(_RANGE).agg(*made)
    key = F.struct(*[col(k) for k in keys])
    ends = t.groupBy(_RANGE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    at_edge = t.join(F.broadcast(ends), _RANGE).filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last")))
    return at_edge.groupBy(_RANGE, *[col(k) for k in keys]).agg(*made)


def _with_carry(t: DataFrame, keys: list[str], aggregates: dict[str, Column], carried, descending=False) -> DataFrame:
    over = W.partitionBy(*[col(k) for k in keys]).orderBy(F.desc(_RANGE) if descending else F.asc(_RANGE))
    edges = _edges(t, keys, aggregates)
    carry = edges.select(F.col(_RANGE).alias("_r"), *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c.alias(n) for n, c in carried(over).items()])
    match = (F.col(_RANGE) == F.col("_r")) & same([col(k) for k in keys], [F.col(f"_k{i}") for i in range(len(keys))])
    return t.join(F.broadcast(carry), match, "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])


def _before(over):
    return over.rowsBetween(W.unboundedPreceding, -1)


def number_rows(df, keys, order, out, limit=GROUP_LIMIT, ranges=None):
    """1..n in order inside each group."""
    by = [col(c) for c in order]
    if not has_large_group(df, keys, limit):
        return df.withColumn(out, F.row_number().over(W.partitionBy(*[col(k) for k in keys]).orderBy(*by)).cast("bigint"))
    t = _with_carry(ranged(df, keys, order, ranges), keys, {"_n": F.count(F.lit(1))},
                    lambda over: {"_c": F.sum("_n").over(_before(over))})
    local = F.row_number().over(W.partitionBy(_RANGE, *[col(k) for k in keys]).orderBy(*by))
    return t.withColumn(out, (local + F.coalesce(F.col("_c"), F.lit(0))).cast("bigint")).drop(_RANGE, "_c")


def running_totals(df, keys, order, amount, out, limit=GROUP_LIMIT, ranges=None):
    """Sum of `amount` over the earlier rows of the group, the row itself left out."""
    by = [col(c) for c in order]
    if not has_large_group(df, keys, limit):
        over = W.partitionBy(*[col(k) for k in keys]).orderBy(*by)
        return df.withColumn(out, F.coalesce(F.sum(col(amount)).over(_before(over)), F.lit(0)))
    t = _with_carry(ranged(df, keys, order, ranges), keys, {"_n": F.sum(col(amount))},
                    lambda over: {"_c": F.sum("_n").over(_before(over))})
    local = F.sum(col(amount)).over(_before(W.partitionBy(_RANGE, *[col(k) for k in keys]).orderBy(*by)))
    return t.withColumn(out, F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_c"), F.lit(0))).drop(_RANGE, "_c")


def neighbour(df, keys, order, column, out, ahead=False, limit=GROUP_LIMIT, ranges=None):
    """The value one row back (or ahead) in the group."""
    by = [col(c) for c in order]
    step = F.lead if ahead else F.lag
    if not has_large_group(df, keys, limit):
        return df.withColumn(out, step(col(column), 1).over(W.partitionBy(*[col(k) for k in keys]).orderBy(*by)))
    pick = F.min_by if ahead else F.max_by
    t = _with_carry(ranged(df, keys, order, ranges), keys,
                    {"_v": pick(F.struct(col(column).alias("v")), F.struct(*by))},
                    lambda over: {"_c": step(F.col("_v"), 1).over(over)})
    local = W.partitionBy(_RANGE, *[col(k) for k in keys]).orderBy(*by)
    inner = step(F.struct(col(column).alias("v")), 1).over(local)
    return t.withColumn(out, F.coalesce(inner, F.col("_c"))["v"]).drop(_RANGE, "_c")


def carry_values(df, keys, order, columns, backward=False, limit=GROUP_LIMIT, ranges=None):
    """Fill nulls with the last non-null value before (or the next one after) in order.

    Looking ahead is looking back in descending order: a frame that grows row by
    row takes one pass, one that shrinks would start anew for every row.
    """
    by = [col(c).desc() if backward else col(c) for c in order]

    def filled(over):
        frame = over.rowsBetween(W.unboundedPreceding, 0)
        return {c: F.last(col(c), ignorenulls=True).over(frame) for c in columns}

    if not has_large_group(df, keys, limit):
        new = filled(W.partitionBy(*[col(k) for k in keys]).orderBy(*by))
        return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
    nearest = F.min_by if backward else F.max_by
    at = F.struct(*[col(c) for c in order])
    t = _with_carry(
        ranged(df, keys, order, ranges), keys,
        {f"_v{i}": nearest(col(c), F.when(col(c).isNotNull(), at)) for i, c in enumerate(columns)},
        lambda over: {f"_c{i}": F.last(f"_v{i}", ignorenulls=True).over(_before(over)) for i in range(len(columns))},
        descending=backward)
    new = filled(W.partitionBy(_RANGE, *[col(k) for k in keys]).orderBy(*by))
    return t.select(*[
        F.coalesce(new[c], F.col(f"_c{columns.index(c)}")).alias(c) if c in new else col(c) for c in df.columns])


def ranks(df, keys, order, out, dense=False, limit=GROUP_LIMIT, ranges=None):
    """Rank in the group, with or without gaps; ties are counted, not sorted."""
    by = [col(c) for c in order]
    if not has_large_group(df, keys, limit):
        made = F.dense_rank() if dense else F.rank()
        return df.withColumn(out, made.over(W.partitionBy(*[col(k) for k in keys]).orderBy(*by)).cast("bigint"))
    both = list(dict.fromkeys([*keys, *order]))
    ties = df.groupBy(*[col(c) for c in both]).agg(F.count(F.lit(1)).alias("_n"))
    if dense:
        placed = number_rows(ties, keys, order, "_rank", limit, ranges)
    else:
        placed = running_totals(ties, keys, order, "_n", "_rank", limit, ranges).withColumn("_rank", F.col("_rank") + 1)
    from ..operators.joins import matched  # joins build on this module

    side = placed.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(both)], F.col("_rank").cast("bigint").alias(out))
    joined = matched(df, side, both, [f"_k{i}" for i in range(len(both))], "left")
    return joined.drop(*[f"_k{i}" for i in range(len(both))])


def group_quantiles(df, keys, column, probs, limit=GROUP_LIMIT, ranges=None):
    """Exact quantiles per group as an array column `quantiles`, null groups dropped."""
    table = (df.filter(value(df, column).isNotNull()).groupBy(*[col(k) for k in keys], col(column).cast("double").alias("_v"))
             .agg(F.count(F.lit(1)).alias("_n")))
    table = settle(table, "counts")  # read more than once
    if has_large_group(table, keys, limit):
        placed = running_totals(table, keys, ["_v"], "_n", "_before", limit, ranges)
        totals = table.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_total"))
        from ..operators.joins import matched

        t = matched(placed, totals, keys, [f"_k{i}" for i in range(len(keys))], "inner")
    else:
        group = W.partitionBy(*[col(k) for k in keys])
        t = (table.withColumn("_before", F.coalesce(F.sum("_n").over(_before(group.orderBy("_v"))), F.lit(0)))
             .withColumn("_total", F.sum("_n").over(group)))
    made = []
    for p in probs:
        spot = F.lit(float(p)) * (F.col("_total") - 1)

        def at(k: Column) -> Column:
            return F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_v")))

        share = F.max(spot - F.floor(spot))
        made.append(at(F.floor(spot)) + (at(F.ceil(spot)) - at(F.floor(spot))) * share)
    return t.groupBy(*[col(k) for k in keys]).agg(F.array(*made).alias("quantiles"))
