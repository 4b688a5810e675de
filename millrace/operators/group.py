"""Aggregates by group, and window columns."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import col
from ..functions.stats import value

# Aggregates whose state stays bounded however large a group is.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop,
    "var": F.var_samp, "variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop,
    "nunique": F.count_distinct, "count_distinct": F.count_distinct, "countDistinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct, "skewness": F.skewness, "kurtosis": F.kurtosis,
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True),
    "sum_distinct": F.sum_distinct, "bool_and": F.bool_and, "bool_or": F.bool_or, "any_value": F.any_value,
    "product": F.product, "percentile_approx": lambda c: F.percentile_approx(c, 0.5),
    "approx_percentile": lambda c: F.percentile_approx(c, 0.5), "size": lambda c: F.count(F.lit(1)),
}
# Exact and spread over tasks, see functions.ordered; modes are counted by group and value first.
GROUP_ORDER = ("median", "percentile", "mode")


def aggregate(df: DataFrame, group_by: list[str] | str | None = None, aggregations: dict | None = None,
              agg: dict | None = None, suffix: bool = False) -> DataFrame:
    """Aggregate by group.

    ``aggregations={column: name}`` keeps column names, ``{column: [names]}`` (or
    `suffix`) makes ``column_name``; both drop null groups and sort by key.
    ``agg={column: name}`` makes ``column_name``, keeps null groups, and without
    `group_by` gives one row for the table.
    """
    keys = [group_by] if isinstance(group_by, str) else list(group_by or [])
    plan = agg if agg is not None else aggregations or {}
    if agg is None and (not keys or not plan):
        return df
    if missing := [c for c in [*keys, *plan] if c not in df.columns]:
        raise ValueError(f"columns not found: {missing}")
    wanted = []
    for c, names in plan.items():
        listed = isinstance(names, (list, tuple))
        for n in names if listed else [names]:
            if n not in AGGREGATES and n not in GROUP_ORDER:
                raise ValueError(f"unknown aggregate: {n}")
            wanted.append((c, n, f"{c}_{n}" if listed or suffix or agg is not None else c))
    by_key = [col(k) for k in keys]
    source = df.dropna(subset=keys) if agg is None else df
    plain = [AGGREGATES[n](value(df, c)).alias(out) for c, n, out in wanted if n in AGGREGATES]
    result = source.groupBy(*by_key).agg(*plain) if plain else source.select(*by_key).distinct()
    for i, (c, n, out) in enumerate(w for w in wanted if w[1] in GROUP_ORDER):
        grouped = [col(k).alias(f"_g{j}") for j, k in enumerate(keys)]
        if n == "mode":
            side = _modes(source.select(*grouped, value(source, c).alias("_v")), [f"_g{j}" for j in range(len(keys))], out)
        else:
            side = ordered.group_quantiles(source, keys, c, [0.5]).select(*grouped, F.col("quantiles")[0].alias(out))
        on = ordered.same(by_key, [F.col(f"_g{j}") for j in range(len(keys))])
        result = result.join(side, on, "left").drop(*[f"_g{j}" for j in range(len(keys))])
    result = result.select(*by_key, *[col(out) for _, _, out in wanted])
    return result.orderBy(*by_key) if agg is None else result


def _modes(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The most frequent value `_v` of each group, the smallest on a tie; values are counted on the map side before groups meet."""
    counted = df.where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_n"), "_v")).getField("_v").alias(out))


def window(df: DataFrame, partition_by: list[str] | str | None = None, order_by: list[str] | str | None = None,
           fn: str = "row_number", column: str | None = None, group_limit: int = ordered.GROUP_LIMIT,
           ranges: int | None = None) -> DataFrame:
    """Add ``<fn>_col``: row_number, rank, dense_rank, lag or lead by one row.

    An unknown function numbers the rows.  Order is ascending.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not order:
        raise ValueError("a window needs order_by")
    out, spread = f"{fn}_col", {"limit": group_limit, "ranges": ranges}
    if fn in ("rank", "dense_rank"):
        return ordered.ranks(df, keys, order, out, dense=fn == "dense_rank", **spread)
    if fn in ("lag", "lead"):
        return ordered.neighbour(df, keys, order, column or order[0], out, ahead=fn == "lead", **spread)
    return ordered.number_rows(df, keys, order, out, **spread)


def sql_step(df: DataFrame, sql: str, view: str = "source_table") -> DataFrame:
    """Any query over the table, which it sees under the view's name; a view that the caller has under that name stays as it is."""
    spark, hidden = df.sparkSession, f"_{view}_{uuid4().hex}"
    df.createOrReplaceTempView(hidden)
    try:
        return spark.sql(f"WITH `{view}` AS (SELECT * FROM {hidden}) SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    finally:
        spark.catalog.dropTempView(hidden)
