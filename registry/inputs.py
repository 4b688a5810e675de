"""Test tables, and variants of them with nulls, copies and changed columns.

Each variant is one list of expressions that both engines understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_ORDERS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
]
_COPIES = "CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END"
_LINEITEM = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "CASE WHEN l_partkey % 10 = 0 THEN l_linestatus END AS l_sparse",
    "l_shipdate",
]
_EVENTS = [
    "event_id", "ts", "user_id",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value",
]
_LINEITEM_V2 = [
    "l_orderkey", "l_linenumber", "CAST(l_partkey AS VARCHAR(20)) AS l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice * 1.5 AS l_extendedprice",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount",
    "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity * l_extendedprice AS l_gross",
]
# Keys without a partner on either side, and keys that are null.
_JOIN_LEFT = [
    "CASE WHEN c_custkey = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS k",
    "c_mktsegment AS tag", "c_acctbal",
]
_JOIN_RIGHT = [
    "CASE WHEN o_orderkey % 100 = 0 THEN NULL WHEN o_custkey % 2 = 1 THEN -1000000 - o_custkey ELSE o_custkey END AS k",
    "o_orderstatus AS tag", "o_orderkey",
]


def dirty_orders(spark, sf):
    made = table(spark, sf, "orders").selectExpr(*_ORDERS, f"explode(sequence(1, {_COPIES})) AS copy")
    return made.drop("copy")


def dirty_lineitem(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_LINEITEM)


def dirty_events(spark, sf):
    return table(spark, sf, "events").selectExpr(*_EVENTS)


def lineitem_v2(spark, sf):
    made = table(spark, sf, "lineitem").selectExpr(*_LINEITEM_V2)
    return made.withColumn("l_partkey", F.col("l_partkey").cast("string"))


def join_left(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_JOIN_LEFT)


def join_right(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_JOIN_RIGHT)


SQL_DIRTY_ORDERS = (
    f"dirty_orders AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate FROM "
    f"(SELECT {', '.join(_ORDERS)}, unnest(range(0, {_COPIES})) AS copy FROM orders))")
SQL_DIRTY_LINEITEM = f"dirty_lineitem AS (SELECT {', '.join(_LINEITEM)} FROM lineitem)"
SQL_DIRTY_EVENTS = f"dirty_events AS (SELECT {', '.join(_EVENTS)} FROM events)"
SQL_LINEITEM_V2 = f"lineitem_v2 AS (SELECT {', '.join(_LINEITEM_V2)} FROM lineitem)"
SQL_JOIN_LEFT = f"join_left AS (SELECT {', '.join(_JOIN_LEFT)} FROM customer)"
SQL_JOIN_RIGHT = f"join_right AS (SELECT {', '.join(_JOIN_RIGHT)} FROM orders)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


WITH_ORDERS = with_(SQL_DIRTY_ORDERS)
WITH_LINEITEM = with_(SQL_DIRTY_LINEITEM)
WITH_EVENTS = with_(SQL_DIRTY_EVENTS)

# (column, Spark type, kind)
COLUMNS = {
    "lineitem": [
        ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
        ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "categorical"),
        ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime")],
    "dirty_lineitem": [
        ("l_orderkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"), ("l_partkey", "bigint", "numeric"),
        ("l_suppkey", "bigint", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_returnflag", "string", "categorical"), ("l_sparse", "string", "categorical"),
        ("l_shipdate", "timestamp_ntz", "datetime")],
    "lineitem_v2": [
        ("l_orderkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"), ("l_partkey", "string", "categorical"),
        ("l_suppkey", "bigint", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"), ("l_returnflag", "string", "categorical"),
        ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime"),
        ("l_gross", "double", "numeric")],
    "dirty_orders": [
        ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
        ("o_orderpriority", "string", "categorical"), ("o_totalprice", "double", "numeric"),
        ("o_orderdate", "timestamp_ntz", "datetime")],
    "dirty_events": [
        ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
        ("event_type", "string", "categorical"), ("value", "double", "numeric")],
    "customer": [
        ("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"), ("c_nationkey", "int", "numeric"),
        ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "categorical")],
    "part": [
        ("p_partkey", "bigint", "numeric"), ("p_name", "string", "categorical"), ("p_brand", "string", "categorical"),
        ("p_type", "string", "categorical"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")],
}


def names(table_name: str, kind: str | None = None) -> list[str]:
    return [c for c, _, k in COLUMNS[table_name] if kind in (None, k)]


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def rounded(made: str, digits: int) -> str:
    """Correctly rounded from the exact binary value, without negative zero."""
    return f"(CASE WHEN abs({made}) < 0.5e-{digits} THEN 0.0::DOUBLE ELSE format('{{:.{digits}f}}', ({made})::DOUBLE)::DOUBLE END)"


def share(part: str, whole: str = "count(*)", digits: int = 2) -> str:
    return rounded(f"({part})::DOUBLE / ({whole}) * 100", digits)


def profile_sql(table_name: str) -> str:
    """One row per column, as `reports.profile.profile` gives it."""
    parts = []
    for c, dtype, kind in COLUMNS[table_name]:
        base = (f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, '{kind}' AS kind, count(*) AS total, "
                f"count(*) - count({c}) AS missing, {share(f"count(*) - count({c})")} AS missing_pct, "
                f"count(DISTINCT {c}) AS \"unique\", {share(f"count(DISTINCT {c})")} AS unique_pct, ")
        if kind == "numeric":
            v = f"CAST({c} AS DOUBLE)"
            made = [f"min({v})", f"max({v})", f"avg({v})", f"median({v})", f"stddev_samp({v})",
                    f"coalesce(skewness({v}), 0)", f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.75)"]
            made = [rounded(m, 4) for m in made] + [f"count_if({c} = 0)", f"count_if({c} < 0)"]
        else:
            made = ["CAST(NULL AS DOUBLE)"] * 8 + ["CAST(NULL AS BIGINT)"] * 2
        labels = ("min", "max", "mean", "median", "std", "skew", "q1", "q3", "zeros", "negatives")
        parts.append(base + ", ".join(f'{m} AS "{n}"' for m, n in zip(made, labels)) + f" FROM {table_name}")
    return union_all(parts)
