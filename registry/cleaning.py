"""Row and column steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import fill, group, rows, scale, shape
from millrace.plans.steps import run_steps
from millrace.reports import profile as prof

from . import query
from .inputs import (
    WITH_EVENTS, WITH_LINEITEM, WITH_ORDERS, dirty_events, dirty_lineitem, dirty_orders, names, table, union_all,
)

# ---- duplicates

query("dedup_all", WITH_ORDERS + "SELECT DISTINCT * FROM dirty_orders")(
    lambda s, d: rows.drop_duplicates(dirty_orders(s, d)))

query("dedup_subset", WITH_ORDERS + """
    SELECT * FROM dirty_orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")(
    lambda s, d: rows.drop_duplicates(dirty_orders(s, d), ["o_custkey"], ["o_orderkey"]))

query("dedup_texts", "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")(
    lambda s, d: rows.drop_duplicates(table(s, d, "documents"), ["text"], ["doc_id"]))

query("duplicate_report", WITH_ORDERS + """
    , u AS (SELECT DISTINCT * FROM dirty_orders)
    SELECT t.n AS total_rows, t.n - u.n AS duplicate_rows, u.n AS unique_rows, round((t.n - u.n) * 100.0 / t.n, 2)::DOUBLE AS dupe_pct
    FROM (SELECT count(*) AS n FROM dirty_orders) t, (SELECT count(*) AS n FROM u) u""")(
    lambda s, d: prof.duplicate_report(dirty_orders(s, d)))

query("latest_per_name", """
    SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY lower(trim(o_orderpriority)) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")(
    lambda s, d: rows.latest_per_name(
        table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderpriority",
        ["o_orderdate", "o_orderkey"]))

# ---- nulls and sparse columns

query("drop_nulls", WITH_LINEITEM + """
    SELECT * FROM dirty_lineitem
    WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL""")(
    lambda s, d: rows.drop_nulls(dirty_lineitem(s, d), ["l_quantity", "l_extendedprice", "l_returnflag"]))

query("drop_nulls_any", WITH_EVENTS + "SELECT * FROM dirty_events WHERE event_type IS NOT NULL AND value IS NOT NULL")(
    lambda s, d: rows.drop_nulls(dirty_events(s, d)))

_DENSE = WITH_LINEITEM + "SELECT * EXCLUDE (l_sparse) FROM dirty_lineitem"
query("drop_missing_cols", _DENSE)(lambda s, d: shape.drop_missing(dirty_lineitem(s, d), threshold_pct=80))
query("drop_high_null_cols", _DENSE)(lambda s, d: shape.drop_high_null(dirty_lineitem(s, d), threshold=0.8))
query("keep_low_null_cols", _DENSE)(lambda s, d: shape.keep_low_null(dirty_lineitem(s, d), threshold=0.8))

# ---- filters

_FILTERS = {
    "eq": ({"column": "l_returnflag", "operator": "eq", "value": "R"}, "l_returnflag = 'R'"),
    "neq": ({"column": "l_returnflag", "operator": "neq", "value": "R"}, "l_returnflag IS DISTINCT FROM 'R'"),
    "gt": ({"column": "l_quantity", "operator": "gt", "value": "30"}, "l_quantity > 30"),
    "gte": ({"column": "l_quantity", "operator": "gte", "value": 30}, "l_quantity >= 30"),
    "lt": ({"column": "l_quantity", "condition": "lt", "value": 30}, "l_quantity < 30"),
    "lte": ({"column": "l_quantity", "condition": "lte", "value": 30}, "l_quantity <= 30"),
    "contains": ({"column": "l_returnflag", "operator": "contains", "value": "[AN]"}, "regexp_matches(l_returnflag, '[AN]')"),
    "not_null": ({"column": "l_extendedprice", "condition": "not_null"}, "l_extendedprice IS NOT NULL"),
    "is_null": ({"column": "l_extendedprice", "condition": "is_null"}, "l_extendedprice IS NULL"),
    "missing_column": ({"column": "nowhere", "operator": "eq", "value": 1}, "true"),
    "unknown_operator": ({"column": "l_quantity", "operator": "like", "value": 1}, "true"),
}
for _name, (_config, _where) in _FILTERS.items():
    query(f"filter_{_name}", WITH_LINEITEM + f"SELECT * FROM dirty_lineitem WHERE {_where}")(
        lambda s, d, c=_config: rows.filter_rows(dirty_lineitem(s, d), **c))

query("filter_text_contains", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}')")(
    lambda s, d: rows.filter_rows(table(s, d, "documents"), "text", "contains", "[0-9]{3}-[0-9]{2}").select("doc_id", "lang"))

query("filter_threshold", "SELECT * FROM orders WHERE o_totalprice > 400000")(
    lambda s, d: rows.rows_where(table(s, d, "orders"), "o_totalprice", ">", 400000))

query("log_tail", "SELECT * FROM events WHERE user_id = 7 AND event_id > 500 ORDER BY event_id")(
    lambda s, d: rows.since(table(s, d, "events"), 7, 500, run="user_id", id="event_id"))

query("catalogue_search", """
    SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE p_brand = 'Brand#7' AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')
      OR len(list_filter(string_split(lower(p_name), ' '), lambda x: contains(x, 'ring'))) > 0)""")(
    lambda s, d: rows.search_catalogue(
        table(s, d, "part").withColumn("tags", F.split(F.lower("p_name"), " ")), "Brand#7", "RING",
        name="p_name", description="p_type", category_column="p_brand").select("p_partkey", "p_name", "p_brand", "p_type"))

# ---- filling

_NUMBERS = {"l_quantity", "l_extendedprice"}


def _filled(number: str, text: str = "'Unknown'", digits: int = 6) -> str:
    made = []
    for c in names("dirty_lineitem"):
        if c in _NUMBERS:
            made.append(f"round(coalesce({c}, (SELECT {number.format(c=c)} FROM dirty_lineitem)), {digits}) AS {c}")
        elif c in ("l_returnflag", "l_sparse"):
            made.append(f"coalesce({c}, {text.format(c=c)}) AS {c}")
        else:
            made.append(c)
    return WITH_LINEITEM + f"SELECT {', '.join(made)} FROM dirty_lineitem"


def _round_numbers(df, digits=6, cols=_NUMBERS):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


query("fill_median", _filled("median({c})"))(
    lambda s, d: _round_numbers(fill.fill_missing(dirty_lineitem(s, d), "median")))
query("fill_mean", _filled("avg({c})"))(
    lambda s, d: _round_numbers(fill.fill_missing(dirty_lineitem(s, d), "mean")))
_MODE = "(SELECT {c} FROM dirty_lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
query("fill_mode", WITH_LINEITEM + "SELECT " + ", ".join(
          f"coalesce({c}, {_MODE.format(c=c)}) AS {c}" if c in _NUMBERS | {"l_returnflag", "l_sparse"} else c
          for c in names("dirty_lineitem")) + " FROM dirty_lineitem")(
    lambda s, d: fill.fill_missing(dirty_lineitem(s, d), "mode"))
query("fill_constant", WITH_LINEITEM + """
    SELECT * REPLACE (coalesce(l_quantity, 0) AS l_quantity, coalesce(l_returnflag, '0') AS l_returnflag)
    FROM dirty_lineitem""")(
    lambda s, d: fill.fill_missing(dirty_lineitem(s, d), "constant", ["l_quantity", "l_returnflag"], 0))
query("fill_unknown", WITH_LINEITEM + """
    SELECT * REPLACE (coalesce(l_returnflag, 'Unknown') AS l_returnflag, coalesce(l_sparse, 'Unknown') AS l_sparse)
    FROM dirty_lineitem""")(
    lambda s, d: fill.fill_missing(dirty_lineitem(s, d), "constant", ["l_returnflag", "l_sparse", "l_quantity"]))


def _neighbours(fn: str, frame: str, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY event_id ROWS BETWEEN {frame})"
    return WITH_EVENTS + f"""
        SELECT event_id, ts, user_id, {fn}(event_type IGNORE NULLS) {over} AS event_type,
               {fn}(value IGNORE NULLS) {over} AS value FROM dirty_events"""


_BACK, _AHEAD = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
_GAPS = ["event_type", "value"]
query("fill_ffill", _neighbours("last_value", _BACK))(
    lambda s, d: fill.fill_missing(dirty_events(s, d), "ffill", _GAPS, order_by=["event_id"]))
query("fill_bfill", _neighbours("first_value", _AHEAD))(
    lambda s, d: fill.fill_missing(dirty_events(s, d), "bfill", _GAPS, order_by=["event_id"]))
query("fill_ffill_by_user", _neighbours("last_value", _BACK, "PARTITION BY user_id"))(
    lambda s, d: fill.fill_missing(dirty_events(s, d), "ffill", _GAPS, order_by=["event_id"], partition_by=["user_id"]))

query("batch_typed_fill", _filled("median({c})"))(
    lambda s, d: _round_numbers(fill.fill_by_type(dirty_lineitem(s, d))))
query("fill_report", WITH_LINEITEM + union_all([
    f"SELECT '{c}' AS \"column\", 'median' AS strategy, count(*) - count({c}) AS filled FROM dirty_lineitem"
    for c in names("dirty_lineitem")]))(
    lambda s, d: fill.fill_report(dirty_lineitem(s, d), "median"))

# ---- scaling

_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled(table_name: str, keys: str, cols: list[str], made: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({made.format(c=c)}, 8) AS {c}" for c in cols) + f" FROM {table_name}"


query("normalize", _scaled("lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", _SCALED,
                           "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"))(
    lambda s, d: _round_numbers(scale.normalize(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_SCALED), _SCALED), 8, _SCALED))
query("standardize", _scaled("part", "p_partkey", ["p_size", "p_retailprice"],
                             "({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))(
    lambda s, d: _round_numbers(scale.standardize(
        table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), 8,
        {"p_size", "p_retailprice"}))

# ---- outliers

_BOUNDS = "SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}"
query("outliers_iqr", "SELECT e.* FROM events e, (" + _BOUNDS.format(c="value", t="events") + """) b
    WHERE e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")(
    lambda s, d: rows.remove_outliers(table(s, d, "events"), ["value"], "iqr", 1.5))
query("outliers_iqr_all", WITH_LINEITEM + "SELECT t.* FROM dirty_lineitem t WHERE " + " AND ".join(
    f"({c} IS NULL OR (SELECT t.{c} BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1) FROM ("
    + _BOUNDS.format(c=c, t="dirty_lineitem") + ")))" for c in names("dirty_lineitem", "numeric")))(
    lambda s, d: rows.remove_outliers(dirty_lineitem(s, d), method="iqr", threshold=0.4))
query("outliers_zscore", WITH_EVENTS + """
    SELECT e.* FROM dirty_events e, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM dirty_events) b
    WHERE abs((e.value - m) / sd) <= 1.5""")(
    lambda s, d: rows.remove_outliers(dirty_events(s, d), ["value"], "zscore", 1.5))

# ---- columns


def _cast(s, d):
    made = table(s, d, "orders").selectExpr(
        "o_orderkey", "cast(o_custkey as string) AS as_int", "concat(o_totalprice, '') AS as_float",
        "o_orderpriority AS not_a_number", "o_totalprice AS whole_only", "cast(o_orderdate as string) AS as_time",
        "o_orderstatus AS not_a_time", "o_custkey AS as_text", "o_custkey AS as_bool")
    return shape.cast_types(made, {
        "as_int": "int", "as_float": "float", "not_a_number": "int", "whole_only": "int", "as_time": "datetime",
        "not_a_time": "datetime", "as_text": "string", "as_bool": "bool", "nowhere": "int"}).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("as_time", "not_a_time")})


query("cast_types", """
    SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS as_int, o_totalprice AS as_float,
           TRY_CAST(o_orderpriority AS BIGINT) AS not_a_number,
           CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS whole_only,
           o_orderdate AS as_time, TRY_CAST(o_orderstatus AS TIMESTAMP) AS not_a_time,
           CAST(o_custkey AS VARCHAR) AS as_text, o_custkey <> 0 AS as_bool
    FROM orders""")(_cast)

query("derive_column", "SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(
    lambda s, d: shape.derive_column(table(s, d, "lineitem"), "net", "round(l_extendedprice * (1 - l_discount), 4)"))
query("expr_step", "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'F' AS large_done FROM orders")(
    lambda s, d: run_steps(table(s, d, "orders"), [
        {"op": "derive_column", "name": "large_done", "expression": "o_totalprice > 100000 AND o_orderstatus = 'F'"}]
    ).df.select("o_orderkey", "large_done"))
query("bucket", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS size
    FROM orders""")(
    lambda s, d: shape.bucket_column(table(s, d, "orders"), "size", "o_totalprice", [(300000, "high"), (100000, "medium")],
                                     "low").select("o_orderkey", "size"))
query("trim_strings", r"""
    SELECT doc_id, regexp_replace('  ' || text || E'\n ', '^\s+|\s+$', '', 'g') AS text, lang, source, n_chars FROM documents""")(
    lambda s, d: shape.trim_strings(
        table(s, d, "documents").withColumn("text", F.concat(F.lit("  "), "text", F.lit("\n "))), ["text", "n_chars"]))
query("snake_case", "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS \"region\" FROM nation")(
    lambda s, d: shape.snake_case_columns(
        table(s, d, "nation").toDF("Nation Key", "  Nation \t Name", "REGION ")))
query("rename_drop", "SELECT o_orderkey AS id, o_custkey, o_totalprice AS amount, o_orderdate, o_orderpriority FROM orders")(
    lambda s, d: shape.drop_columns(shape.rename_columns(
        table(s, d, "orders"), {"o_orderkey": "id", "o_totalprice": "amount", "nowhere": "x"}), ["o_orderstatus", "nowhere"]))
query("repartition_identity", "SELECT * FROM orders")(lambda s, d: shape.repartition(table(s, d, "orders"), 4))
query("unknown_step", "SELECT * FROM orders")(
    lambda s, d: run_steps(table(s, d, "orders"), [{"type": "no_such_step"}, {"operation": "passthrough"}]).df)
query("sql_step", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2""")(
    lambda s, d: group.sql_step(table(s, d, "lineitem"), """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n
        FROM source_table GROUP BY l_returnflag, l_linestatus"""))
query("preview", WITH_ORDERS + """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), '') AS o_custkey,
           coalesce(o_orderpriority, '') AS o_orderpriority
    FROM (SELECT DISTINCT * FROM dirty_orders) u ORDER BY u.o_orderkey LIMIT 100""")(
    lambda s, d: shape.preview(
        rows.drop_duplicates(dirty_orders(s, d)).select("o_orderkey", "o_custkey", "o_orderpriority"), 100, 25, ["o_orderkey"]))

# ---- staging

query("staging_generated", """
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand, trim(p_type) AS p_type,
           CAST(p_size AS INTEGER) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part""")(
    lambda s, d: shape.staging_projection(table(s, d, "part")))
query("staging_loop", "SELECT trim(CAST(p_partkey AS VARCHAR)) AS part_key, trim(p_name) AS p_name FROM part")(
    lambda s, d: shape.staging_trimmed(table(s, d, "part").withColumnRenamed("p_partkey", "Part Key"), ["Part Key", "p_name"]))
