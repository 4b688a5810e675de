"""Aggregates, windows, sorting and the questions one asks of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import group
from millrace.plans import models
from millrace.reports import profile as prof
from millrace.reports import questions as ask

from . import query
from .inputs import (
    COLUMNS, WITH_EVENTS, WITH_LINEITEM, dirty_events, dirty_lineitem, names, table, union_all,
)


def _rounded(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


# ---- aggregates

query("agg_multi", WITH_LINEITEM + """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(sum(l_quantity), 2) AS l_quantity_sum,
           count(l_quantity) AS l_quantity_count, min(l_extendedprice) AS l_extendedprice_min,
           max(l_extendedprice) AS l_extendedprice_max
    FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 1""")(
    lambda s, d: _rounded(_rounded(group.aggregate(dirty_lineitem(s, d), ["l_returnflag"], {
        "l_quantity": ["mean", "sum", "count"], "l_extendedprice": ["min", "max"]}), 6, "l_quantity_mean"), 2, "l_quantity_sum"))
query("agg_single", WITH_LINEITEM + """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, max(l_extendedprice) AS l_extendedprice,
           count(l_partkey) AS l_partkey
    FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 1""")(
    lambda s, d: _rounded(group.aggregate(dirty_lineitem(s, d), "l_returnflag", {
        "l_quantity": "mean", "l_extendedprice": "max", "l_partkey": "count"}), 6, "l_quantity"))
query("agg_spark_style", WITH_LINEITEM + """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_avg, max(l_shipdate) AS l_shipdate_max
    FROM dirty_lineitem GROUP BY 1""")(
    lambda s, d: _rounded(group.aggregate(dirty_lineitem(s, d), ["l_returnflag"], agg={
        "l_quantity": "avg", "l_shipdate": "max"}), 6, "l_quantity_avg"))
query("agg_whole_table", "SELECT round(sum(o_totalprice), 2) AS o_totalprice_sum, count(DISTINCT o_custkey) AS o_custkey_nunique FROM orders")(
    lambda s, d: _rounded(group.aggregate(table(s, d, "orders"), agg={"o_totalprice": "sum", "o_custkey": "nunique"}),
                          2, "o_totalprice_sum"))
query("agg_by_name", """
    SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS o_totalprice_stddev, count(DISTINCT o_custkey) AS o_custkey_count_distinct
    FROM orders GROUP BY 1""")(
    lambda s, d: _rounded(group.aggregate(table(s, d, "orders"), ["o_orderstatus"], agg={
        "o_totalprice": "stddev", "o_custkey": "count_distinct"}), 4, "o_totalprice_stddev"))
query("agg_group_median", WITH_LINEITEM + """
    SELECT l_returnflag, round(median(l_extendedprice), 6) AS l_extendedprice FROM dirty_lineitem
    WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 1""")(
    lambda s, d: _rounded(group.aggregate(dirty_lineitem(s, d), ["l_returnflag"], {"l_extendedprice": "median"}),
                          6, "l_extendedprice"))
query("agg_more_names", """
    WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2),
         m AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS k FROM n)
    SELECT o.o_orderstatus, any_value(m.o_orderpriority) AS o_orderpriority_mode, count(*) AS o_custkey_size,
           round(median(o_totalprice), 6) AS o_totalprice_percentile
    FROM orders o LEFT JOIN m ON m.o_orderstatus = o.o_orderstatus AND m.k = 1 GROUP BY 1""")(
    lambda s, d: _rounded(group.aggregate(table(s, d, "orders"), ["o_orderstatus"], agg={
        "o_orderpriority": "mode", "o_custkey": "size", "o_totalprice": "percentile"}), 6, "o_totalprice_percentile"))

# ---- windows

_W = "OVER (PARTITION BY user_id ORDER BY {o})"
_WINDOWS = {
    "row_number": ("event_id", None, "row_number() {w}"), "rank": ("event_type", None, "rank() {w}"),
    "dense_rank": ("event_type", None, "dense_rank() {w}"), "lag": ("event_id", "value", "lag(value) {w}"),
    "lead": ("event_id", None, "lead(event_id) {w}"),
}
for _fn, (_order, _column, _made) in _WINDOWS.items():
    query(f"win_{_fn}", f"SELECT *, {_made.format(w=_W.format(o=_order))} AS {_fn}_col FROM events")(
        lambda s, d, f=_fn, o=_order, c=_column: group.window(table(s, d, "events"), ["user_id"], [o], f, c))
query("running_number", "SELECT *, row_number() OVER (ORDER BY event_id) AS row_number_col FROM events")(
    lambda s, d: group.window(table(s, d, "events"), [], ["event_id"]))

# ---- questions

query("describe", union_all([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, " + ", ".join(
        f"round({made}, 4) AS \"{n}\"" for n, made in {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})::DOUBLE",
            "p25": f"quantile_cont({c}::DOUBLE, 0.25)", "p50": f"quantile_cont({c}::DOUBLE, 0.5)",
            "p75": f"quantile_cont({c}::DOUBLE, 0.75)", "max": f"max({c})::DOUBLE"}.items()) + " FROM lineitem"
    for c in names("lineitem", "numeric")]))(
    lambda s, d: _rounded(ask.describe(table(s, d, "lineitem")), 4, "mean", "std", "min", "p25", "p50", "p75", "max"))
query("column_mean", WITH_LINEITEM + "SELECT round(avg(l_quantity), 6) AS mean FROM dirty_lineitem")(
    lambda s, d: _rounded(ask.total_of(dirty_lineitem(s, d), "l_quantity", "mean"), 6, "mean"))
query("group_mean", WITH_LINEITEM + """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")(
    lambda s, d: _rounded(ask.total_of(dirty_lineitem(s, d), "l_quantity", "mean", "l_returnflag"), 6, "mean"))
query("group_median", "SELECT o_orderpriority, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")(
    lambda s, d: _rounded(ask.total_of(table(s, d, "orders"), "o_totalprice", "median", "o_orderpriority"), 6, "median"))
query("column_median", "SELECT round(median(o_totalprice), 6) AS median FROM orders")(
    lambda s, d: _rounded(ask.total_of(table(s, d, "orders"), "o_totalprice", "median"), 6, "median"))
query("column_sum", "SELECT round(sum(o_totalprice), 2) AS sum FROM orders")(
    lambda s, d: _rounded(ask.total_of(table(s, d, "orders"), "o_totalprice", "sum"), 2, "sum"))
query("group_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum FROM lineitem GROUP BY 1")(
    lambda s, d: _rounded(ask.total_of(table(s, d, "lineitem"), "l_quantity", "sum", "l_returnflag"), 2, "sum"))
query("column_min", "SELECT min(o_totalprice) AS min FROM orders")(
    lambda s, d: ask.total_of(table(s, d, "orders"), "o_totalprice", "min"))
query("column_max", "SELECT max(o_totalprice) AS max FROM orders")(
    lambda s, d: ask.total_of(table(s, d, "orders"), "o_totalprice", "max"))
query("row_count", "SELECT count(*) AS rows FROM lineitem")(lambda s, d: ask.row_count(table(s, d, "lineitem")))
query("shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS cols FROM lineitem")(lambda s, d: ask.shape(table(s, d, "lineitem")))
query("value_counts", WITH_EVENTS + """
    SELECT event_type, count(*) AS count FROM dirty_events WHERE event_type IS NOT NULL GROUP BY 1""")(
    lambda s, d: ask.value_counts(dirty_events(s, d), "event_type"))
query("group_size", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")(
    lambda s, d: ask.group_size(table(s, d, "orders"), "o_orderpriority"))
query("distinct_values", WITH_EVENTS + "SELECT DISTINCT event_type FROM dirty_events")(
    lambda s, d: ask.distinct_values(dirty_events(s, d), "event_type"))
query("corr_pair", WITH_LINEITEM + "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r FROM dirty_lineitem")(
    lambda s, d: _rounded(ask.correlation_of(dirty_lineitem(s, d), "l_quantity", "l_extendedprice"), 8, "r"))
query("missing_counts", WITH_LINEITEM + union_all([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM dirty_lineitem" for c in names("dirty_lineitem")]))(
    lambda s, d: ask.missing_counts(dirty_lineitem(s, d)))
query("missing_count_one", WITH_LINEITEM + """
    SELECT 'l_quantity' AS "column", count(*) - count(l_quantity) AS missing FROM dirty_lineitem""")(
    lambda s, d: ask.missing_counts(dirty_lineitem(s, d), "l_quantity"))

# ---- order

query("sort_by", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST")(
    lambda s, d: ask.sort_by(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", False))
query("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")(
    lambda s, d: ask.top(table(s, d, "orders"), "o_totalprice", 5, ["o_orderkey"]))
query("bottom_n", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")(
    lambda s, d: ask.bottom(table(s, d, "orders"), "o_totalprice", 5, ["o_orderkey"]))
query("head_n", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")(lambda s, d: ask.head(table(s, d, "orders"), ["o_orderkey"]))
query("tail_n", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")(lambda s, d: ask.tail(table(s, d, "orders"), ["o_orderkey"]))
query("newest_runs", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")(
    lambda s, d: ask.newest(table(s, d, "orders"), "o_orderdate", 50, ["o_orderkey"]))

# ---- models

_RAW = "SELECT event_id AS id, props AS name, ts AS created_at, event_type AS category, value FROM events"
_STAGED = f"""staged AS (
    SELECT lower(trim(CAST(id AS VARCHAR))) AS record_id, trim(CAST(name AS VARCHAR)) AS name, created_at,
           nullif(trim(CAST(category AS VARCHAR)), '') AS category, CAST(value AS DECIMAL(38, 9)) AS value
    FROM ({_RAW}) WHERE id IS NOT NULL)"""


def _staged(s, d):
    raw = table(s, d, "events").selectExpr(
        "event_id AS id", "props AS name", "ts AS created_at", "event_type AS category", "value")
    return models.staging_model(raw, with_load_time=False)


def _plain(df):
    """Decimals as doubles and times without a zone, as the other engine gives them."""
    kept = []
    for c, t in df.dtypes:
        made = F.col(c).cast("double") if t.startswith("decimal") else F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c)
        kept.append(made.alias(c))
    return df.select(*kept)


query("staging_model", f"WITH {_STAGED} SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM staged")(
    lambda s, d: _plain(_staged(s, d)))
query("mart_summary", f"""WITH {_STAGED}
    SELECT category, count(*) AS record_count, round(avg(value::DOUBLE), 4) AS avg_value, min(value)::DOUBLE AS min_value,
           max(value)::DOUBLE AS max_value, round(sum(value)::DOUBLE, 2) AS total_value, min(created_at) AS earliest_record,
           max(created_at) AS latest_record
    FROM staged WHERE category IS NOT NULL GROUP BY 1""")(
    lambda s, d: _rounded(_rounded(_plain(models.category_summary(_staged(s, d), with_refresh_time=False)), 4, "avg_value"),
                          2, "total_value"))


def _runs(s, d):
    """Orders in the part of runs: prices as rows read and written."""
    return table(s, d, "orders").selectExpr(
        "o_orderkey AS run_id", "o_custkey AS dataset_id", "CAST(o_custkey % 25 AS INT) AS user_id", "o_orderdate AS started_at",
        "o_totalprice / 1000 AS duration_s",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status",
        "CAST(o_totalprice AS BIGINT) AS input_rows", "CAST(o_totalprice AS BIGINT) - o_custkey AS output_rows",
        "o_custkey AS rows_removed")


_RUNS = """runs AS (
    SELECT o_orderkey AS run_id, o_custkey AS dataset_id, CAST(o_custkey % 25 AS INT) AS user_id, o_orderdate AS started_at,
           o_totalprice / 1000 AS duration_s,
           CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
           CAST(trunc(o_totalprice) AS BIGINT) AS input_rows, CAST(trunc(o_totalprice) AS BIGINT) - o_custkey AS output_rows,
           o_custkey AS rows_removed FROM orders)"""

query("run_dashboard", f"""WITH {_RUNS}
    SELECT count(*) AS total_runs, count_if(status = 'success') AS success_runs, count_if(status = 'failed') AS failed_runs,
           round_even(count_if(status = 'success') * 100.0::DOUBLE / count(*), 1) AS success_rate,
           CAST(sum(input_rows) AS BIGINT) AS rows_in, CAST(sum(output_rows) AS BIGINT) AS rows_out,
           CAST(sum(input_rows) - sum(output_rows) AS BIGINT) AS rows_removed FROM runs""")(
    lambda s, d: models.run_dashboard(_runs(s, d).withColumnsRenamed({"input_rows": "rows_in", "output_rows": "rows_out"})))


def _run_mart(s, d):
    quality = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.max("l_quantity").alias("success_pct"), F.sum("l_linenumber").alias("passed"),
        F.count(F.lit(1)).alias("failed"), F.countDistinct("l_partkey").alias("total_expectations"))
    return models.run_summary(
        _runs(s, d), table(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS file_format"),
        table(s, d, "nation").selectExpr("n_nationkey AS id", "n_name AS username"), quality)


query("run_mart", f"""WITH {_RUNS}, quality AS (
        SELECT l_orderkey AS run_id, max(l_quantity) AS success_pct, CAST(sum(l_linenumber) AS BIGINT) AS passed,
               count(*) AS failed, count(DISTINCT l_partkey) AS total_expectations FROM lineitem GROUP BY 1)
    SELECT r.run_id, n_name AS username, c_name AS dataset_name, c_mktsegment AS file_format, r.started_at,
           r.duration_s, r.status, r.input_rows, r.output_rows, r.rows_removed,
           round(100.0::DOUBLE * r.rows_removed / nullif(r.input_rows, 0), 2) AS pct_rows_removed,
           success_pct AS quality_success_pct, passed AS quality_checks_passed, failed AS quality_checks_failed, total_expectations
    FROM runs r JOIN customer ON c_custkey = r.dataset_id JOIN nation ON n_nationkey = r.user_id
    LEFT JOIN quality q ON q.run_id = r.run_id""")(
    lambda s, d: _plain(_run_mart(s, d)))


def _jobs(s, d):
    return table(s, d, "customer").selectExpr("c_custkey AS job_id", "c_nationkey AS owner_id")


query("run_history_of_user", f"""WITH {_RUNS}
    SELECT r.run_id, r.status FROM runs r LEFT JOIN customer ON c_custkey = r.dataset_id
    WHERE r.user_id = 3 OR c_nationkey = 3""")(
    lambda s, d: models.runs_of(_runs(s, d).withColumnRenamed("dataset_id", "job_id"), _jobs(s, d), 3).select("run_id", "status"))
query("run_list_of_owner", f"""WITH {_RUNS}
    SELECT r.run_id, r.status FROM runs r JOIN customer ON c_custkey = r.dataset_id WHERE c_nationkey = 3""")(
    lambda s, d: models.runs_of_jobs(_runs(s, d).withColumnRenamed("dataset_id", "job_id"), _jobs(s, d), 3).select("run_id", "status"))

query("schema_listing", WITH_LINEITEM + union_all([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind, count(*) > count({c}) AS nullable, count(*) AS row_count FROM dirty_lineitem"
    for c, t, k in COLUMNS["dirty_lineitem"]]))(
    lambda s, d: prof.schema_listing(dirty_lineitem(s, d)))
