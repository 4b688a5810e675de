"""Readers, writers, whole runs and incremental runs, over files that Spark writes from the test tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import merge
from millrace.plans import runs
from millrace.plans.steps import fit_steps
from millrace.reports import profile as prof
from millrace.sources import read, write
from millrace.sources.scratch import scratch_path
from millrace.streaming.incremental import clean_new_files, follow_log

from . import query
from .inputs import (
    SQL_JOIN_LEFT, SQL_JOIN_RIGHT, WITH_EVENTS, WITH_ORDERS, dirty_events, dirty_orders, join_left, join_right, names,
    profile_sql, rounded, share, table, union_all,
)


def _orders_csv(s, d, sep=","):
    path = scratch_path(s, "orders") + (".csv" if sep == "," else ".tsv")
    dirty_orders(s, d).write.option("sep", sep).option("header", True).csv(path)
    return path


# A missing customer key makes the column floating, and dates stay text, as hand-made files are read.
_READ_BACK = WITH_ORDERS + """
    SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderpriority, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate FROM dirty_orders"""
query("csv_roundtrip", _READ_BACK)(lambda s, d: read.read_dataset(s, _orders_csv(s, d), "csv"))
query("tsv_scan", _READ_BACK)(lambda s, d: read.read_dataset(s, _orders_csv(s, d, "\t"), "tsv"))
query("read_by_suffix", _READ_BACK)(lambda s, d: read.read_dataset(s, _orders_csv(s, d)))
query("csv_spark_scan", WITH_ORDERS + "SELECT * FROM dirty_orders")(
    lambda s, d: read.read_dataset(s, _orders_csv(s, d), "csv", use_spark=True).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")))


def _ragged(s, d):
    """Orders with one field too many where the key ends in 0, and one too few where it ends in 5."""
    path = scratch_path(s, "ragged") + ".csv"
    line = F.expr("""CASE WHEN o_orderkey % 10 = 0 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus, 'more')
                          WHEN o_orderkey % 10 = 5 THEN concat_ws(',', o_orderkey, o_custkey)
                          ELSE concat_ws(',', o_orderkey, o_custkey, concat('"', o_orderstatus, ', ', o_orderpriority, '"')) END""")
    # The lines go out as they are, each file under the header, which is the name of the only column.
    raw = table(s, d, "orders").select(line.alias("id,customer,state"))
    raw.write.option("header", True).option("sep", "\u0002").option("quote", "\u0000").option("escapeQuotes", False).csv(path)
    return read.read_dataset(s, path)


query("lenient_csv", """
    SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_orderkey % 10 <> 5 THEN o_orderstatus || ', ' || o_orderpriority END AS state
    FROM orders WHERE o_orderkey % 10 <> 0""")(_ragged)


def _json(s, d, wrapped):
    """One event per line, bare or inside a top-level array."""
    path = scratch_path(s, "events") + ".json"
    event = F.struct("event_id", "user_id", "event_type", "value")
    dirty_events(s, d).select(F.to_json(F.array(event) if wrapped else event).alias("value")).write.text(path)
    return read.read_dataset(s, path).select("event_id", "user_id", "event_type", "value")


_EVENTS_READ = WITH_EVENTS + "SELECT event_id, user_id, event_type, value FROM dirty_events"
query("json_scan", _EVENTS_READ)(lambda s, d: _json(s, d, wrapped=True))
query("json_object_scan", _EVENTS_READ)(lambda s, d: _json(s, d, wrapped=False))

def _documents(s, d, path, where="true"):
    """Arrays of events over several lines, each a file of its own."""
    event = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    grouped = dirty_events(s, d).filter(where).groupBy(F.floor(F.col("event_id") / 500).alias("g")).agg(F.collect_list(event).alias("all"))
    lines = F.concat(F.lit("[\n "), F.array_join("all", ",\n "), F.lit("\n]"))
    grouped.select(lines.alias("value")).write.option("maxRecordsPerFile", 1).mode("append").text(path)


def _document_scan(s, d, use_spark):
    path = scratch_path(s, "documents") + ".json"
    _documents(s, d, path)
    return read.read_dataset(s, path, use_spark=use_spark).select("event_id", "user_id", "event_type", "value")


def _mixed(s, d):
    """Files of lines and files of one document in one folder."""
    path = scratch_path(s, "mixed") + ".json"
    _documents(s, d, path, "event_id % 2 = 0")
    event = F.struct("event_id", "user_id", "event_type", "value")
    dirty_events(s, d).filter("event_id % 2 = 1").select(F.to_json(event).alias("value")).write.mode("append").text(path)
    return read.read_dataset(s, path).select("event_id", "user_id", "event_type", "value")


def _broken(s, d):
    """Before each tenth event a line that breaks off; it stays as a row."""
    path = scratch_path(s, "broken") + ".json"
    event = F.to_json(F.struct("event_id", "user_id"))
    dirty_events(s, d).select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"event_id": 1,\n'), event)).otherwise(event).alias("value")).write.text(path)
    found = read.read_dataset(s, path)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count("event_id").alias("events"), F.sum("event_id").cast("bigint").alias("ids"))


def _many_documents(s, d):
    """Files of objects over several lines, one after the other, at times two on a line."""
    path = scratch_path(s, "many") + ".json"
    fields = ("event_id", "user_id", "event_type", "value")
    event = F.to_json(F.struct(*fields))
    over_lines = F.concat(F.lit("{\n  "), F.regexp_replace(F.substring(event, 2, 2**31 - 1), '([0-9"]),"', '$1,\n  "'))
    dirty_events(s, d).select(F.when(F.col("event_id") % 7 == 0, event).otherwise(F.concat(over_lines, F.lit("\n"))).alias("value")).write.option("lineSep", " ").text(path)
    return read.read_dataset(s, path).select(*fields)


def _all_broken(s, d):
    """Nothing but lines that break off: each is a row."""
    path = scratch_path(s, "broken") + ".json"
    dirty_events(s, d).select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string")).alias("value")).write.text(path)
    return read.read_dataset(s, path).select(F.col("_corrupt_record").alias("line"))


def _headers(s, d):
    """Files of one folder that name their columns in another order, or have one more."""
    path = scratch_path(s, "headers") + ".csv"
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    orders.filter("id % 2 = 0").select("id", "state").write.option("header", True).csv(path)
    orders.filter("id % 2 = 1").select("priority", "state", "id").write.option("header", True).mode("append").csv(path)
    return read.read_dataset(s, path).select("id", "state", "priority")


query("json_document_scan", _EVENTS_READ)(lambda s, d: _document_scan(s, d, use_spark=False))
query("json_spark_scan", _EVENTS_READ)(lambda s, d: _document_scan(s, d, use_spark=True))
query("json_mixed_folder", _EVENTS_READ)(_mixed)
query("json_many_documents", _EVENTS_READ)(_many_documents)
query("json_all_broken", WITH_EVENTS + "SELECT '{\"event_id\":' || event_id AS line FROM dirty_events")(_all_broken)
query("json_broken_lines", WITH_EVENTS + """
    SELECT count(*) + count_if(event_id % 10 = 0) AS rows, count(event_id) AS events, sum(event_id)::BIGINT AS ids FROM dirty_events""")(_broken)
query("csv_folder_headers", """
    SELECT o_orderkey AS id, o_orderstatus AS state, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS priority FROM orders""")(_headers)
query("parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")(
    lambda s, d: read.read_dataset(s, f"{d}/lineitem.parquet", nan_as_null=False).filter("l_quantity > 45").select("l_orderkey", "l_quantity"))
query("extract_report", "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS cols, 'parquet' AS format, 'spark' AS engine FROM orders")(
    lambda s, d: read.extract_report(read.read_dataset(s, f"{d}/orders.parquet"), "parquet"))
query("empty_guard", "SELECT count(*) AS rows FROM orders")(
    lambda s, d: read.require_rows(table(s, d, "orders")).agg(F.count(F.lit(1)).alias("rows")))


def _warehouse(s, d):
    write.stage_view(table(s, d, "supplier"), "raw_supplier")
    return read.read_table(s, "raw_supplier")


query("warehouse_scan", "SELECT * FROM supplier")(_warehouse)


def _both(s, d):
    done = write.write_both(dirty_orders(s, d), scratch_path(s, "out"), "my orders!")
    return s.read.parquet(done["parquet_path"])


query("dual_write", WITH_ORDERS + "SELECT * FROM dirty_orders")(_both)


def _converted(s, d):
    return write.csv_to_parquet(s, _orders_csv(s, d), scratch_path(s, "converted"))


query("csv_to_parquet", _READ_BACK)(_converted)


def _materialise(s, d):
    from .grouping import _staged

    staged = write.stage_view(_staged(s, d), "staged_events")
    path = scratch_path(s, "mart")
    write.write_parquet(staged.groupBy("category").agg(F.count(F.lit(1)).alias("record_count")), path)
    return s.read.parquet(path)


query("materialise", "SELECT event_type AS category, count(*) AS record_count FROM events GROUP BY 1")(_materialise)


def _stored(s, d):
    """A summary stored as a table of the catalogue, in a folder of its own."""
    summary = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("record_count"), F.max("value").alias("largest"))
    write.save_table(summary, "millrace_event_summary", scratch_path(s, "stored"))
    return read.read_table(s, "millrace_event_summary")


query("table_store", "SELECT event_type, count(*) AS record_count, max(value) AS largest FROM events GROUP BY 1")(_stored)


def _discovered(s, d):
    """Data files of a folder that also holds others, each read by its suffix."""
    folder, orders = scratch_path(s, "found"), table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    orders.filter("o_orderkey % 3 = 0").write.option("header", True).csv(folder)
    orders.filter("o_orderkey % 3 = 1").write.mode("append").json(folder)
    orders.filter("o_orderkey % 3 = 2").write.mode("append").parquet(folder)  # not among the suffixes looked for
    found = [df.select(F.lit(kind).alias("kind"), F.col("o_orderkey").cast("bigint"), F.col("o_orderstatus").cast("string"))
             for kind, df in read.read_folder(s, folder).items()]
    return reduce(DataFrame.unionByName, found)


query("discover_files", """
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'csv' ELSE 'json' END AS kind, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2""")(_discovered)


def _folder(s, d):
    """Orders and customers as files of two headers, an unreadable header beside them; copies of a row are in one file."""
    folder = scratch_path(s, "folder")
    dirty_orders(s, d).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").repartition("o_orderkey").write.option("header", True).csv(folder)
    customers = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    customers.write.mode("append").option("header", True).csv(folder)
    table(s, d, "region").select(
        F.concat_ws(",", "r_regionkey", "r_name").alias("key,KEY")).write.mode("append").option("header", True).option("sep", "\u0002").option(
        "quote", "\u0000").csv(folder)
    found = runs.summarise_folder(s, folder)
    return found.groupBy("status", F.coalesce(F.array_join("columns", ","), F.lit("")).alias("header")).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_total"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("dupes"), F.lit(0)).alias("dupes"), F.max("cols").alias("cols"), (F.count("error") > 0).alias("has_error"))


query("folder_summary", WITH_ORDERS + """,
    o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM dirty_orders),
    n AS (SELECT count(*) AS r, sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderpriority IS NULL)::INT + (o_totalprice IS NULL)::INT) AS m,
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o)) AS u FROM o),
    c AS (SELECT count(*) AS r, sum((c_custkey IS NULL)::INT + (c_mktsegment IS NULL)::INT) AS m,
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_custkey, c_mktsegment FROM customer)) AS u FROM customer)
    SELECT 'ok' AS status, 'o_orderkey,o_custkey,o_orderpriority,o_totalprice' AS header, r AS row_total, m::BIGINT AS missing, u AS dupes,
           4::BIGINT AS cols, false AS has_error FROM n
    UNION ALL SELECT 'ok', 'c_custkey,c_mktsegment', r, m::BIGINT, u, 2, false FROM c
    UNION ALL SELECT 'failed', '', 0, 0, 0, NULL, true
    UNION ALL SELECT 'total', '', n.r + c.r, (n.m + c.m)::BIGINT, n.u + c.u, NULL, false FROM n, c""")(_folder)


def _save_join(s, d):
    folder = scratch_path(s, "join")
    joined = merge(join_left(s, d), join_right(s, d), "k", "k", "inner")
    saved = write.save_join(joined, folder, f"{folder}/datasets")
    entry = write.read_rows(s, f"{folder}/datasets", write.DATASETS)
    return entry.filter(F.col("dataset_id") == saved["dataset_id"]).select("name", "format", "rows", "cols")


query("join_save", f"""
    WITH {SQL_JOIN_LEFT}, {SQL_JOIN_RIGHT}
    SELECT 'joined' AS name, 'csv' AS format, count(*) AS rows, CAST(5 AS BIGINT) AS cols
    FROM join_left l JOIN join_right r ON l.k IS NOT DISTINCT FROM r.k""")(_save_join)


def _saved_rows(s, d):
    folder = scratch_path(s, "join")
    saved = write.save_join(merge(join_left(s, d), join_right(s, d), "k", "k", "inner"), folder, f"{folder}/datasets")
    return s.read.option("header", True).schema("k bigint, tag_left string, c_acctbal double, tag_right string, o_orderkey bigint").csv(saved["path"])


query("join_saved_rows", f"""
    WITH {SQL_JOIN_LEFT}, {SQL_JOIN_RIGHT}
    SELECT l.k, l.tag AS tag_left, l.c_acctbal, r.tag AS tag_right, r.o_orderkey
    FROM join_left l JOIN join_right r ON l.k IS NOT DISTINCT FROM r.k""")(_saved_rows)


def _raw_folder(s, d):
    """Two files of one layout, with nulls and copies."""
    folder = scratch_path(s, "raw")
    made = dirty_orders(s, d).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    for name, part in (("early", made.filter("o_orderdate < '1998-01-01'")), ("late", made.filter("o_orderdate >= '1998-01-01'"))):
        part.write.parquet(f"{folder}/{name}")
    return folder


def _per_file(s, d):
    folder = _raw_folder(s, d)
    both = s.read.parquet(f"{folder}/early", f"{folder}/late")
    return prof.file_summary(both.select(F.regexp_extract("_metadata.file_path", r"/(early|late)/", 1).alias("file_name"), "*"))


query("per_file_summary", WITH_ORDERS + """, f AS (SELECT CASE WHEN o_orderdate < '1998-01-01' THEN 'early' ELSE 'late' END AS file, * FROM dirty_orders),
    u AS (SELECT file, count(*) AS n FROM (SELECT DISTINCT * FROM f) GROUP BY 1)
    SELECT f.file, count(*) AS rows, CAST(5 AS BIGINT) AS cols,
           CAST(sum((o_custkey IS NULL)::INT + (o_orderpriority IS NULL)::INT + (o_totalprice IS NULL)::INT) AS BIGINT) AS missing,
           count(*) - any_value(u.n) AS dupes
    FROM f JOIN u USING (file) GROUP BY 1""")(_per_file)


def _clean_each(s, d):
    folder, out = scratch_path(s, "rawcsv"), scratch_path(s, "clean")
    parts = []
    for name, test in (("early.csv", "o_orderdate < '1998-01-01'"), ("late.csv", "o_orderdate >= '1998-01-01'")):
        parts.append(f"{folder}/{name}")
        dirty_orders(s, d).filter(test).drop("o_orderdate").write.option("header", True).csv(parts[-1])
    report = runs.clean_files(s, parts, out)
    assert report and all(r["status"] == "success" for r in report), report
    return s.read.option("header", True).schema("o_orderkey bigint, o_custkey double, o_orderpriority string, o_totalprice double").csv(
        [r["path"] for r in report])


query("per_file_clean", WITH_ORDERS + "SELECT DISTINCT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM dirty_orders")(
    lambda s, d: _clean_each(s, d).select("o_orderkey", "o_orderpriority"))
query("per_file_clean_values", WITH_ORDERS + """, f AS (
        SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate < '1998-01-01' AS early FROM dirty_orders),
    m AS (SELECT early, median(o_custkey) AS c, median(o_totalprice) AS t FROM f GROUP BY 1)
    SELECT o_orderkey, coalesce(o_custkey, c)::DOUBLE AS o_custkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority,
           round(coalesce(o_totalprice, t), 6) AS o_totalprice FROM f JOIN m USING (early)""")(
    lambda s, d: _clean_each(s, d).withColumn("o_totalprice", F.round("o_totalprice", 6)))

_STAGES = [
    {"type": "transform", "name": "clean", "config": {"operations": [
        {"op": "deduplicate"}, {"op": "filter_rows", "column": "o_totalprice", "condition": "gt", "value": 100000}]}},
    {"type": "dq_check", "name": "check", "config": {"suite": [
        {"expectation": "expect_column_values_to_not_be_null", "kwargs": {"column": "o_custkey"}},
        {"expectation": "expect_column_values_to_be_unique", "kwargs": {"column": "o_orderkey"}}]}},
    {"type": "spark_transform", "name": "group", "config": {
        "operation": "aggregate", "group_by": ["o_orderpriority"], "agg": {"o_totalprice": "count"}}},
    {"type": "mystery", "name": "unknown"},
]
_STAGED_ROWS = """, u AS (SELECT DISTINCT * FROM dirty_orders WHERE o_totalprice > 100000)"""


def _stages(s, d):
    folder = scratch_path(s, "run")
    return folder, runs.run_stages(s, dirty_orders(s, d), _STAGES, folder)


def _stage_result(s, d):
    folder, done = _stages(s, d)
    return write.read_rows(s, f"{folder}/runs", write.RUNS).select("status", "trigger", "rows_in", "rows_out")


query("multi_stage_run", WITH_ORDERS + _STAGED_ROWS + """
    SELECT 'success' AS status, 'manual' AS trigger, (SELECT count(*) FROM dirty_orders) AS rows_in,
           (SELECT count(DISTINCT coalesce(o_orderpriority, '?')) FROM u) AS rows_out""")(_stage_result)
query("multi_stage_output", WITH_ORDERS + _STAGED_ROWS + " SELECT o_orderpriority, count(o_totalprice) AS o_totalprice_count FROM u GROUP BY 1")(
    lambda s, d: s.read.option("header", True).schema("o_orderpriority string, o_totalprice_count bigint").csv(_stages(s, d)[1]["output_path"]))
query("check_result_append", WITH_ORDERS + _STAGED_ROWS + """
    SELECT count(*) = count(o_custkey) AND count(*) = count(DISTINCT o_orderkey) AS success, CAST(2 AS BIGINT) AS total,
           CAST((count(*) = count(o_custkey))::INT + (count(*) = count(DISTINCT o_orderkey))::INT AS BIGINT) AS passed FROM u""")(
    lambda s, d: write.read_rows(s, f"{_stages(s, d)[0]}/check_results", write.CHECKS).select("success", "total", "passed"))
query("run_log_append", """
    SELECT * FROM (VALUES ('INFO', 'extract'), ('INFO', 'profile'), ('INFO', 'clean'), ('INFO', 'clean'), ('INFO', 'check'), ('WARN', 'check'),
      ('INFO', 'group'), ('INFO', 'group'), ('INFO', 'unknown'), ('WARN', 'unknown'), ('INFO', 'load')) t(level, step)""")(
    lambda s, d: write.read_rows(s, f"{_stages(s, d)[0]}/run_logs", write.RUN_LOG).select("level", "step"))


def _run_report(s, d):
    return runs.run_report(s, dirty_orders(s, d), scratch_path(s, "report"), [
        {"type": "drop_duplicates", "config": {}}, {"type": "drop_nulls", "config": {}}], staging=True)


def _report(s, d):
    done = _run_report(s, d)
    return s.createDataFrame([(done["input_rows"], done["output_rows"], done["rows_removed"])],
                             "input_rows bigint, output_rows bigint, rows_removed bigint")


query("full_report", WITH_ORDERS + """, u AS (SELECT DISTINCT * FROM dirty_orders
        WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL), n AS (SELECT count(*) AS b FROM u),
    a AS (SELECT count(*) AS a FROM dirty_orders) SELECT a AS input_rows, b AS output_rows, a - b AS rows_removed FROM a, n""")(_report)
query("full_report_profile", WITH_ORDERS + profile_sql("dirty_orders"))(lambda s, d: _run_report(s, d)["reports"]["profile"])
query("full_report_missing", WITH_ORDERS + union_all([f"""
    SELECT '{c}' AS "column", count(*) - count({c}) AS count, {share(f"count(*) - count({c})")} AS pct FROM dirty_orders"""
    for c in names("dirty_orders")]))(lambda s, d: _run_report(s, d)["reports"]["missing"])
query("full_report_correlation", WITH_ORDERS + union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {rounded(f'corr({a}, {b})', 3)} AS r FROM dirty_orders"
    for a, b in product(names("dirty_orders", "numeric"), repeat=2)]))(lambda s, d: _run_report(s, d)["reports"]["correlation"])
query("full_report_files", WITH_ORDERS + """
    SELECT DISTINCT * FROM dirty_orders WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL""")(
    lambda s, d: s.read.parquet(_run_report(s, d)["files"]["parquet_path"]))
query("transform_preview", WITH_ORDERS + """
    SELECT (SELECT count(*) FROM dirty_orders) AS rows_before, count(*) AS rows_after, 5::INT AS cols_before, 4::INT AS cols_after
    FROM (SELECT DISTINCT * FROM dirty_orders)""")(
    lambda s, d: runs.preview_steps(dirty_orders(s, d), [
        {"op": "deduplicate"}, {"op": "drop_columns", "columns": ["o_orderdate"]}], ["o_orderkey"])["counts"])

# ---- incremental

_INCREMENTAL = [
    {"type": "fill_missing", "config": {"strategy": "median"}},
    {"type": "remove_outliers", "config": {"columns": ["value"], "threshold": 0.5}},
]


def _incremental(s, d):
    """Fit on the whole table, then clean its files in two arrivals: the parts add up to the whole."""
    events = dirty_events(s, d)
    fitted = fit_steps(events, _INCREMENTAL)
    folder, out, checkpoint = (scratch_path(s, x) for x in ("arrivals", "cleaned", "progress"))
    done = None
    for early in (True, False):
        arrival = events.filter("ts < '2024-01-15'" if early else "NOT ts < '2024-01-15'")
        arrival.write.mode("append").parquet(folder)
        done = clean_new_files(s, folder, events.schema, fitted, out, checkpoint, unique_by=["event_id"])
    return done.withColumn("value", F.round("value", 6))


query("incremental_clean", WITH_EVENTS + """, f AS (SELECT event_id, ts, user_id, coalesce(event_type, 'Unknown') AS event_type,
        coalesce(value, (SELECT median(value) FROM dirty_events)) AS value FROM dirty_events),
    b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f)
    SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM f, b
    WHERE value BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")(_incremental)


def _follow(s, d):
    folder, out, checkpoint = (scratch_path(s, x) for x in ("lines", "tail", "progress"))
    events = table(s, d, "events")
    events.write.parquet(folder)
    return follow_log(s, folder, events.schema, 7, 500, out, checkpoint, run="user_id", id="event_id")


query("log_tail_stream", "SELECT * FROM events WHERE user_id = 7 AND event_id > 500")(_follow)
