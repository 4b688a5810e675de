"""Whole step lists, as one chain of common table expressions each."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.steps import fit_steps, run_steps
from millrace.plans.templates import BATCH_STEPS, DEFAULT_STEPS, TEMPLATES
from millrace.sources.scratch import scratch_path, settle
from millrace.streaming.incremental import clean_new_files
from millrace.streaming.states import described, merged_states, refit, remember

from . import query
from .inputs import SQL_DIRTY_LINEITEM, WITH_ORDERS, dirty_lineitem, dirty_orders, table, with_


def _median(c: str, t: str) -> str:
    return f"coalesce({c}, (SELECT median({c}) FROM {t}))"


def _mode(c: str, t: str) -> str:
    return f"coalesce({c}, (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"


def _scaled(c: str, t: str) -> str:
    return f"({c} - (SELECT min({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t})"


def _standard(c: str, t: str) -> str:
    return f"({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_samp({c}) FROM {t})"


def _within(cols: list[str], t: str, k: float) -> str:
    """Rows of t whose every listed column is null or near the quartiles."""
    ends = ", ".join(f"quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(cols))
    kept = " AND ".join(f"({c} IS NULL OR {c} BETWEEN a{i} - {k} * (b{i} - a{i}) AND b{i} + {k} * (b{i} - a{i}))"
                        for i, c in enumerate(cols))
    return f"SELECT {t}.* FROM {t}, (SELECT {ends} FROM {t}) WHERE {kept}"


def _replace(t: str, made: dict[str, str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in made.items())}) FROM {t}"


def _final(t: str, digits: int, cols: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in cols)}) FROM {t}"


def _round(df, digits, cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _arrivals(s, df, steps):
    """Steps fitted on all rows, run as the rows arrive in two parts; copies of a row are in either."""
    fitted, dealt = fit_steps(df, steps), settle(df.withColumn("_early", F.rand(7) < 0.5))
    folder, out, checkpoint = (scratch_path(s, x) for x in ("arrivals", "cleaned", "progress"))
    done = None
    for early in (True, False):
        dealt.filter(F.col("_early") == early).drop("_early").write.mode("append").parquet(folder)
        done = clean_new_files(s, folder, df.schema, fitted, out, checkpoint)
    return done


def _cleaned(name, sql, source, steps, digits=0, cols=()):
    """A step list over a whole table, and incrementally: both give the same rows."""
    query(name, sql)(lambda s, d: _round(run_steps(source(s, d), steps).df, digits, cols))
    query(f"incremental_{name}", sql)(lambda s, d: _round(_arrivals(s, source(s, d), steps), digits, cols))


def _described(s, d):
    """Columns of sales behind the template's plain steps, from the states of two arrivals."""
    df, steps = settle(_sales(s, d)), TEMPLATES["sales_data"]["steps"]
    folder, out, checkpoint, store = (scratch_path(s, x) for x in ("arrivals", "cleaned", "progress", "states"))
    fitted, observe = fit_steps(df, steps), remember(s, df.schema, steps, store)
    for early in (True, False):
        df.filter("Amount < 5000 OR `Order ID` % 50 = 0" if early else "NOT coalesce(Amount < 5000, false)").write.mode("append").parquet(folder)
        clean_new_files(s, folder, df.schema, fitted, out, checkpoint, observe=observe)
    return described(merged_states(s, store)), refit(s, df.schema, steps, store)


def _states(s, d):
    found, refitted = _described(s, d)
    bounds = next(x["fitted"] for x in refitted if x["name"] == "remove_outliers")
    kept = s.createDataFrame([(c, b is not None and a < b) for c, (a, b) in bounds.items()], "column string, has_bounds boolean")
    return found.join(kept, "column", "left").select(
        "column", "rows", "nulls", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"), F.coalesce("has_bounds", F.lit(False)).alias("has_bounds"))


_PRICES = ["l_quantity", "l_extendedprice"]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_cleaned("default_clean", with_(
    SQL_DIRTY_LINEITEM, "u AS (SELECT DISTINCT * FROM dirty_lineitem)", "n AS (SELECT * EXCLUDE (l_sparse) FROM u)",
    "f AS (" + _replace("n", {**{c: _median(c, "n") for c in _PRICES}, "l_returnflag": "coalesce(l_returnflag, 'Unknown')"}) + ")",
    "w AS (" + _within(_KEYS + _PRICES, "f", 1.5) + ")") + _final("w", 6, _PRICES),
    dirty_lineitem, DEFAULT_STEPS, 6, _PRICES)

_cleaned("batch_clean", with_(
    SQL_DIRTY_LINEITEM, "u AS (SELECT DISTINCT * FROM dirty_lineitem)",
    "f AS (" + _replace("u", {**{c: _median(c, "u") for c in _PRICES}, "l_returnflag": "trim(coalesce(l_returnflag, 'Unknown'))",
                              "l_sparse": "trim(coalesce(l_sparse, 'Unknown'))"}) + ")") + _final("f", 6, _PRICES),
    dirty_lineitem, BATCH_STEPS, 6, _PRICES)

# Customers as employees.
_HR = ("hr AS (SELECT c_custkey AS employee_id, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS salary, "
       "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS department, "
       "CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS nickname, c_nationkey AS years_exp FROM customer)")


def _hr(s, d):
    return table(s, d, "customer").selectExpr(
        "c_custkey AS `Employee ID`", "c_name AS Name", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS Salary",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS Department",
        "CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS nickname", "c_nationkey AS `years exp`")


_cleaned("template_hr_data", with_(
    _HR, "u AS (SELECT DISTINCT * FROM hr)", "n AS (SELECT * EXCLUDE (nickname) FROM u)",
    "f AS (" + _replace("n", {"salary": _mode("salary", "n"), "department": _mode("department", "n")}) + ")",
    "z AS (" + _replace("f", {c: _scaled(c, "f") for c in ("salary", "years_exp")}) + ")",
    "w AS (" + _within(["employee_id", "salary", "years_exp"], "z", 2.0) + ")") + _final("w", 8, ["salary", "years_exp"]),
    _hr, TEMPLATES["hr_data"]["steps"], 8, ["salary", "years_exp"])

# Dirty orders as sales and as ledger entries.
_SALES = ("sales AS (SELECT o_orderkey AS order_id, o_totalprice / 20 AS amount, o_orderpriority AS product, o_orderdate AS date, "
          "o_custkey AS customer FROM dirty_orders)")


def _sales(s, d):
    return dirty_orders(s, d).selectExpr(
        "o_orderkey AS `Order ID`", "o_totalprice / 20 AS Amount", "o_orderpriority AS product", "o_orderdate AS date",
        "o_custkey AS customer")


_cleaned("template_sales_data", WITH_ORDERS.rstrip() + ", " + ", ".join([
    _SALES, "u AS (SELECT DISTINCT * FROM sales)",
    "f AS (" + _replace("u", {"amount": "coalesce(amount, 0)", "product": "coalesce(product, '0')", "customer": "coalesce(customer, 0)"})
    + " WHERE coalesce(u.amount, 0) > 0)",
    "w AS (" + _within(["order_id", "amount", "customer"], "f", 2.5) + ")"]) + """
    SELECT *, CASE WHEN amount > 10000 THEN 'high' WHEN amount > 1000 THEN 'medium' ELSE 'low' END AS revenue_category FROM w""",
    _sales, TEMPLATES["sales_data"]["steps"])

_LEDGER = ["transaction_id", "amount", "account"]
_cleaned("template_financial_audit", WITH_ORDERS.rstrip() + ", " + ", ".join([
    "ledger AS (SELECT o_orderkey AS transaction_id, o_totalprice AS amount, coalesce(o_custkey, 0) AS account, o_orderdate AS date, "
    "o_orderpriority AS category FROM dirty_orders)",
    "u AS (SELECT DISTINCT * FROM ledger)", "k AS (SELECT * FROM u WHERE amount IS DISTINCT FROM 0)",
    "w AS (SELECT k.* FROM k, (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(_LEDGER))
    + " FROM k) WHERE " + " AND ".join(f"abs(({c} - m{i}) / s{i}) <= 3" for i, c in enumerate(_LEDGER)) + ")",
    "z AS (" + _replace("w", {c: _scaled(c, "w") for c in _LEDGER}) + ") "]) + _final("z", 8, _LEDGER),
    lambda s, d: dirty_orders(s, d).selectExpr(
        "o_orderkey AS transaction_id", "o_totalprice AS amount", "coalesce(o_custkey, 0) AS account", "o_orderdate AS date",
        "o_orderpriority AS category"), TEMPLATES["financial_audit"]["steps"], 8, _LEDGER)

_cleaned("template_customer_data", """
    WITH c AS (SELECT DISTINCT c_custkey AS customer_id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS country,
               CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS balance FROM customer)
    SELECT customer_id, name, coalesce(country, 'Unknown') AS country FROM c""",
    lambda s, d: table(s, d, "customer").selectExpr(
        "c_custkey AS `Customer ID`", "c_name AS name", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS country",
        "CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS balance"), TEMPLATES["customer_data"]["steps"])

_CATALOG = ("p_partkey AS product_id, p_name AS name, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_retailprice END AS price, "
            "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS stock_quantity")
_CATALOG_EXPRS = [
    "p_partkey AS `Product ID`", "p_name AS name", "CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_retailprice END AS price",
    "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS category",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS stock_quantity"]

_cleaned("template_product_catalog", with_(
    f"p AS (SELECT DISTINCT {_CATALOG} FROM part)",
    "f AS (" + _replace("p", {"category": _mode("category", "p"), "stock_quantity": _mode("stock_quantity", "p")}) + ")",
    "k AS (SELECT * FROM f WHERE price > 0)",
    "z AS (" + _replace("k", {c: _scaled(c, "k") for c in ("price", "stock_quantity")}) + ")") + _final("z", 8, ["price", "stock_quantity"]),
    lambda s, d: table(s, d, "part").selectExpr(*_CATALOG_EXPRS), TEMPLATES["product_catalog"]["steps"], 8, ["price", "stock_quantity"])
_cleaned("template_log_analytics", """
    SELECT DISTINCT ts AS timestamp, CASE event_type WHEN 'view' THEN 'DEBUG' ELSE event_type END AS level, props AS message, user_id
    FROM events WHERE event_type <> 'view'""",
    lambda s, d: table(s, d, "events").selectExpr(
        "ts AS Timestamp", "CASE event_type WHEN 'view' THEN 'DEBUG' ELSE event_type END AS Level", "props AS message",
        "user_id AS `user id`", "CASE WHEN event_id % 10 = 0 THEN 1 END AS sparse"), TEMPLATES["log_analytics"]["steps"])

_FEATURES = ["l_quantity", "l_extendedprice"]
_ALL_NUMERIC = _KEYS + _FEATURES
_cleaned("template_ml_features", with_(
    SQL_DIRTY_LINEITEM, "u AS (SELECT DISTINCT * FROM dirty_lineitem)", "n AS (SELECT * EXCLUDE (l_sparse) FROM u)",
    "f AS (" + _replace("n", {**{c: _median(c, "n") for c in _FEATURES}, "l_returnflag": "coalesce(l_returnflag, 'Unknown')"}) + ")",
    "w AS (" + _within(_ALL_NUMERIC, "f", 1.5) + ")",
    "t AS (" + _replace("w", {c: _standard(c, "w") for c in _ALL_NUMERIC}) + ")",
    "z AS (" + _replace("t", {c: _scaled(c, "t") for c in _ALL_NUMERIC}) + ")") + _final("z", 8, _ALL_NUMERIC),
    dirty_lineitem, TEMPLATES["ml_features"]["steps"], 8, _ALL_NUMERIC)

_cleaned("template_survey_data", with_(
    "s AS (SELECT DISTINCT doc_id AS respondent_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS score, "
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS response FROM labels)")
    + _replace("s", {"score": _mode("score", "s"), "response": _mode("response", "s")}),
    lambda s, d: table(s, d, "labels").selectExpr(
        "doc_id AS `respondent ID`", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS score",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS response", "CASE WHEN doc_id % 3 = 0 THEN quality END AS extra"),
    TEMPLATES["survey_data"]["steps"])

# ---- the runner's log

_STEPS = [
    {"type": "drop_duplicates", "config": {}}, {"type": "no_such_step", "config": {}},
    {"type": "filter_rows", "config": {"column": "o_totalprice", "operator": "gt", "value": 100000}},
    {"type": "drop_nulls", "config": {"columns": ["o_orderpriority"]}}, {"type": "drop_nulls", "config": {"columns": ["nowhere"]}},
    {"type": "drop_columns", "config": {"columns": ["o_orderdate"]}},
]
_LOGGED = ", u AS (SELECT DISTINCT * FROM dirty_orders), a AS (SELECT * FROM u WHERE o_totalprice > 100000), " \
          "b AS (SELECT * FROM a WHERE o_orderpriority IS NOT NULL), n AS (SELECT (SELECT count(*) FROM dirty_orders) AS n0, " \
          "(SELECT count(*) FROM u) AS n1, (SELECT count(*) FROM a) AS n2, (SELECT count(*) FROM b) AS n3) "
query("step_log", WITH_ORDERS + _LOGGED + """
    SELECT 1::INT AS position, 'drop_duplicates' AS step, 'success' AS status, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_delta FROM n
    UNION ALL SELECT 2, 'no_such_step', 'skipped', NULL, NULL, NULL
    UNION ALL SELECT 3, 'filter_rows', 'success', n1, n2, n1 - n2 FROM n
    UNION ALL SELECT 4, 'drop_nulls', 'success', n2, n3, n2 - n3 FROM n
    UNION ALL SELECT 5, 'drop_nulls', 'failed', n3, NULL, NULL FROM n
    UNION ALL SELECT 6, 'drop_columns', 'success', n3, n3, 0 FROM n""")(
    lambda s, d: run_steps(dirty_orders(s, d), _STEPS, metrics=True).log_frame(s).drop("duration_s", "error"))

# ---- statistics that follow arrivals

_BEHIND = ("u AS (SELECT DISTINCT * FROM sales), f AS (SELECT order_id, coalesce(amount, 0) AS amount, coalesce(product, '0') AS product, date, "
           "coalesce(customer, 0) AS customer FROM u WHERE coalesce(amount, 0) > 0)")
query("incremental_states", WITH_ORDERS.rstrip() + ", " + _SALES + ", " + _BEHIND + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls, " + (
        f"round(min({c})::DOUBLE, 6) AS low, round(max({c})::DOUBLE, 6) AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, true AS has_bounds"
        if c in ("order_id", "amount", "customer") else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, false AS has_bounds") + " FROM f"
    for c in ("order_id", "amount", "product", "date", "customer")))(_states)
