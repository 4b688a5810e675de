"""Suites, rules, drift, sensitive data and insight."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.reports import quality as q
from millrace.reports import rules as r

from . import query
from .inputs import (
    COLUMNS, WITH_LINEITEM, WITH_ORDERS, dirty_lineitem, dirty_orders, rounded, share as pct, table, union_all,
)

_RESULT = "SELECT '{e}' AS expectation, {c} AS \"column\", {ok} AS success, {o} AS observed, '{d}' AS detail"


def _row(expectation, column, success, observed="CAST(NULL AS DOUBLE)", detail="", source=""):
    c = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return _RESULT.format(e=expectation, c=c, ok=success, o=observed, d=detail) + (f" FROM {source}" if source else "")


def _bad(expectation, column, bad, source):
    return _row(expectation, column, f"count_if({bad}) = 0", f"count_if({bad})::DOUBLE", source=source)


_REPEATS = "count(*) - count(DISTINCT {c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END"

_SUITE = [
    q.check(q.ROW_COUNT, min_value=1, max_value=10**12),
    q.check(q.EXISTS, "o_orderkey"), q.check(q.EXISTS, "nowhere"),
    q.check(q.NOT_NULL, "o_orderkey"), q.check(q.NOT_NULL, "o_custkey"),
    q.check(q.UNIQUE, "o_orderkey"), q.check(q.UNIQUE, "o_custkey"),
    q.check(q.BETWEEN, "o_totalprice", min_value=1000, max_value=400000), q.check(q.BETWEEN, "o_orderpriority", min_value=1),
    q.check(q.REGEX, "o_orderpriority", regex=r"\d-[A-Z]"),
    q.check(q.IN_SET, "o_orderpriority", value_set=["1-URGENT", "2-HIGH"]),
    q.check(q.MEAN, "o_totalprice", min_value=100000, max_value=400000),
    q.check("expect_something_else", "o_orderkey"), q.check(q.NOT_NULL, "nowhere"),
]
_SUITE_SQL = union_all([
    _row(q.ROW_COUNT, None, "count(*) BETWEEN 1 AND 1000000000000", "count(*)::DOUBLE", source="dirty_orders"),
    _row(q.EXISTS, "o_orderkey", "true"), _row(q.EXISTS, "nowhere", "false"),
    _bad(q.NOT_NULL, "o_orderkey", "o_orderkey IS NULL", "dirty_orders"),
    _bad(q.NOT_NULL, "o_custkey", "o_custkey IS NULL", "dirty_orders"),
    *[_row(q.UNIQUE, c, f"{_REPEATS.format(c=c)} = 0", f"({_REPEATS.format(c=c)})::DOUBLE", source="dirty_orders")
      for c in ("o_orderkey", "o_custkey")],
    _bad(q.BETWEEN, "o_totalprice", "o_totalprice < 1000 OR o_totalprice > 400000", "dirty_orders"),
    _row(q.BETWEEN, "o_orderpriority", "false", detail="not a numeric column"),
    _bad(q.REGEX, "o_orderpriority", r"NOT coalesce(regexp_matches(o_orderpriority, '^(?:\d-[A-Z])'), false)", "dirty_orders"),
    _bad(q.IN_SET, "o_orderpriority", "NOT coalesce(o_orderpriority IN (''1-URGENT'', ''2-HIGH''), false)".replace("''", "'"), "dirty_orders"),
    _row(q.MEAN, "o_totalprice", "avg(o_totalprice) BETWEEN 100000 AND 400000", rounded("avg(o_totalprice)", 4), source="dirty_orders"),
    _row("expect_something_else", "o_orderkey", "false", detail="expectation not known"),
    _row(q.NOT_NULL, "nowhere", "false", detail="column not found"),
])
query("dq_suite", WITH_ORDERS + _SUITE_SQL)(lambda s, d: q.run_suite(dirty_orders(s, d), _SUITE))
query("dq_score", WITH_ORDERS + f""", r AS ({_SUITE_SQL})
    SELECT count_if(success) = count(*) AS success, count(*) AS total, count_if(success) AS passed,
           count_if(NOT success) AS failed, round_even(count_if(success) * 100.0::DOUBLE / count(*), 2) AS success_pct FROM r""")(
    lambda s, d: q.suite_score(q.run_suite(dirty_orders(s, d), _SUITE)))


def _default_sql() -> str:
    t = "dirty_lineitem"
    parts = [_row(q.ROW_COUNT, None, "count(*) >= 1", "count(*)::DOUBLE", source=t)]
    for c, _, kind in COLUMNS[t]:
        parts.append(_row(q.EXISTS, c, "true"))
        parts.append(_bad(q.NOT_NULL, c, f"{c} IS NULL", t) + f" HAVING (count(*) - count({c}))::DOUBLE / count(*) < 0.05")
        if kind == "numeric":
            tail = "round_even(quantile_cont({c}::DOUBLE, {p}), 2)"
            low, high = (f"(SELECT {tail.format(c=c, p=p)} FROM {t})" for p in (0.01, 0.99))
            parts.append(_bad(q.BETWEEN, c, f"{c} < {low} OR {c} > {high}", t))
    return WITH_LINEITEM + union_all(parts)


query("dq_default_suite", _default_sql())(
    lambda s, d: q.run_suite(dirty_lineitem(s, d), q.default_suite(dirty_lineitem(s, d))))


def _lite_sql() -> str:
    t = "dirty_lineitem"
    parts = []
    for c, _, kind in COLUMNS[t]:
        share = pct(f"count(*) - count({c})") + " / 100"
        parts.append(_row(q.EXISTS, c, "true"))
        parts.append(_row(q.NOT_NULL, c, f"{share} < 0.05", share, "null rate", t))
        if kind == "numeric":
            far = f"count_if(abs(({c} - m) / sd) > 3)::DOUBLE / count({c})"
            source = f"{t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd FROM {t})"
            parts.append(_row(q.SPREAD, c, f"{far} < 0.05", rounded(f"{far} * 100", 2), "percent beyond three deviations", source))
            parts.append(_row(q.MEAN, c, "true", rounded(f"avg({c})", 4), "mean", t))
        repeats = _REPEATS.format(c=c)
        parts.append(_row(q.UNIQUE, c, f"{repeats} = 0", f"({repeats})::DOUBLE", "repeated values", t)
                     + f" HAVING round_even(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) = 100")
        if kind == "categorical":
            parts.append(_row(q.DISTINCT, c, "true", f"count(DISTINCT {c})::DOUBLE", "distinct values", t)
                         + f" HAVING count(DISTINCT {c}) < 50")
    return WITH_LINEITEM + union_all(parts)


query("dq_lite", _lite_sql())(lambda s, d: q.automatic_checks(dirty_lineitem(s, d)))


def _profile_suite(s, d):
    from millrace.reports.profile import column_stats

    df = table(s, d, "customer")
    return q.run_suite(df, q.profile_suite(column_stats(df)))


def _profile_suite_sql() -> str:
    t, parts = "customer", []
    for c, _, kind in COLUMNS[t]:
        parts.append(_row(q.EXISTS, c, "true"))
        parts.append(_bad(q.NOT_NULL, c, f"{c} IS NULL", t) + f" HAVING count(*) = count({c})")
        if kind == "numeric":
            ends = f"(SELECT round(min({c})::DOUBLE, 4) AS lo, round(max({c})::DOUBLE, 4) AS hi FROM {t})"
            bad = f"count_if({c} < lo OR {c} > hi)"
            parts.append(_row(q.BETWEEN, c, f"(count({c}) - {bad})::DOUBLE / count({c}) >= 0.99", f"{bad}::DOUBLE", source=f"{t}, {ends}"))
        parts.append(_row(q.UNIQUE, c, f"{_REPEATS.format(c=c)} = 0", f"({_REPEATS.format(c=c)})::DOUBLE", source=t)
                     + f" HAVING round_even(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) = 100")
    return union_all(parts)


query("dq_profile_suite", _profile_suite_sql())(_profile_suite)

query("dq_file_gate", WITH_LINEITEM + """
    SELECT l_returnflag AS file, true AS has_rows, count(l_sparse) > 0 AND count(l_quantity) > 0 AND count(empty) > 0 AS no_empty_column,
           true AS has_columns, CAST(2 + CASE WHEN count(l_sparse) > 0 AND count(l_quantity) > 0 AND count(empty) > 0 THEN 1 ELSE 0 END AS BIGINT) AS passed,
           CAST(3 AS BIGINT) AS total,
           CASE WHEN count(l_sparse) > 0 AND count(l_quantity) > 0 AND count(empty) > 0 THEN 100.0::DOUBLE ELSE 66.7::DOUBLE END AS pct
    FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN l_partkey END AS empty FROM dirty_lineitem) GROUP BY 1""")(
    lambda s, d: q.file_gate(
        dirty_lineitem(s, d).withColumn("empty", F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))
        .select("l_returnflag", "l_sparse", "l_quantity", "empty"), "l_returnflag"))
query("dq_model_tests", WITH_ORDERS + union_all([
    *[_bad(q.NOT_NULL, c, f"{c} IS NULL", "dirty_orders") for c in ("o_orderkey", "o_custkey", "o_totalprice")],
    _row(q.UNIQUE, "o_orderkey", f"{_REPEATS.format(c='o_orderkey')} = 0", f"({_REPEATS.format(c='o_orderkey')})::DOUBLE", source="dirty_orders")]))(
    lambda s, d: q.model_tests(dirty_orders(s, d), ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderkey"]))

# ---- rules: (rule, failing row, expected, actual)

_N = "count_if({bad})"
_RULES = [
    ({"rule_type": "not_null", "column": "o_custkey"}, "o_custkey IS NULL", "0 nulls", "{n} || ' nulls'"),
    ({"rule_type": "min_value", "column": "o_totalprice", "params": {"value": 5000}}, "o_totalprice < 5000", ">= 5000.0", "'min = ' || min(o_totalprice)"),
    ({"rule_type": "max_value", "column": "o_totalprice", "params": {"value": 450000}}, "o_totalprice > 450000", "<= 450000.0", "'max = ' || max(o_totalprice)"),
    ({"rule_type": "between", "column": "o_custkey", "params": {"min": 10, "max": 1000}, "severity": "warning"},
     "NOT o_custkey BETWEEN 10 AND 1000", "between 10.0 and 1000.0", "{n} || ' values out of range'"),
    ({"rule_type": "regex_match", "column": "o_orderpriority", "params": {"pattern": "[1-4]-"}},
     "NOT regexp_matches(o_orderpriority, '^[1-4]-')", "matches /[1-4]-/", "{n} || ' non-matching'"),
    ({"rule_type": "allowed_values", "column": "o_orderpriority", "params": {"values": "1-URGENT, 2-HIGH"}},
     "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "in [''1-URGENT'', ''2-HIGH'']", "{n} || ' disallowed'"),
    ({"rule_type": "min_length", "column": "o_orderpriority", "params": {"value": 6}}, "length(o_orderpriority) < 6", "length >= 6", "{n} || ' too short'"),
    ({"rule_type": "max_length", "column": "o_orderpriority", "params": {"value": 10}}, "length(o_orderpriority) > 10", "length <= 10", "{n} || ' too long'"),
    ({"rule_type": "min_value", "column": "o_totalprice", "params": {"value": 0}, "name": "not negative"}, "o_totalprice < 0", ">= 0.0", "'min = ' || min(o_totalprice)"),
]
_ALL_RULES = [rule for rule, *_ in _RULES] + [
    {"rule_type": "row_count_min", "params": {"value": 10}}, {"rule_type": "no_duplicates", "severity": "warning"},
    {"rule_type": "unique", "column": "o_orderkey"}, {"rule_type": "null_threshold", "column": "o_custkey", "params": {"value": 16}},
    {"rule_type": "null_threshold", "column": "o_totalprice"}, {"rule_type": "not_null", "column": "nowhere"},
    {"rule_type": "no_such_rule", "column": "o_custkey"},
]


def _rule_row(rule, expected, actual, status, bad, source="FROM dirty_orders"):
    c = rule.get("column", "")
    name = rule.get("name", f"{rule['rule_type']} on {c}")
    return (f"SELECT '{name}' AS rule_name, '{c}' AS \"column\", '{rule['rule_type']}' AS rule_type, '{expected}' AS expected, "
            f"{actual} AS actual, {status} AS status, {bad} AS failing_rows_count {source}")


def _rules_sql() -> str:
    parts = []
    for rule, bad, expected, actual in _RULES:
        n = _N.format(bad=bad)
        bad_status = "warning" if rule.get("severity") == "warning" else "failed"
        parts.append(_rule_row(rule, expected, actual.format(n=n), f"CASE WHEN {n} > 0 THEN '{bad_status}' ELSE 'passed' END", n))
    copies = "((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)))"
    repeats = _REPEATS.format(c="o_orderkey")
    low, high = pct("count(*) - count(o_custkey)"), pct("count(*) - count(o_totalprice)")
    rest = _ALL_RULES[len(_RULES):]
    parts += [
        _rule_row(rest[0], ">= 10 rows", "count(*) || ' rows'", "CASE WHEN count(*) >= 10 THEN 'passed' ELSE 'failed' END", "0::BIGINT"),
        _rule_row(rest[1], "0 duplicate rows", f"{copies} || ' duplicate rows'", f"CASE WHEN {copies} > 0 THEN 'warning' ELSE 'passed' END", copies, ""),
        _rule_row(rest[2], "all unique", f"({repeats}) || ' duplicates'", f"CASE WHEN {repeats} > 0 THEN 'failed' ELSE 'passed' END", repeats),
        _rule_row(rest[3], "null% < 16.0%", f"{low} || '%'", f"CASE WHEN {low} >= 16 THEN 'failed' WHEN {low} >= 12.8 THEN 'warning' ELSE 'passed' END",
                  f"CASE WHEN {low} >= 16 THEN count(*) - count(o_custkey) ELSE 0 END"),
        _rule_row(rest[4], "null% < 5.0%", f"{high} || '%'", f"CASE WHEN {high} >= 5 THEN 'failed' WHEN {high} >= 4 THEN 'warning' ELSE 'passed' END",
                  f"CASE WHEN {high} >= 5 THEN count(*) - count(o_totalprice) ELSE 0 END"),
        _rule_row(rest[5], "", "'Column ''nowhere'' not found'", "'failed'", "0::BIGINT", ""),
        _rule_row(rest[6], "", "'Unknown rule type: no_such_rule'", "'failed'", "0::BIGINT", ""),
    ]
    return union_all(parts)


def _run(s, d):
    return r.run_rules(dirty_orders(s, d), _ALL_RULES, ["o_orderkey"])


query("rules_run", WITH_ORDERS + _rules_sql())(lambda s, d: _run(s, d).drop("failing_row_examples"))
query("rules_status", WITH_ORDERS + f""", r AS ({_rules_sql()})
    SELECT count_if(status = 'passed') AS passed, count_if(status = 'failed') AS failed, count_if(status = 'warning') AS warnings,
           CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' WHEN count_if(status = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS overall_status
    FROM r""")(lambda s, d: r.overall_status(_run(s, d)))
_EXAMPLES = {"o_custkey_null": ("not_null", "o_custkey", "o_custkey IS NULL"), "short": ("min_length", "o_orderpriority", "length(o_orderpriority) < 6")}
query("rule_examples", WITH_ORDERS + union_all([f"""
    SELECT rule_type, "column", position, orderkey FROM (
        SELECT '{k}' AS rule_type, '{c}' AS "column", row_number() OVER (ORDER BY o_orderkey)::INT AS position,
               o_orderkey::VARCHAR AS orderkey FROM dirty_orders WHERE {bad}) WHERE position <= 5""" for k, c, bad in _EXAMPLES.values()]))(
    lambda s, d: r.run_rules(dirty_orders(s, d), [
        {"rule_type": "not_null", "column": "o_custkey"},
        {"rule_type": "min_length", "column": "o_orderpriority", "params": {"value": 6}}], ["o_orderkey"])
    .select("rule_type", "column", F.posexplode("failing_row_examples").alias("p", "row"))
    .select("rule_type", "column", (F.col("p") + 1).alias("position"), F.col("row")[0].alias("orderkey")))


def _ten_examples(s, d, rule):
    found = r.run_rules(dirty_orders(s, d), [rule], ["o_orderkey"], examples=10)
    return found.select(F.posexplode("failing_row_examples").alias("p", "row")).select(
        (F.col("p") + 1).alias("position"), F.col("row")[0].alias("orderkey"))


_TEN = "SELECT row_number() OVER (ORDER BY o_orderkey)::INT AS position, o_orderkey::VARCHAR AS orderkey FROM {rows} QUALIFY position <= 10"
query("rule_examples_repeats", WITH_ORDERS + _TEN.format(
    rows="(SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey) AS copy FROM dirty_orders) WHERE copy > 1"))(
    lambda s, d: _ten_examples(s, d, {"rule_type": "no_duplicates"}))
query("rule_examples_unique", WITH_ORDERS + _TEN.format(
    rows="(SELECT o_orderkey FROM dirty_orders QUALIFY count(*) OVER (PARTITION BY o_orderkey) > 1)"))(
    lambda s, d: _ten_examples(s, d, {"rule_type": "unique", "column": "o_orderkey"}))
