"""Drift between two versions of a table, sensitive columns, and what a profile suggests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import SENSITIVE_PATTERNS
from millrace.reports import drift, insight, sensitive
from millrace.reports.profile import profile
from millrace.sources.scratch import scratch_path

from . import SQL, query
from .inputs import COLUMNS, SQL_LINEITEM_V2, lineitem_v2, names, profile_sql, share, table, union_all, with_


def _light_sql(t: str) -> str:
    parts = []
    for c, dtype, kind in COLUMNS[t]:
        numeric = kind == "numeric"
        ends = ", ".join(f"CASE WHEN {f}({c}) = 0 THEN 0.0::DOUBLE ELSE {f}({c})::DOUBLE END AS {f}" if numeric else f"CAST(NULL AS DOUBLE) AS {f}" for f in ("min", "max"))
        mean = f"avg({c})::DOUBLE" if numeric else "CAST(NULL AS DOUBLE)"
        unique = "CAST(NULL AS BIGINT)" if numeric else f"count(DISTINCT {c})"
        parts.append(f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, '{'numeric' if numeric else 'categorical'}' AS kind, "
                     f"{share(f'count(*) - count({c})')} AS missing_pct, {ends}, round({mean}, 4) AS mean, "
                     f"{unique} AS \"unique\" FROM {t}")
    return union_all(parts)


_SETS = f"""a AS (SELECT unnest({names('lineitem')}) AS c), b AS (SELECT unnest({names('lineitem_v2')}) AS c)"""
_COMPARED = f"""a AS ({_light_sql('lineitem')}), b AS ({_light_sql('lineitem_v2')}), compared AS (
    SELECT coalesce(a."column", b."column") AS "column", a."column" IS NOT NULL AS in_baseline, b."column" IS NOT NULL AS in_new,
           coalesce(a.dtype, '—') AS baseline_dtype, coalesce(b.dtype, '—') AS new_dtype,
           coalesce(a.missing_pct, 0) AS baseline_null_pct, coalesce(b.missing_pct, 0) AS new_null_pct,
           a.min AS baseline_min, a.max AS baseline_max, b.min AS new_min, b.max AS new_max,
           coalesce(a.dtype <> b.dtype, false) AS dtype_changed,
           coalesce(abs(b.missing_pct - a.missing_pct) > 10, false) AS null_rate_changed,
           coalesce(a.kind = 'numeric' AND b.kind = 'numeric' AND a.max > a.min
             AND (abs(b.min - a.min) / nullif(a.max - a.min, 0) > 0.2 OR abs(b.max - a.max) / nullif(a.max - a.min, 0) > 0.2), false) AS range_changed
    FROM a FULL JOIN b ON a."column" = b."column")"""
_WITH = with_(SQL_LINEITEM_V2, _COMPARED)


def _compared(s, d):
    return drift.compare(drift.light_profile(table(s, d, "lineitem")), drift.light_profile(lineitem_v2(s, d)))


query("light_profile", with_(SQL_LINEITEM_V2) + _light_sql("lineitem_v2"))(
    lambda s, d: drift.light_profile(lineitem_v2(s, d)).withColumn("mean", F.round("mean", 4)))
query("drift_compare", _WITH + "SELECT * FROM compared")(_compared)
query("drift_type_changes", _WITH + "SELECT \"column\", baseline_dtype, new_dtype FROM compared WHERE dtype_changed")(
    lambda s, d: _compared(s, d).filter("dtype_changed").select("column", "baseline_dtype", "new_dtype"))
query("drift_null_changes", _WITH + "SELECT \"column\", baseline_null_pct, new_null_pct FROM compared WHERE null_rate_changed")(
    lambda s, d: _compared(s, d).filter("null_rate_changed").select("column", "baseline_null_pct", "new_null_pct"))
query("drift_range_changes", _WITH + "SELECT \"column\", baseline_min, baseline_max, new_min, new_max FROM compared WHERE range_changed")(
    lambda s, d: _compared(s, d).filter("range_changed").select("column", "baseline_min", "baseline_max", "new_min", "new_max"))
query("drift_score", _WITH + """, counted AS (
        SELECT count(*) AS n, count_if(NOT in_baseline) AS added, count_if(NOT in_new) AS removed, count_if(dtype_changed) AS type_changes,
               count_if(null_rate_changed) AS nullable_changes, count_if(range_changed) AS range_changes FROM compared),
    scored AS (SELECT *, least(round_even((added * 25 + removed * 30 + type_changes * 25 + nullable_changes * 10
               + range_changes * 10)::DOUBLE / n, 1), 100.0::DOUBLE) AS drift_score FROM counted)
    SELECT added, removed, type_changes, nullable_changes, range_changes, drift_score,
           CASE WHEN drift_score = 0 THEN 'none' WHEN drift_score <= 15 THEN 'low' WHEN drift_score <= 45 THEN 'medium' ELSE 'critical' END AS severity
    FROM scored""")(lambda s, d: drift.drift_score(_compared(s, d)))


def _recorded(s, d):
    """The comparison, appended to a history of its own and read back."""
    path = scratch_path(s, "drift")
    drift.record_drift(s, path, ("a", "lineitem"), ("b", "lineitem_v2"), drift.drift_score(_compared(s, d)))
    return drift.drift_history(drift.read_history(s, path), "b").drop("compared_at")


_SCORED = SQL["drift_score"]
query("drift_record", f"""SELECT 'a' AS baseline_id, 'b' AS new_id, 'lineitem' AS baseline_name, 'lineitem_v2' AS new_name,
    drift_score, severity FROM ({_SCORED})""")(_recorded)
query("set_columns", f"""WITH {_SETS}
    SELECT coalesce(a.c, b.c) AS "column", a.c IS NOT NULL AS in_baseline, b.c IS NOT NULL AS in_new,
           CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'common' END AS change
    FROM a FULL JOIN b ON a.c = b.c""")(lambda s, d: drift.column_sets(table(s, d, "lineitem"), lineitem_v2(s, d)))
query("drift_history", """
    SELECT o_custkey::VARCHAR AS baseline_id, (o_orderkey // 10)::VARCHAR AS new_id, o_totalprice AS drift_score, o_orderdate AS compared_at
    FROM orders WHERE o_custkey = 42 OR o_orderkey // 10 = 42 ORDER BY o_orderdate DESC""")(
    lambda s, d: drift.drift_history(table(s, d, "orders").selectExpr(
        "cast(o_custkey as string) AS baseline_id", "cast(o_orderkey div 10 as string) AS new_id",
        "o_totalprice AS drift_score", "o_orderdate AS compared_at"), "42"))

# ---- sensitive data

_STARTS = r"coalesce(regexp_matches({c}, '^(?:{p})'), false)"
query("pii_content", union_all([
    f"SELECT '{c}' AS \"column\", '{k}' AS pii_type, count_if({_STARTS.format(c=c, p=p)}) AS match_count FROM documents"
    for c in ("text", "source") for k, p in SENSITIVE_PATTERNS.items()]))(
    lambda s, d: sensitive.pattern_counts(table(s, d, "documents"), ["text", "source"]))

# Customers with made-up contact columns, so that the content test has something to find.
_CONTACTS = {
    "c_custkey": "c_custkey",
    "contact": "CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@example.org' ELSE 'none' END",
    "line": "'+49 30 ' || (10000000 + c_custkey)",
    "tax_no": "CASE WHEN c_custkey % 10 < 8 THEN '123-45-' || (1000 + c_custkey) ELSE '-' END",
    "c_name": "c_name", "c_mktsegment": "c_mktsegment",
}
_CONTACTS_SQL = "contacts AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CONTACTS.items()) + " FROM customer)"


def _contacts(s, d):
    return table(s, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in _CONTACTS.items()])


def _finding_sql(c: str) -> str:
    if "name" in c:
        return f"SELECT '{c}' AS \"column\", 'name_based' AS pii_type, 'high' AS confidence, count({c}) AS match_count FROM contacts"
    counted = ", ".join(f"count_if({_STARTS.format(c=f'{c}::VARCHAR', p=p)}) AS {k}" for k, p in SENSITIVE_PATTERNS.items())
    kinds = list(SENSITIVE_PATTERNS)
    first = "CASE " + " ".join(f"WHEN {k} > 0.3 * n THEN '{k}'" for k in kinds) + " END"
    n = "CASE " + " ".join(f"WHEN {k} > 0.3 * n THEN {k}" for k in kinds) + " END"
    return (f"SELECT '{c}' AS \"column\", pii_type, CASE WHEN hits > 0.7 * n THEN 'high' ELSE 'medium' END AS confidence, hits AS match_count "
            f"FROM (SELECT {first} AS pii_type, {n} AS hits, n FROM (SELECT {counted}, count({c}) AS n FROM contacts)) WHERE pii_type IS NOT NULL")


_FINDINGS = union_all([_finding_sql(c) for c in _CONTACTS])
query("pii_scan", f"WITH {_CONTACTS_SQL} {_FINDINGS}")(lambda s, d: sensitive.sensitive_columns(_contacts(s, d)))
query("pii_names", "SELECT 'c_name' AS \"column\", 'name_based' AS pii_type, 'high' AS confidence, count(c_name) AS match_count FROM customer")(
    lambda s, d: sensitive.sensitive_columns(table(s, d, "customer")).filter("pii_type = 'name_based'"))
query("pii_sample", f"""WITH {_CONTACTS_SQL.replace('FROM customer', 'FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50)')} {_FINDINGS}""")(
    lambda s, d: sensitive.sensitive_columns(_contacts(s, d), sample=50, order_by=["c_custkey"]))
query("pii_risk", f"""WITH {_CONTACTS_SQL}, f AS ({_FINDINGS})
    SELECT count(*) AS pii_count, CASE WHEN count(*) > 2 THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'low' END AS risk_level,
           CAST({len(_CONTACTS)} AS BIGINT) AS columns_scanned FROM f""")(
    lambda s, d: sensitive.risk_level(sensitive.sensitive_columns(_contacts(s, d)), len(_CONTACTS)))

# ---- insight

_MEANING = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(\"column\"), '{p}')" for p in parts) + f" THEN '{k}'"
    for k, parts in insight.MEANINGS.items()) + " ELSE 'unknown' END"
_SKEWED = with_("lineitem_x AS (SELECT l_extendedprice * l_extendedprice * l_quantity * l_quantity AS very_skewed_pay, "
                "l_quantity AS age, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END AS office_code, l_orderkey AS order_id FROM lineitem)")
COLUMNS["lineitem_x"] = [("very_skewed_pay", "double", "numeric"), ("age", "double", "numeric"),
                         ("office_code", "string", "categorical"), ("order_id", "bigint", "numeric")]


def _skewed(s, d):
    return profile(table(s, d, "lineitem").selectExpr(
        "l_extendedprice * l_extendedprice * l_quantity * l_quantity AS very_skewed_pay", "l_quantity AS age",
        "CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END AS office_code", "l_orderkey AS order_id"))


_INSIGHT = f"""p AS ({profile_sql('lineitem_x')}), i AS (
    SELECT "column", {_MEANING} AS semantic_type,
           array_to_string(list_transform(string_split(replace("column", '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
           missing_pct > 20 AS high_missing,
           concat_ws(',', CASE WHEN missing_pct > 0 THEN 'fill_missing' END, CASE WHEN kind = 'numeric' THEN 'normalize' END,
             CASE WHEN kind = 'numeric' AND abs(skew) > 1 THEN 'remove_outliers' END,
             CASE WHEN kind = 'categorical' THEN 'standardize_categories' END) AS suggested_steps FROM p)"""
_WITH_I = _SKEWED.rstrip() + ", " + _INSIGHT
query("semantic_types", _WITH_I + " SELECT *, semantic_type IN ('name', 'email', 'phone', 'address') AS is_pii FROM i")(
    lambda s, d: insight.column_insight(_skewed(s, d)).withColumn("suggested_steps", F.array_join("suggested_steps", ",")))
query("suggest_steps", _WITH_I + " SELECT \"column\", suggested_steps FROM i")(
    lambda s, d: insight.column_insight(_skewed(s, d)).select("column", F.array_join("suggested_steps", ",").alias("suggested_steps")))
query("issue_list", _WITH_I + """
    SELECT "column", 'fill_missing' AS step, 'high' AS priority, missing_pct AS observed FROM p WHERE missing_pct > 30
    UNION ALL SELECT "column", 'remove_outliers', 'medium', skew FROM p WHERE kind = 'numeric' AND abs(skew) > 2""")(
    lambda s, d: insight.issue_list(_skewed(s, d)))
query("join_candidates", _WITH_I + """
    SELECT count(*) AS columns, string_agg(CASE WHEN semantic_type = 'id' THEN "column" END, ',' ORDER BY "column") AS join_candidates,
           count_if(semantic_type IN ('name', 'email', 'phone', 'address')) AS pii_count,
           CASE WHEN count_if(semantic_type IN ('name', 'email', 'phone', 'address')) > 2 THEN 'high'
                WHEN count_if(semantic_type IN ('name', 'email', 'phone', 'address')) > 0 THEN 'medium' ELSE 'low' END AS pii_risk FROM i""")(
    lambda s, d: insight.dataset_insight(insight.column_insight(_skewed(s, d))))
