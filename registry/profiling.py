"""Profiles, histograms, top values, correlations, outliers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from millrace.reports import profile as prof

from . import query
from .inputs import (
    WITH_EVENTS, WITH_LINEITEM, dirty_events, dirty_lineitem, names, profile_sql, rounded, share, table, union_all,
)

query("profile", profile_sql("lineitem"))(lambda s, d: prof.profile(table(s, d, "lineitem")))
query("profile_with_nulls", WITH_LINEITEM + profile_sql("dirty_lineitem"))(lambda s, d: prof.profile(dirty_lineitem(s, d)))
query("profile_approx")(lambda s, d: prof.profile(table(s, d, "lineitem"), approx=True))


def _approx_error(s, d):
    """The columns that stay exact, and whether the others lie within the sketches' error of the exact profile."""
    near, exact = (prof.profile(table(s, d, "lineitem"), approx=a) for a in (True, False))
    exact = exact.select("column", *[F.col(c).alias(f"_{c}") for c in ("unique", "q1", "median", "q3")])
    hundredth = (F.col("max") - F.col("min")) * 0.01
    close = F.lit(True)
    for c in ("q1", "median", "q3"):
        close = close & (F.abs(F.col(c) - F.col(f"_{c}")) <= hundredth)
    return near.join(exact, "column").select(
        "column", "dtype", "kind", "total", "missing", "min", "max", "mean", "std", "zeros", "negatives",
        (F.abs(F.col("unique") - F.col("_unique")) <= 0.2 * F.col("_unique")).alias("unique_close"), close.alias("quartiles_close"))


query("profile_approx_error", f"""
    SELECT "column", dtype, kind, total, missing, min, max, mean, std, zeros, negatives, true AS unique_close,
           CASE WHEN kind = 'numeric' THEN true END AS quartiles_close FROM ({profile_sql("lineitem")})""")(_approx_error)
query("profile_datetime", union_all([
    f"SELECT '{c}' AS \"column\", min({c})::VARCHAR AS min, max({c})::VARCHAR AS max FROM {t}" for c, t in [("ts", "events")]]))(
    lambda s, d: prof.datetime_profile(table(s, d, "events")))


def _sample_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY event_id)::INT AS position, v AS value
               FROM (SELECT event_id, {c}::VARCHAR AS v FROM dirty_events WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 5)"""


query("profile_sample", WITH_EVENTS + union_all([_sample_sql(c) for c in names("dirty_events")]))(
    lambda s, d: prof.sample_values(dirty_events(s, d), ["event_id"]).select("column", "position", "value"))

query("top_values", WITH_LINEITEM + union_all([f"""
    SELECT '{c}' AS "column", value, n AS count, row_number() OVER (ORDER BY n DESC, value)::INT AS rank
    FROM (SELECT {c} AS value, count(*) AS n FROM dirty_lineitem WHERE {c} IS NOT NULL GROUP BY 1)
    QUALIFY rank <= 15""" for c in names("dirty_lineitem", "categorical")]))(
    lambda s, d: prof.top_values(dirty_lineitem(s, d)))
query("top_values_of_texts", """
    SELECT 'text' AS "column", value, n AS count, row_number() OVER (ORDER BY n DESC, value)::INT AS rank
    FROM (SELECT text AS value, count(*) AS n FROM documents GROUP BY 1) QUALIFY rank <= 10""")(
    lambda s, d: prof.top_values(table(s, d, "documents"), ["text"], 10))

_HISTOGRAM = """
    SELECT '{c}' AS "column", g.bin, {lo2} AS lo, {hi2} AS hi, coalesce(h.n, 0) AS count FROM (
        SELECT b::INT AS bin, lo + b * (hi - lo) / n AS lo, CASE WHEN b = n - 1 THEN hi ELSE lo + (b + 1) * (hi - lo) / n END AS hi
        FROM (SELECT lo, hi, n, unnest(range(0, n)) AS b FROM {e})) g
    LEFT JOIN (
        SELECT least(floor(({c} - lo) / (hi - lo) * n), n - 1)
               - CASE WHEN {c} < lo + least(floor(({c} - lo) / (hi - lo) * n), n - 1) * ((hi - lo) / n) THEN 1 ELSE 0 END
               + CASE WHEN least(floor(({c} - lo) / (hi - lo) * n), n - 1) < n - 1
                       AND {c} >= lo + (least(floor(({c} - lo) / (hi - lo) * n), n - 1) + 1) * ((hi - lo) / n) THEN 1 ELSE 0 END AS bin,
               count(*) AS n FROM {t}, {e} WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = g.bin"""


def _histogram_sql(t: str, c: str) -> str:
    ends = (f"(SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, least(20, greatest(count(DISTINCT {c}), 2)) AS n FROM {t}) e")
    return _HISTOGRAM.format(c=c, t=t, e=ends, lo2=rounded("g.lo", 2), hi2=rounded("g.hi", 2))


query("histogram", WITH_LINEITEM + union_all([_histogram_sql("dirty_lineitem", c) for c in names("dirty_lineitem", "numeric")]))(
    lambda s, d: prof.histogram(dirty_lineitem(s, d)))

query("missing_report", WITH_LINEITEM + union_all([f"""
    SELECT '{c}' AS "column", count(*) - count({c}) AS count, {share(f"count(*) - count({c})")} AS pct
    FROM dirty_lineitem""" for c in names("dirty_lineitem")]))(
    lambda s, d: prof.missing_report(dirty_lineitem(s, d)))

# Prices multiplied by themselves have a long upper tail, so that some rows are outliers.
_TAIL = "SELECT l_extendedprice * l_extendedprice AS squared, l_quantity, l_extendedprice * l_quantity * l_quantity AS steep FROM lineitem"


def _tail(s, d):
    return table(s, d, "lineitem").selectExpr(
        "l_extendedprice * l_extendedprice AS squared", "l_quantity", "l_extendedprice * l_quantity * l_quantity AS steep")


query("outlier_report", f"WITH t AS ({_TAIL}) SELECT * FROM (" + union_all([f"""
    SELECT '{c}' AS "column", count_if({c} < lo OR {c} > hi) AS iqr_outliers, count_if(abs(({c} - m) / sd) > 3) AS zscore_outliers,
           round(any_value(lo), 4) AS iqr_lo, round(any_value(hi), 4) AS iqr_hi,
           {share(f"count_if({c} < lo OR {c} > hi)", f"count({c})")} AS pct_flagged
    FROM t, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m, sd FROM (
        SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS sd FROM t))
    WHERE {c} IS NOT NULL""" for c in ("squared", "l_quantity", "steep")]) + ") WHERE iqr_outliers > 0 OR zscore_outliers > 0")(
    lambda s, d: prof.outlier_report(_tail(s, d)).select(
        "column", "iqr_outliers", "zscore_outliers", F.round("iqr_lo", 4).alias("iqr_lo"), F.round("iqr_hi", 4).alias("iqr_hi"),
        "pct_flagged"))

query("correlation", WITH_LINEITEM + union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {rounded(f'corr({a}, {b})', 3)} AS r FROM dirty_lineitem"
    for a, b in product(names("dirty_lineitem", "numeric"), repeat=2)]))(
    lambda s, d: prof.correlation(dirty_lineitem(s, d)))
