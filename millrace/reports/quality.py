"""Data-quality suites: lists of checks that one fused pass answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, text
from ..functions.columns import CATEGORICAL, NUMERIC, col, kinds, numeric_columns
from ..functions.stats import value
from .profile import column_stats, pct

# The check names a suite may use.
EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
BETWEEN = "expect_column_values_to_be_between"
REGEX = "expect_column_values_to_match_regex"
IN_SET = "expect_column_values_to_be_in_set"
ROW_COUNT = "expect_table_row_count_to_be_between"
MEAN = "expect_column_mean_to_be_between"
SPREAD = "expect_column_values_within_iqr_range"
DISTINCT = "expect_column_distinct_values_to_be_in_set"

RESULT = "expectation string, column string, success boolean, observed double, detail string"


def check(expectation: str, column: str | None = None, **kwargs) -> dict:
    return {"expectation": expectation, "kwargs": {**({"column": column} if column else {}), **kwargs}}


def repeats(df: DataFrame, columns: list[str], total: int, nulls: dict[str, int]) -> dict[str, int]:
    """Values beyond the first of their kind; nulls repeat each other."""
    unique = stats.distinct_counts(df, columns)
    return {c: total - unique[c] - (1 if nulls[c] else 0) for c in columns}


def _bad_values(df: DataFrame, expectation: str, kw: dict):
    """Counts the values that break a per-value check, or None if it cannot be asked of the column."""
    c = kw["column"]
    v = value(df, c)
    if expectation == NOT_NULL:
        return F.count_if(v.isNull())
    if expectation == BETWEEN and kinds(df)[c] == NUMERIC:
        low, high = kw.get("min_value"), kw.get("max_value")
        out = F.lit(False) if low is None else v < F.lit(low)
        return F.count_if(out if high is None else out | (v > F.lit(high)))
    if expectation == REGEX:
        return F.count_if(~F.coalesce(text.starts_with_match(v, kw.get("regex", ".*")), F.lit(False)))
    if expectation == IN_SET:
        wanted = [x for x in kw.get("value_set", []) if x is not None]
        of_type = [x for x in wanted if isinstance(x, str) == isinstance(df.schema[c].dataType, T.StringType)]
        return F.count_if(~F.coalesce(v.isin(of_type), F.lit(False)) if of_type else F.lit(True))
    return None


def run_suite(df: DataFrame, suite: list[dict]) -> DataFrame:
    """One result row per check, in order; unknown checks and missing columns fail with a note."""
    wanted: dict = {None: F.count(F.lit(1))}
    for i, item in enumerate(suite):
        name, kw = item["expectation"], item.get("kwargs", {})
        c = kw.get("column")
        if c is None or c not in df.columns:
            continue
        if name == UNIQUE:
            wanted[c, "n"] = F.count(value(df, c))
        elif name == MEAN and kinds(df)[c] == NUMERIC:
            wanted[i] = F.avg(value(df, c).cast("double"))
        elif (bad := _bad_values(df, name, kw)) is not None:
            wanted[i] = bad
            wanted[c, "n"] = F.count(value(df, c))
    got = stats.measure(df, wanted, fields=1)
    total = got[None]
    keyed = list(dict.fromkeys(
        x["kwargs"]["column"] for x in suite if x["expectation"] == UNIQUE and x["kwargs"].get("column") in df.columns))
    repeated = repeats(df, keyed, total, {c: total - got[c, "n"] for c in keyed})

    rows = []
    for i, item in enumerate(suite):
        name, kw = item["expectation"], item.get("kwargs", {})
        c = kw.get("column")
        ok, observed, detail = False, None, ""
        if name == EXISTS:
            ok = c in df.columns
        elif name == ROW_COUNT:
            observed = float(total)
            ok = kw.get("min_value", 0) <= total <= kw.get("max_value", float("inf"))
        elif c is not None and c not in df.columns:
            detail = "column not found"
        elif name == UNIQUE:
            observed = float(repeated[c])
            ok = observed == 0
        elif i in got and name == MEAN:
            observed = got[i]
            low, high = kw.get("min_value", -float("inf")), kw.get("max_value", float("inf"))
            ok = observed is not None and low <= observed <= high
            observed = None if observed is None else round(observed, 4)
        elif i in got:
            observed = float(got[i])
            tested = got[c, "n"]
            ok = observed == 0 if "mostly" not in kw else not tested or (tested - observed) / tested >= kw["mostly"]
        else:
            detail = "not a numeric column" if name in (BETWEEN, MEAN) else "expectation not known"
        rows.append((name, c, ok, observed, detail))
    return df.sparkSession.createDataFrame(rows, RESULT)


def suite_score(results: DataFrame) -> DataFrame:
    passed, total = F.count_if("success"), F.count(F.lit(1))
    return results.agg(
        (passed == total).alias("success"), total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        F.coalesce(F.bround(F.try_divide(passed * 100.0, total).cast("double"), 2), F.lit(0.0)).alias("success_pct"))


def default_suite(df: DataFrame) -> list[dict]:
    """At least one row; no nulls where they are rare; numbers between their 1st and 99th percentile."""
    total, nulls = stats.null_counts(df)
    tails = stats.quantiles(df, numeric_columns(df), [0.01, 0.99])
    suite = [check(ROW_COUNT, min_value=1)]
    for c in df.columns:
        suite.append(check(EXISTS, c))
        if total and nulls[c] / total < 0.05:
            suite.append(check(NOT_NULL, c))
        if c in tails and tails[c][0] is not None:
            suite.append(check(BETWEEN, c, min_value=round(tails[c][0], 2), max_value=round(tails[c][1], 2)))
    return suite


def profile_suite(measured: list[dict]) -> list[dict]:
    """What the profile promises: complete columns stay complete, ranges hold, keys stay unique."""
    suite = []
    for s in measured:
        c = s["column"]
        suite.append(check(EXISTS, c))
        if s["missing_pct"] == 0:
            suite.append(check(NOT_NULL, c))
        if s["kind"] == NUMERIC:
            suite.append(check(BETWEEN, c, min_value=round(float(s["min"]), 4), max_value=round(float(s["max"]), 4), mostly=0.99))
        if s["unique_pct"] == 100:
            suite.append(check(UNIQUE, c))
    return suite


def automatic_checks(df: DataFrame, measured: list[dict] | None = None) -> DataFrame:
    """The built-in suite: completeness, share of extreme values, keys, small value sets."""
    measured = measured or column_stats(df)
    wide = {s["column"]: F.count_if(F.abs((value(df, s["column"]) - F.lit(float(s["mean"]))) / F.lit(float(s["std_pop"]))) > 3)
            for s in measured if s["kind"] == NUMERIC and s["n"] > 3 and s["std_pop"]}
    extreme = stats.measure(df, wide, fields=1) if wide else {}
    rows = []
    for s in measured:
        c = s["column"]
        rows.append((EXISTS, c, True, None, ""))
        null_rate = s["missing_pct"] / 100
        rows.append((NOT_NULL, c, null_rate < 0.05, null_rate, "null rate"))
        if s["kind"] == NUMERIC:
            share = extreme.get(c, 0) / s["n"]
            rows.append((SPREAD, c, share < 0.05, round(share * 100, 2), "percent beyond three deviations"))
            rows.append((MEAN, c, True, round(float(s["mean"]), 4), "mean"))
        if s["unique_pct"] == 100:
            repeated = s["total"] - s["unique"] - (1 if s["missing"] else 0)
            rows.append((UNIQUE, c, repeated == 0, float(repeated), "repeated values"))
        if s["kind"] == CATEGORICAL and s["unique"] < 50:
            rows.append((DISTINCT, c, True, float(s["unique"]), "distinct values"))
    return df.sparkSession.createDataFrame(rows, RESULT)


def file_gate(df: DataFrame, file_column: str = "file_name") -> DataFrame:
    """Per file: has rows, has no column without any value, has columns."""
    cols = [c for c in df.columns if c != file_column]
    filled = df.groupBy(col(file_column).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(value(df, c)).alias(f"n{i}") for i, c in enumerate(cols)])
    none_empty = F.lit(True)
    for i in range(len(cols)):
        none_empty = none_empty & (F.col(f"n{i}") > 0)
    out = filled.select("file", (F.col("rows") > 0).alias("has_rows"), none_empty.alias("no_empty_column"),
                        F.lit(bool(cols)).alias("has_columns"))
    passed = sum(F.col(x).cast("bigint") for x in ("has_rows", "no_empty_column", "has_columns"))
    return out.withColumn("passed", passed).withColumn("total", F.lit(3).cast("bigint")).withColumn(
        "pct", F.bround(F.col("passed") / 3 * 100, 1))


def require_gate(gate: DataFrame) -> DataFrame:
    """Stop a batch if any file is below 100 percent."""
    failed = gate.filter("pct < 100").select("file").orderBy("file").collect()
    if failed:
        raise ValueError(f"quality gate failed for {[r.file for r in failed]}")
    return gate


def model_tests(df: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    return run_suite(df, [check(NOT_NULL, c) for c in not_null] + [check(UNIQUE, c) for c in unique])
