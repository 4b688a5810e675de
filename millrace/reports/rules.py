"""Rules with a severity, the number of failing rows, and some of them as examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.columns import col, flat
from ..functions.stats import value
from ..operators.joins import matched
from .quality import repeats

RESULT = (
    "rule_name string, column string, rule_type string, expected string, actual string, status string, "
    "failing_rows_count bigint, failing_row_examples array<array<string>>")
_VALUE_RULES = ("not_null", "null_threshold", "min_value", "max_value", "between", "regex_match", "allowed_values",
                "min_length", "max_length")


def _allowed(params: dict) -> list[str]:
    values = params.get("values", [])
    return [v.strip() for v in values.split(",")] if isinstance(values, str) else list(values)


def failing(df: DataFrame, rule: dict) -> Column:
    """True for the rows that break a per-value rule; nulls break only the null rules."""
    kind, p = rule["rule_type"], rule.get("params", {})
    v = value(df, rule["column"])
    if kind in ("not_null", "null_threshold"):
        return v.isNull()
    as_text = v.cast("string")
    broken = {
        "min_value": lambda: v < float(p.get("value", 0)),
        "max_value": lambda: v > float(p.get("value", 0)),
        "between": lambda: ~v.between(float(p.get("min", 0)), float(p.get("max", 100))),
        "regex_match": lambda: ~text.starts_with_match(v, p.get("pattern", ".*")),
        "allowed_values": lambda: ~as_text.isin(_allowed(p)) if _allowed(p) else as_text.isNotNull(),
        "min_length": lambda: F.length(as_text) < int(p.get("value", 1)),
        "max_length": lambda: F.length(as_text) > int(p.get("value", 255)),
    }[kind]()
    return F.coalesce(broken, F.lit(False))


def _as_text_row(df: DataFrame) -> Column:
    return F.array(*[F.coalesce(flat(df, c).cast("string"), F.lit("")) for c in df.columns])


def _examples(df: DataFrame, rows: DataFrame, order_by: list[str], n: int) -> list[list[str]]:
    return [r.row for r in rows.orderBy(*[flat(df, c) for c in order_by]).limit(n).select(_as_text_row(df).alias("row")).collect()]


def _value_examples(df: DataFrame, broken: dict[int, dict], order_by: list[str], n: int) -> dict[int, list[list[str]]]:
    """The first `n` failing rows of every per-value rule, from one scan: each task keeps `n` rows per rule."""
    shown: dict[int, list[list[str]]] = {i: [] for i in broken}
    if broken:
        tags = F.array_compact(F.array(*[F.when(failing(df, rule), F.lit(i)) for i, rule in broken.items()]))
        at = [f"_o{j}" for j in range(len(order_by))]
        rows = df.select(F.explode(tags).alias("_rule"), *[flat(df, c).alias(a) for a, c in zip(at, order_by)], _as_text_row(df).alias("_row"))
        place = F.row_number().over(W.partitionBy("_rule").orderBy(*(at or [F.lit(1)])))
        first = rows.withColumn("_at", place).filter(F.col("_at") <= n).select("_rule", "_at", "_row")
        for r in sorted(first.collect(), key=lambda r: (r["_rule"], r["_at"])):
            shown[r["_rule"]].append(r["_row"])
    return shown


def _repeated_rows(df: DataFrame, n: int) -> DataFrame:
    """Each row that occurs again, once per repeat beyond the first, `n` times at most: more of one row are never shown."""
    keys = [flat(df, c).alias(f"_k{i}") for i, c in enumerate(df.columns)]  # maps are compared as text
    copies = df.groupBy(*keys).agg(F.first(F.struct(*[col(c) for c in df.columns])).alias("_row"), F.count(F.lit(1)).alias("_copies"))
    copies = copies.filter("_copies > 1").select("_row.*", "_copies")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(2), F.least(F.col("_copies"), F.lit(n + 1))))).drop("_copies", "_copy")


def _copies_of_key(df: DataFrame, column: str) -> DataFrame:
    """All rows whose value occurs more than once."""
    many = df.groupBy(col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return matched(df, many, [column], ["_k"], "inner").drop("_k")


def run_rules(df: DataFrame, rules: list[dict], order_by: list[str] | None = None, examples: int = 5) -> DataFrame:
    """One result row per rule.  All counts come from one pass; examples are a top-n per failing rule.

    Examples are the first failing rows by `order_by` (by all columns if not given).
    """
    order_by = order_by or [c for c in df.columns]
    have = set(df.columns)
    wanted: dict = {None: F.count(F.lit(1))}
    errors: dict[int, str] = {}
    for i, rule in enumerate(rules):
        c = rule.get("column", "")
        if rule["rule_type"] in _VALUE_RULES and c in have:
            try:
                test = F.count_if(failing(df, rule))
                df.agg(test)  # analysis only: a rule that does not fit the column's type fails alone
                wanted[i] = test
                if rule["rule_type"] in ("min_value", "max_value"):
                    wanted[i, "end"] = (F.min if rule["rule_type"] == "min_value" else F.max)(value(df, c))
            except Exception as e:  # noqa: BLE001
                errors[i] = f"Error: {str(e).splitlines()[0]}"
        if rule["rule_type"] == "unique" and c in have:
            wanted["n", c] = F.count(value(df, c))
    got = stats.measure(df, wanted, fields=1)
    total = got[None]
    keyed = list(dict.fromkeys(r["column"] for r in rules if r["rule_type"] == "unique" and r.get("column") in have))
    repeated = repeats(df, keyed, total, {c: total - got["n", c] for c in keyed})
    copies = None
    if any(r["rule_type"] == "no_duplicates" for r in rules):
        copies = total - df.groupBy(*[flat(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]).count().count()

    of_values = _value_examples(df, {i: r for i, r in enumerate(rules) if i in got and i not in errors and got[i]
                                     and r["rule_type"] != "null_threshold"}, order_by, examples)
    out = []
    for i, rule in enumerate(rules):
        kind, c, p = rule["rule_type"], rule.get("column", "") or "", rule.get("params", {})
        bad_status = "warning" if rule.get("severity", "error") == "warning" else "failed"
        expected, actual, status, bad, shown = "", "", "passed", 0, []
        broken_rows = None
        if kind == "row_count_min":
            least = int(p.get("value", 0))
            expected, actual = f">= {least} rows", f"{total} rows"
            status = "passed" if total >= least else bad_status
        elif kind == "no_duplicates":
            expected, actual, bad = "0 duplicate rows", f"{copies} duplicate rows", copies
            broken_rows = lambda: _repeated_rows(df, examples)
        elif c not in have:
            actual, status = f"Column '{c}' not found", "failed"
        elif i in errors:
            actual, status = errors[i], "failed"
        elif kind == "unique":
            expected, actual, bad = "all unique", f"{repeated[c]} duplicates", repeated[c]
            broken_rows = lambda c=c: _copies_of_key(df, c)
        elif kind == "null_threshold":
            limit = float(p.get("value", 5))
            share = round(got[i] / total * 100, 2) if total else 0.0
            expected, actual = f"null% < {limit}%", f"{share}%"
            if share >= limit:
                status, bad = bad_status, got[i]
            elif share >= limit * 0.8:
                status = "warning"
        elif i in got:
            bad = got[i]
            expected, actual = _wording(kind, p, bad, got.get((i, "end")))
            if bad:
                status, shown = bad_status, of_values[i]
        else:
            actual, status = f"Unknown rule type: {kind}", "failed"
        if broken_rows is not None and bad:
            status = bad_status
            shown = _examples(df, broken_rows(), order_by, examples)
        out.append((rule.get("name", f"{kind} on {c}"), c, kind, expected, actual, status, bad, shown))
    return df.sparkSession.createDataFrame(out, RESULT)


def _wording(kind: str, p: dict, bad: int, end) -> tuple[str, str]:
    if kind == "not_null":
        return "0 nulls", f"{bad} nulls"
    if kind == "min_value":
        return f">= {float(p.get('value', 0))}", f"min = {end}"
    if kind == "max_value":
        return f"<= {float(p.get('value', 0))}", f"max = {end}"
    if kind == "between":
        return f"between {float(p.get('min', 0))} and {float(p.get('max', 100))}", f"{bad} values out of range"
    if kind == "regex_match":
        return f"matches /{p.get('pattern', '.*')}/", f"{bad} non-matching"
    if kind == "allowed_values":
        return f"in {_allowed(p)}", f"{bad} disallowed"
    if kind == "min_length":
        return f"length >= {int(p.get('value', 1))}", f"{bad} too short"
    return f"length <= {int(p.get('value', 255))}", f"{bad} too long"


def overall_status(results: DataFrame) -> DataFrame:
    failed, warned = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "warning")
    return results.agg(
        F.count_if(F.col("status") == "passed").alias("passed"), failed.alias("failed"), warned.alias("warnings"),
        F.when(failed > 0, "failed").when(warned > 0, "warning").otherwise("passed").alias("overall_status"))
