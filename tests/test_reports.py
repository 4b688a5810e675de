"""Checks, rules, drift and sensitive columns."""

import pytest

from millrace.reports import drift, insight, quality, rules, sensitive
from millrace.reports import profile as prof
from millrace.reports import questions as ask


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "ann", "a@b.org", 30), (2, "bob", None, 200), (2, "bob", None, 200), (4, "c", "none", None)],
        "id int, name string, contact string, age int")


def test_suite_adds_up(people):
    suite = [quality.check(quality.NOT_NULL, "age"), quality.check(quality.UNIQUE, "contact"), quality.check(quality.UNIQUE, "name"),
             quality.check(quality.BETWEEN, "age", min_value=0, max_value=120), quality.check(quality.REGEX, "contact", regex=".+@"),
             quality.check(quality.IN_SET, "name", value_set=["ann", "bob", "c"]), quality.check(quality.EXISTS, "id"),
             quality.check(quality.ROW_COUNT, min_value=1), quality.check(quality.MEAN, "id", max_value=3)]
    results = quality.run_suite(people, suite)
    assert [r.observed for r in results.collect()] == [1, 1, 1, 2, 3, 0, None, 4, 2.25]
    score = quality.suite_score(results).first()
    assert score.passed + score.failed == score.total == 9 and score.passed == 4 and not score.success


def test_mostly_tolerates_some(spark):
    df = spark.range(1000).selectExpr("CAST(id AS INT) AS x")
    inside = quality.check(quality.BETWEEN, "x", max_value=994, mostly=0.99)
    outside = quality.check(quality.BETWEEN, "x", max_value=980, mostly=0.99)
    assert [r.success for r in quality.run_suite(df, [inside, outside]).collect()] == [True, False]


def test_rules(people):
    got = {r.rule_name: r for r in rules.run_rules(people, [
        {"name": "dupes", "rule_type": "no_duplicates"}, {"name": "ids", "rule_type": "unique", "column": "id", "severity": "warning"},
        {"name": "old", "rule_type": "max_value", "column": "age", "params": {"value": 120}},
        {"name": "mail", "rule_type": "regex_match", "column": "contact", "params": {"pattern": "[^@]+@"}},
        {"name": "gaps", "rule_type": "null_threshold", "column": "age", "params": {"value": 30}},
        {"name": "odd", "rule_type": "min_value", "column": "name", "params": {"value": "x"}}], ["id"]).collect()}
    assert (got["dupes"].failing_rows_count, got["dupes"].failing_row_examples) == (1, [["2", "bob", "", "200"]])
    assert (got["ids"].status, len(got["ids"].failing_row_examples)) == ("warning", 2)
    assert got["old"].actual == "max = 200" and got["old"].failing_rows_count == 2
    assert got["mail"].failing_row_examples == [["4", "c", "none", ""]]
    assert (got["gaps"].status, got["gaps"].actual) == ("warning", "25.0%")
    assert got["odd"].status == "failed" and got["odd"].actual.startswith("Error")


def test_no_drift_from_itself(people):
    p = drift.light_profile(people)
    score = drift.drift_score(drift.compare(p, p)).first()
    assert (score.drift_score, score.severity) == (0.0, "none")


def test_drift_history(spark, people, tmp_path):
    p = drift.light_profile(people)
    other = drift.light_profile(people.drop("age").withColumnRenamed("name", "label"))
    score = drift.drift_score(drift.compare(p, other))
    assert (score.first().added, score.first().removed, score.first().drift_score) == (1, 2, 17.0)
    path = str(tmp_path / "history")
    for pair in (("1", "2"), ("2", "3")):
        drift.record_drift(spark, path, (pair[0], "x"), (pair[1], "y"), score)
    assert [r.baseline_id for r in drift.drift_history(drift.read_history(spark, path), "2").collect()] == ["2", "1"]
    assert drift.drift_history(drift.read_history(spark, path), "1").count() == 1


def test_sensitive_columns(spark):
    df = spark.createDataFrame([("a@b.org", "+49 30 123456", "x", "1"), ("c@d.org", "none", "y", "2"), (None, "none", "z", "3")],
                               "contact string, line string, First_Name string, other string")
    got = {r.column: (r.pii_type, r.confidence, r.match_count) for r in sensitive.sensitive_columns(df).collect()}
    assert got == {"contact": ("email", "high", 2), "line": ("phone", "medium", 1), "First_Name": ("name_based", "high", 3)}
    assert sensitive.risk_level(sensitive.sensitive_columns(df), 4).first().risk_level == "high"


def test_insight(people):
    got = {r.column: r for r in insight.column_insight(prof.profile(people)).collect()}
    assert got["name"].is_pii and got["id"].semantic_type == "id" and "fill_missing" in got["contact"].suggested_steps


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (2.5, 5), (None, 5), (11.0, 5)], "x double, c int")
    bins = prof.histogram(df).collect()
    assert sum(r["count"] for r in bins if r.column == "x") == 4
    constant = sorted((r.lo, r.hi, r["count"]) for r in bins if r.column == "c")
    assert constant == [(4.5, 5.0, 0), (5.0, 5.5, 5)]


def test_samples_and_order(people):
    got = [(r.position, r.value) for r in prof.sample_values(people, ["id"], 2).filter("column = 'contact'").orderBy("position").collect()]
    assert got == [(1, "a@b.org"), (2, "none")]
    assert [r.id for r in ask.tail(people.dropDuplicates(), ["id"], 2).collect()] == [4, 2]
    assert ask.sort_by(people, "age", ascending=False).collect()[-1].age is None
