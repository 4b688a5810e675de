"""Readers that decide per file, refused incremental steps, exact comparisons, failures that end a run."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ordered
from millrace.operators import rows
from millrace.plans import runs
from millrace.plans.steps import fit_steps, run_steps
from millrace.reports import profile, questions, rules, sensitive
from millrace.sources import read, scratch
from millrace.streaming.incremental import clean_new_files


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_text(text)
    return str(folder)


LINES = "".join(f'{{"a": {i}}}\n' for i in range(47))


def test_json_is_read_file_by_file(spark, tmp_path):
    assert read.read_json(spark, put(tmp_path / "broken", f_json='{"a": 1,\n' + LINES)).count() == 48
    mixed = put(tmp_path / "mixed", a_json='{"a": 1}\n{"a": 2}\n', b_json='[\n {"a": 3},\n {"a": 4}\n]')
    assert sorted(r.a for r in read.read_json(spark, mixed).collect()) == [1, 2, 3, 4]
    pretty = put(tmp_path / "pretty", a_json='{\n "a": 1,\n "b": "x"\n}', b_json='{"a": 2}\n{"a": 3}\n{"a": 4}\n')
    assert sorted(r.a for r in read.read_json(spark, pretty).collect()) == [1, 2, 3, 4]
    differ = put(tmp_path / "differ", a_json='{\n "a": "x"\n}', b_json='{"a": 2}\n')
    assert sorted(r.a for r in read.read_json(spark, differ).collect()) == ["2", "x"]


def test_columns_of_a_folder_are_matched_by_name(spark, tmp_path):
    folder = put(tmp_path / "csv", a_csv="id,qty\n1,10\n2,20\n", b_csv='qty,id,note\n30,3,"two\nlines"\n')
    got = {r.id: (r.qty, r.note) for r in read.read_dataset(spark, folder, "csv").collect()}
    assert got == {1: (10, None), 2: (20, None), 3: (30, "two\nlines")}


def test_not_a_number_passes_no_test(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, nan, nan, nan)], "k int, v double")
    assert [r.quantiles for r in ordered.group_quantiles(df, ["k"], "v", [0.5]).collect()] == [[1.5]]
    assert rows.filter_rows(df, "v", "gt", 1).count() == 1 and rows.filter_rows(df, "v", "lt", 100).count() == 2
    assert rows.remove_outliers(df, ["v"]).count() == 5
    assert [tuple(r) for r in questions.total_of(df, "v", "median", "k").collect()] == [(1, 1.5)]


def test_whole_numbers_compare_exactly_and_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "k long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = rows.filter_rows(df, "k", "gt", "9007199254740992")
    assert [r.k for r in kept.collect()] == [9007199254740993]
    assert "GreaterThan(k,9007199254740992)" in kept._jdf.queryExecution().executedPlan().toString()
    bounded = rows.keep_within(df, {"k": (1.5, 9e15)})
    assert "GreaterThanOrEqual(k,2)" in bounded._jdf.queryExecution().executedPlan().toString()


def test_examples_are_not_capped(spark):
    df = spark.createDataFrame([(1, {"a": 1})] * 20, "a int, m map<string,int>")
    made = rules.run_rules(df, [{"rule_type": "no_duplicates", "name": "d"}], examples=10).first()
    assert len(made[-1]) == 10


def test_a_job_that_fails_ends_the_run(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("1", 2.0)], "t string, v double")
    bad = [{"type": "derive_column", "config": {"name": "n", "expression": "raise_error('no')", "new_column": "n", "expr": "raise_error('no')"}}]
    bad.append({"type": "fill_missing", "config": {"strategy": "median"}})
    done = run_steps(df, [{"type": "drop_nulls", "config": {"columns": ["nowhere"]}}])
    assert done.status == "partial" and done.df.count() == 2
    folder = put(tmp_path / "in", a_csv="a,b\n1,2\n")
    report = runs.clean_files(spark, folder, str(tmp_path / "out"), [{"type": "drop_nulls", "config": {"columns": ["nowhere"]}}])
    assert [(r["file"], r["status"]) for r in report] == [("a.csv", "partial")] and "nowhere" in report[0]["error"]
    with pytest.raises(Exception, match="no"):
        run_steps(df.withColumn("n", F.expr("cast(raise_error('no') as double)")), bad[1:]).df.collect()


def test_incremental_runs_refuse_what_needs_the_table(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    whole = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], schema)
    steps = [{"type": "drop_duplicates", "config": {}}, {"type": "fill_by_type", "config": {}}]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, None), (2, 1000.0)], schema).coalesce(1).write.parquet(folder)
    run = lambda fitted: clean_new_files(spark, folder, schema, fitted, str(tmp_path / "out"), str(tmp_path / "state"))
    for refused in ({"type": "aggregate", "config": {"group_by": ["id"], "aggregations": {"v": "sum"}}},
                    {"type": "fill_missing", "config": {"strategy": "ffill", "order_by": ["id"]}},
                    {"type": "sql", "config": {"sql": "SELECT * FROM source_table"}}):
        with pytest.raises(ValueError, match="not row by row"):
            run(fit_steps(whole, [refused]))
    fitted = fit_steps(whole, steps)
    assert sorted(map(tuple, run(fitted).collect())) == [(1, 6.0), (2, 1000.0)]
    spark.createDataFrame([(2, 1000.0), (4, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert sorted(map(tuple, run(fitted).collect())) == [(1, 6.0), (2, 1000.0), (4, 6.0)]


def test_scratch_leaves_the_session_as_it_is(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch.scratch_root(spark).startswith((before or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/"))
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_samples_of_all_columns_take_one_scan(spark, tmp_path):
    nan = float("nan")
    made = spark.createDataFrame([(i, nan if i < 3 else i / 2, None if i % 2 else f"t{i}", [i]) for i in range(40)], "id int, v double, t string, l array<int>")
    made.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = profile.sample_values(df, ["id"], 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert {(r["column"], r.position): r.value for r in found.collect()} == {
        ("id", 1): "0", ("id", 2): "1", ("v", 1): "1.5", ("v", 2): "2.0", ("t", 1): "t0", ("t", 2): "t2", ("l", 1): "[0]", ("l", 2): "[1]"}
    assert profile.sample_values(df.limit(0), ["id"], 2).count() == 0
    contacts = df.selectExpr("id", "concat('u', id, '@example.org') AS reach", "t AS name")
    got = {r["column"]: (r.pii_type, r.match_count) for r in sensitive.sensitive_columns(contacts, sample=6, order_by=["id"]).collect()}
    assert got["reach"] == ("email", 6) and got["name"] == ("name_based", 6)


def test_correlations_skip_rows_without_both_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5), (2.0, 4.0, 5), (3.0, None, 5), (4.0, 9.0, 5), (float("nan"), 1.0, 5)], "a double, b double, c int")
    got = {(r.col_a, r.col_b): r.r for r in profile.correlation(df).collect()}
    assert got["a", "b"] == got["b", "a"] == 0.999 and got["a", "a"] == got["b", "b"] == 1.0
    assert got["c", "c"] is None and got["a", "c"] is None
    wide = spark.range(50).selectExpr(*[f"(id * {i + 3}) % 17 AS c{i}" for i in range(30)])
    assert profile.correlation(wide).count() == 900
    assert {r.r for r in profile.correlation(wide.limit(0)).collect()} == {None}


def test_examples_of_value_rules_come_in_order(spark):
    df = spark.createDataFrame([(i, i % 4, None if i % 5 == 0 else "x" * (i % 7)) for i in range(60)], "id int, k int, t string")
    wanted = [{"rule_type": "max_value", "column": "k", "params": {"value": 2}}, {"rule_type": "not_null", "column": "t", "params": {}},
              {"rule_type": "min_length", "column": "t", "params": {"value": 3}}, {"rule_type": "min_value", "column": "k", "params": {"value": 0}}]
    found = rules.run_rules(df, wanted, order_by=["id"], examples=3).collect()
    assert [[int(x[0]) for x in r.failing_row_examples] for r in found] == [[3, 7, 11], [0, 5, 10], [1, 2, 7], []]
    assert [r.failing_rows_count for r in found] == [15, 12, sum(1 for i in range(60) if i % 5 and i % 7 < 3), 0]
