"""Cleaning steps: nulls, missing columns, and the built-in sample of the survey."""

import pytest

from millrace.functions import convert
from millrace.operators import fill, group, rows, scale, shape
from millrace.operators.joins import merge
from millrace.plans.steps import apply_steps, fit_steps, run_steps
from millrace.plans.templates import DEFAULT_STEPS, TEMPLATES, catalogue
from millrace.reports import profile as prof

# The survey's sample: one exact copy, two blank salaries, one blank years_exp.
SAMPLE = """id,name,department,salary,years_exp,performance_score
1,Alice Chen,Engineering,145000,6,4.8
2,Bob Smith,Data Science,128000,4,4.2
3,Carol Wu,Engineering,158000,8,4.9
4,David Kim,Analytics,95000,3,3.8
5,Eva Patel,Engineering,142000,5,4.6
6,Frank Liu,Data Science,135000,5,4.4
7,Grace Park,Analytics,88000,2,3.9
8,Henry Brown,Engineering,155000,9,4.7
9,Iris Zhao,Data Science,131000,4,4.3
10,Jack Wilson,Analytics,,3,3.7
11,Kate Johnson,Engineering,148000,6,4.5
12,Leo Martinez,Data Science,138000,5,4.1
13,Mia Thompson,Engineering,161000,10,4.8
14,Nathan Davis,Analytics,91000,3,4.0
15,Olivia Lee,Engineering,143000,6,4.6
3,Carol Wu,Engineering,158000,8,4.9
16,Paul Garcia,Data Science,,,4.2
17,Quinn Adams,Engineering,152000,7,4.5
18,Rachel Singh,Analytics,86000,2,3.6
19,Sam Chen,Engineering,149000,6,4.7
20,Tina Wu,Data Science,133000,4,4.0
"""


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    from millrace.sources.read import read_dataset

    path = tmp_path_factory.mktemp("sample") / "sample.csv"
    path.write_text(SAMPLE)
    return read_dataset(spark, str(path)).cache()


def test_sample_profile(sample):
    got = {r.column: r for r in prof.profile(sample).collect()}
    salary = got["salary"]
    assert (salary.missing, salary.min, salary.max, salary.median, salary.q1, salary.q3, salary.unique) == (
        2, 86000, 161000, 142000, 129500, 150500, 18)
    assert (salary["mean"], salary["std"], salary["skew"]) == (133473.6842, 24922.9221, -1.0354)
    assert (got["years_exp"]["std"], got["years_exp"].q1, got["years_exp"].q3) == (2.2734, 3.75, 6.25)
    assert got["name"].kind == "categorical" and got["id"].dtype == "bigint" and salary.dtype == "double"
    assert prof.duplicate_report(sample).first()["duplicate_rows"] == 1
    assert [(r.column, r.iqr_outliers, r.zscore_outliers) for r in prof.outlier_report(sample).collect()] == [("salary", 4, 0)]
    r = {(x.col_a, x.col_b): x.r for x in prof.correlation(sample).collect()}
    assert (r["salary", "years_exp"], r["id", "salary"]) == (0.892, -0.093)


def test_sample_default_steps(sample):
    done = run_steps(sample, DEFAULT_STEPS, metrics=True)
    assert [(e["step"], e["rows_after"]) for e in done.log] == [
        ("snake_case_columns", 21), ("drop_duplicates", 20), ("drop_missing", 20), ("fill_missing", 20), ("remove_outliers", 15)]
    assert done.df.count() == 15


def test_group_means_of_sample(sample):
    got = group.aggregate(sample, "department", {"salary": ["mean", "sum", "count"]}).collect()
    assert [tuple(r) for r in got] == [
        ("Analytics", 90000, 360000, 4), ("Data Science", 133000, 665000, 5), ("Engineering", 151100, 1511000, 10)]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, 2.0, "a", None), (2, None, None, "x"), (3, 4.0, "b", None), (4, 9.0, "b", None)],
        "id int, n double, s string, sparse string")


@pytest.mark.parametrize("operator,value,ids", [
    ("eq", "b", [3, 4]), ("neq", "b", [1, 2]), ("contains", "^[ab]$", [1, 3, 4]), ("not_null", None, [1, 3, 4]),
    ("is_null", None, [2]), ("no_such", 1, [1, 2, 3, 4]), ("eq", 5, []), ("neq", 5, [1, 2, 3, 4])])
def test_text_filters(gaps, operator, value, ids):
    assert [r.id for r in rows.filter_rows(gaps, "s", operator, value).orderBy("id").collect()] == ids


def test_number_filters(gaps):
    assert [r.id for r in rows.filter_rows(gaps, "n", "gte", "4").orderBy("id").collect()] == [3, 4]
    assert [r.id for r in rows.filter_rows(gaps, "n", "neq", 4).orderBy("id").collect()] == [1, 2, 4]
    assert rows.filter_rows(gaps, "nowhere", "eq", 1).count() == 4
    with pytest.raises(ValueError):
        rows.filter_rows(gaps, "s", "gt", 3)


@pytest.mark.parametrize("strategy,n,s", [
    ("median", 4.0, "Unknown"), ("mean", 5.0, "Unknown"), ("mode", 2.0, "b"), ("constant", 7.0, "7")])
def test_fill(gaps, strategy, n, s):
    row = fill.fill_missing(gaps, strategy, value=7).filter("id = 2").first()
    assert (row.n, row.s, row.sparse) == (n, s, "x")


def test_fill_constant_skips_what_does_not_convert(gaps):
    row = fill.fill_missing(gaps, "constant").filter("id = 2").first()
    assert (row.n, row.s) == (None, "Unknown")


def test_neighbour_fill_needs_an_order(gaps):
    with pytest.raises(ValueError):
        fill.fill_missing(gaps, "ffill")
    got = fill.fill_missing(gaps, "bfill", ["n", "s", "sparse"], order_by=["id"]).orderBy("id").collect()
    assert [(r.n, r.s, r.sparse) for r in got] == [(2.0, "a", "x"), (4.0, "b", "x"), (4.0, "b", None), (9.0, "b", None)]


def test_no_nulls_after_fill(gaps):
    filled = fill.fill_missing(gaps, "median")
    assert [r["count"] for r in prof.missing_report(filled).collect()] == [0, 0, 0, 0]


def test_sparse_columns(gaps):
    assert shape.drop_missing(gaps, 70).columns == ["id", "n", "s"]
    assert shape.drop_missing(gaps, 75).columns == gaps.columns
    assert shape.keep_low_null(gaps, 0.75).columns == ["id", "n", "s"]


def test_scaling(gaps):
    scaled = [r.n for r in scale.normalize(gaps, ["n", "s", "nowhere"]).orderBy("id").collect()]
    assert scaled == [0.0, None, 2 / 7, 1.0]
    constant = gaps.selectExpr("id", "5 AS c")
    assert scale.standardize(constant, ["c"]).dtypes == constant.dtypes


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in range(20)] + [(1000.0,), (None,)], "x double")
    assert rows.remove_outliers(df).count() == 21
    assert rows.remove_outliers(df, method="zscore", threshold=3).count() == 20
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert rows.remove_outliers(constant, method="zscore").count() == 0


def test_quartile_bounds_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "id AS other").write.parquet(str(tmp_path / "t"))
    kept = rows.remove_outliers(spark.read.parquet(str(tmp_path / "t")).select("x"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "other" not in plan.split("ReadSchema")[1]


def test_casts(spark):
    df = spark.createDataFrame([("12", "1.5", "x"), ("12.0", "1d", ""), ("12.5", " 2 ", None)], "a string, b string, c string")
    got = shape.cast_types(df, {"a": "int", "b": "float", "c": "bool", "nowhere": "int"}).collect()
    assert [tuple(r) for r in got] == [(12, 1.5, True), (12, None, False), (None, 2.0, None)]
    assert convert.constant("abc", df.schema["a"].dataType) is not None


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["First  Name", "B"])
    assert shape.snake_case_columns(df).columns == ["first_name", "b"]
    with pytest.raises(ValueError):
        shape.rename_columns(df, {"B": "first  name"})


def test_keep_first_of_key(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (None, 5), (None, 4)], "k int, t int")
    got = rows.drop_duplicates(df, ["k"], ["t"])
    assert sorted(got.collect(), key=str) == sorted([(1, 1), (None, 4)], key=str)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert rows.drop_duplicates(rows.drop_duplicates(df)).count() == 4


def test_unknown_aggregate_is_refused(gaps):
    with pytest.raises(ValueError):
        group.aggregate(gaps, ["s"], agg={"n": "collect_list"})
    assert group.aggregate(gaps, [], {"n": "sum"}) is gaps


def test_failed_and_unknown_steps_are_left_out(gaps):
    done = run_steps(gaps, [{"type": "derive_column", "config": {"name": "d", "expression": "no_such + 1"}},
                            {"type": "mystery"}, {"op": "cast", "casts": {"n": "string"}},
                            {"operation": "window", "window": {"partition_by": ["s"], "order_by": ["id"], "fn": "lag"}}])
    assert [e["status"] for e in done.log] == ["failed", "skipped", "success", "success"]
    assert done.df.columns == ["id", "n", "s", "sparse", "lag_col"]


def test_fitted_steps_treat_new_rows_like_the_old(gaps, spark):
    fitted = fit_steps(gaps, [{"type": "fill_missing", "config": {}}, {"type": "normalize", "config": {"columns": ["n"]}}])
    new = spark.createDataFrame([(9, None, None, None)], gaps.schema)
    row = apply_steps(new, fitted).first()
    assert (row.id, row.n, row.s) == (9, 2 / 7, "Unknown")


def test_template_search(spark):
    table = catalogue(spark)
    assert table.count() == len(TEMPLATES) == 8
    assert [r.id for r in rows.search_catalogue(table, q="PII").collect()] == ["customer_data"]
    assert rows.search_catalogue(table, category="Sales & Finance").count() == 2


def test_join_names_and_errors(spark):
    a = spark.createDataFrame([(1, "x")], "k int, tag string")
    b = spark.createDataFrame([(1, "y")], "k int, tag string")
    assert merge(a, b, "k", "k").columns == ["k", "tag_left", "tag_right"]
    assert merge(a, b.withColumnRenamed("k", "j"), "k", "j").columns == ["k", "tag_left", "j", "tag_right"]
    for bad in (lambda: merge(a, b, "k", "k", "cross"), lambda: merge(a, b, ["k"], []), lambda: merge(a, b, "k", "tag")):
        with pytest.raises(ValueError):
            bad()


def test_datetime_formats(spark):
    df = spark.createDataFrame([("2020-01-31",), ("1/31/2020",), ("2020/1/31 10:00:00",), ("13/13/2020",), ("soon",), (None,)], "t string")
    got = [r.t and r.t.strftime("%Y-%m-%d %H") for r in shape.cast_types(df, {"t": "datetime"}).collect()]
    assert got == ["2020-01-31 00", "2020-01-31 00", "2020-01-31 10", None, None, None]


def test_no_plan_loops_over_pairs_or_leaves_the_engine(spark):
    import __spark_entry__ as driver

    sf = "/root/testdata/sf0.001"
    for name in ("join_outer", "join_report", "fill_ffill", "dedup_subset", "top_values", "agg_group_median", "run_mart"):
        plan = driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for unwanted in ("NestedLoop", "CartesianProduct", "PythonUDF", "EvalPython", "InPandas"):
            assert unwanted not in plan, (name, unwanted)
