"""Files that arrive one after the other are cleaned once, with frozen statistics."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.steps import fit_steps
from millrace.plans.templates import BATCH_STEPS, DEFAULT_STEPS, TEMPLATES
from millrace.sources.scratch import settle
from millrace.streaming.incremental import clean_new_files, follow_log, row_wise, split_at_state


def test_arrivals_add_up(spark, tmp_path):
    old = spark.createDataFrame([(i, float(i) if i % 4 else None) for i in range(40)], "id int, v double")
    steps = [{"type": "fill_missing", "config": {"strategy": "median"}}, {"type": "remove_outliers", "config": {"columns": ["v"]}}]
    fitted = fit_steps(old, steps)
    assert row_wise(fitted)
    raw, out, progress = (str(tmp_path / x) for x in ("raw", "out", "progress"))

    def arrive(rows):
        spark.createDataFrame(rows, old.schema).coalesce(1).write.mode("append").parquet(raw)
        return clean_new_files(spark, raw, old.schema, fitted, out, progress, unique_by=["id"])

    assert arrive([(1, 1.0), (2, None), (3, 900.0)]).count() == 2
    got = arrive([(2, 5.0), (4, 4.0)])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, 1.0), (2, 20.0), (4, 4.0)]
    assert clean_new_files(spark, raw, old.schema, fitted, out, progress, unique_by=["id"]).count() == 3


def test_log_tail(spark, tmp_path):
    raw, out, progress = (str(tmp_path / x) for x in ("raw", "out", "progress"))
    lines = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id int, run_id int")
    lines.write.parquet(raw)
    assert [r.id for r in follow_log(spark, raw, lines.schema, 7, 1, out, progress).collect()] == [2]


def test_duplicates_are_dropped_wherever_the_step_stands(spark, tmp_path):
    """Behind projections, twice, and over nested columns, with copies in different arrivals."""
    old = spark.createDataFrame([(i, f" t{i % 5} ", {"k": str(i % 5)}) for i in range(20)], "`Row ID` int, text string, m map<string,string>")
    steps = [{"type": "snake_case_columns", "config": {}}, {"type": "trim_strings", "config": {}}, {"type": "drop_duplicates", "config": {}},
             {"type": "drop_columns", "config": {"columns": ["row_id"]}}, {"type": "drop_duplicates", "config": {"subset": ["text"]}},
             {"type": "derive_column", "config": {"name": "n", "expression": "length(text)"}}]
    raw, out, progress = (str(tmp_path / x) for x in ("raw", "out", "progress"))
    fitted = fit_steps(old, steps)
    assert not row_wise(fitted) and [len(x) for x in split_at_state(fitted)] == [5, 1]
    done = None
    for rows in (old.limit(7), old.filter("`Row ID` >= 3")):
        rows.write.mode("append").parquet(raw)
        done = clean_new_files(spark, raw, old.schema, fitted, out, progress)
    assert sorted((r.text, r.n, r.m["k"]) for r in done.collect()) == [(f"t{i}", 2, str(i)) for i in range(5)]


def test_watermark_bounds_the_state_of_a_step(spark, tmp_path):
    old = spark.createDataFrame([("2024-01-01 00:00:00", 1)], "at string, id int").withColumn("at", F.col("at").cast("timestamp"))
    fitted = fit_steps(old, [{"type": "rename_columns", "config": {"mapping": {"at": "time"}}}, {"type": "drop_duplicates", "config": {"subset": ["id"]}}])
    raw, out, progress = (str(tmp_path / x) for x in ("raw", "out", "progress"))
    old.union(old).write.parquet(raw)
    assert clean_new_files(spark, raw, old.schema, fitted, out, progress, event_time="at").count() == 1


@pytest.mark.parametrize("step", [{"type": "window", "config": {"function": "row_number", "partition_by": ["v"], "order_by": ["v"]}},
                                  {"type": "drop_duplicates", "config": {"subset": ["v"], "order_by": ["id"]}},
                                  {"type": "fill_missing", "config": {"strategy": "ffill", "order_by": ["id"]}}])
def test_steps_over_several_rows_are_refused(spark, tmp_path, step):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    fitted = [{"name": step["type"], "config": step["config"], "fitted": None}]
    with pytest.raises(ValueError, match="not row by row|which of several"):
        clean_new_files(spark, str(tmp_path), df.schema, fitted, str(tmp_path / "out"), str(tmp_path / "progress"))


@pytest.mark.parametrize("steps", [DEFAULT_STEPS, BATCH_STEPS, *[t["steps"] for t in TEMPLATES.values()]])
def test_every_template_can_run_incrementally(spark, steps):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b")], "id int, amount double, level string")
    before, after = split_at_state(fit_steps(df, steps))
    assert before[-1]["name"] == "drop_duplicates" and row_wise(after)


def test_fitting_writes_the_table_once_for_each_shuffle(spark, monkeypatch):
    from millrace.plans import steps as plans

    written = []
    monkeypatch.setattr(plans, "settle", lambda df: written.append(df.columns) or settle(df))
    df = spark.createDataFrame([(i % 30, float(i % 30) if i % 3 else None, "x") for i in range(60)], "k int, v double, t string")
    fitted = fit_steps(df, TEMPLATES["ml_features"]["steps"])
    assert len(written) == 1 and [f["name"] for f in fitted] == [s["type"] for s in TEMPLATES["ml_features"]["steps"]]
    again = fit_steps(df, [*TEMPLATES["ml_features"]["steps"][:4], {"type": "drop_duplicates", "config": {"subset": ["k"]}}, {"type": "normalize", "config": {}}])
    assert len(written) == 3 and again[:4] == fitted[:4]
