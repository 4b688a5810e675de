"""Statistics kept by arrival against those of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.steps import apply_steps, fit_steps
from millrace.plans.templates import BATCH_STEPS, DEFAULT_STEPS, TEMPLATES
from millrace.streaming.incremental import clean_new_files
from millrace.streaming.states import add_states, column_states, described, merged_states, refit, remember


def table(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, rng.lognormvariate(6, 1)]) if i % 3 else rng.gauss(1e6, 5), rng.choice(["a", "b", "b", None]), float("nan") if i % 9 == 0 else i / 7, None if i % 10 else 1, i % 5)
            for i in range(n)]
    return spark.createDataFrame(rows, "`Row ID` int, amount double, level string, price double, sparse int, stock int")


def near(a, b, spread, share=0.02):
    return a == b or abs(a - b) <= share * spread


def test_merged_states_describe_the_whole(spark, tmp_path):
    df, store = table(spark), str(tmp_path / "store")
    for k in range(3):
        add_states(df.filter(F.col("Row ID") % 3 == k), store, k)
    add_states(df.filter(F.col("Row ID") % 3 == 2), store, 2)  # an arrival that is done again counts once
    add_states(df.filter("false"), store, 9)
    merged = described(merged_states(spark, store)).orderBy("column").collect()
    whole = described(column_states(df)).orderBy("column").collect()
    assert [r.column for r in merged] == sorted(df.columns)
    for a, b in zip(merged, whole):
        assert (a.rows, a.nulls, a.low, a.high) == (b.rows, b.nulls, b.low, b.high)
        assert a.mode == b.mode or a.column in ("amount", "price", "Row ID")  # of many single values no list keeps the smallest
        for x, y in ((a.mean, b.mean), (a.std, b.std)):
            assert x == y or abs(x - y) <= 1e-9 * abs(y)
    exact = df.agg(F.stddev_samp("amount").alias("s"), F.avg("amount").alias("m")).first()
    amount = next(r for r in merged if r.column == "amount")
    assert abs(amount.std - exact.s) <= 1e-9 * exact.s and abs(amount.mean - exact.m) <= 1e-9 * exact.m


FITTED_ON_RAW = [DEFAULT_STEPS, BATCH_STEPS, *[TEMPLATES[t]["steps"] for t in ("hr_data", "sales_data", "customer_data", "log_analytics", "survey_data")],
                 [{"type": "fill_missing", "config": {"strategy": "mean"}}, {"type": "standardize", "config": {}}, {"type": "normalize", "config": {}},
                  {"type": "remove_outliers", "config": {"method": "zscore"}}]]


@pytest.mark.parametrize("steps", FITTED_ON_RAW)
def test_refit_equals_fit_on_all_rows(spark, tmp_path, steps):
    df, store = table(spark).withColumnRenamed("price", "salary"), str(tmp_path / "store")
    raw, out, progress = (str(tmp_path / x) for x in ("raw", "out", "progress"))
    first = df.filter("amount < 400 OR amount IS NULL")
    fitted = fit_steps(first, steps)
    observe = remember(spark, df.schema, steps, store)
    for arrival in (first, df.filter("amount >= 400")):
        arrival.write.mode("append").parquet(raw)
        clean_new_files(spark, raw, df.schema, fitted, out, progress, observe=observe)
    want, got = fit_steps(df, steps), refit(spark, df.schema, steps, store)
    assert [(g["name"], g["config"]) for g in got] == [(w["name"], w["config"]) for w in want]
    spread = {"amount": 1e6, "salary": 500, "row_id": 3000, "stock": 3}
    for w, g in zip(want, got):
        if not isinstance(w["fitted"], dict):
            assert g["fitted"] == w["fitted"]
            continue
        assert g["fitted"].keys() == w["fitted"].keys()
        for c, x in w["fitted"].items():
            if w["config"].get("strategy") == "mode" and c in ("amount", "salary", "row_id", "Row ID"):
                continue  # all values are found once or twice: no list of frequent ones has the smallest of them
            y = g["fitted"][c]
            for a, b in zip(x if isinstance(x, tuple) else (x,), y if isinstance(y, tuple) else (y,)):
                assert a == b or near(a, b, max(spread.get(c.lower().replace(" ", "_"), 1), abs(a) * 0.02, 0.05), 0.1), (w["name"], c, x, y)
    kept = [apply_steps(df, [s for s in x if s["name"] != "drop_duplicates"]).count() for x in (want, got)]
    assert abs(kept[0] - kept[1]) <= 0.02 * df.count()
    files = merged_states(spark, store).inputFiles()
    assert files and all("/store/arrival=" in f for f in files)


@pytest.mark.parametrize("name, at", [("financial_audit", "normalize"), ("product_catalog", "normalize"), ("ml_features", "standardize")])
def test_statistics_behind_a_fitted_filter_are_refused(spark, tmp_path, name, at):
    df, store = table(spark, 50), str(tmp_path / "store")
    add_states(df, store, 0)
    with pytest.raises(ValueError, match=f"{at}: the rows behind|nothing is known"):
        refit(spark, df.schema, TEMPLATES[name]["steps"], store)
