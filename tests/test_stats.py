"""Statistics against brute force, with limits so small that every path is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import ordered, stats
from millrace.operators.joins import merge
from millrace.reports import profile as prof


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value; the rest is spread over many orders of magnitude."""
    df = spark.range(30000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7.0D ELSE pow(1.0003D, id) * if(id % 2 = 0, -1, 1) END AS v",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE id * 1000003 % 977 END AS w")
    return df, df.toPandas()


@pytest.mark.parametrize("limit", [10_000_000, 200, 3])
def test_quantiles_are_exact(skewed, limit):
    df, pdf = skewed
    probs = [0, 0.01, 0.25, 0.3333, 0.5, 0.75, 0.99, 1]
    got = stats.quantiles(df, ["v", "w"], probs, row_limit=limit)
    for c in ("v", "w"):
        assert np.allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert stats.quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_modes_take_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "a"), (1, "b"), (None, None)], "n int, s string")
    assert stats.modes(df, ["n", "s"]) == {"n": 1, "s": "a"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert stats.null_counts(df) == (3, {"x": 2})
    assert stats.distinct_counts(df, ["x"]) == {"x": 1}


def test_correlation_of_constants_is_null(spark):
    df = spark.range(50).selectExpr("1.5D AS a", "id AS b", "if(id < 25, NULL, -id) AS c", "if(id < 25, 3, NULL) AS d")
    got = {(r.col_a, r.col_b): r.r for r in prof.correlation(df).collect()}
    assert got["b", "c"] == -1.0 and got["b", "b"] == 1.0
    assert got["a", "b"] is None and got["a", "a"] is None and got["c", "d"] is None


@pytest.fixture(scope="module")
def events(spark):
    df = spark.range(4000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 11 = 0 THEN NULL ELSE id % 40 END AS k",
        "id * 7919 % 101 AS v", "CASE WHEN id % 4 = 0 THEN id END AS gap").orderBy(F.rand(3))
    return df, df.toPandas().sort_values("id")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10**7, 5])
def test_running_values(events, keys, limit):
    df, pdf = events

    def grouped(c):
        return pdf.groupby("k", dropna=False)[c] if keys else pdf[c]

    def result(made):
        return made.toPandas().sort_values("id")

    numbered = result(ordered.number_rows(df, keys, ["id"], "n", limit, 7))
    expected = pdf.groupby("k", dropna=False).cumcount() + 1 if keys else range(1, len(pdf) + 1)
    assert list(numbered.n) == list(expected)
    for ahead, step in ((False, 1), (True, -1)):
        moved = result(ordered.neighbour(df, keys, ["id"], "v", "n", ahead, limit, 7))
        assert np.allclose(moved.n, grouped("v").shift(step), equal_nan=True)
    for backward in (False, True):
        filled = result(ordered.carry_values(df, keys, ["id"], ["gap"], backward, limit=limit, ranges=7))
        assert np.allclose(filled.gap, grouped("gap").bfill() if backward else grouped("gap").ffill(), equal_nan=True)
    for dense in (False, True):
        ranked = result(ordered.ranks(df, keys, ["v"], "n", dense, limit, 7))
        assert list(ranked.n) == list(grouped("v").rank(method="dense" if dense else "min"))


@pytest.mark.parametrize("limit", [10**7, 5])
def test_group_quantiles(events, limit):
    df, pdf = events
    got = {r.k: r.quantiles for r in ordered.group_quantiles(df.dropna(subset=["k"]), ["k"], "v", [0.5, 0.9], limit, 7).collect()}
    want = pdf.groupby("k").v.quantile([0.5, 0.9]).unstack()
    assert len(got) == len(want)
    assert all(np.allclose(got[int(k)], row) for k, row in zip(want.index, want.to_numpy()))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot_on_the_right", [False, True])
def test_hot_keys_join_as_plain_ones(spark, how, hot_on_the_right):
    small = spark.range(60).selectExpr("CASE WHEN id = 3 THEN NULL ELSE id END AS k", "id AS a")
    large = spark.range(900).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL WHEN id % 2 = 0 THEN id ELSE -id END AS k", "id AS b")
    left, right = (small, large) if hot_on_the_right else (large, small)
    lp, rp = left.toPandas().astype("Int64"), right.toPandas().astype("Int64")
    want = lp.merge(rp, on="k", how=how)
    got = merge(left, right, "k", "k", how)
    assert got.columns == list(want.columns)

    def rows(p):
        return sorted(tuple(-10**9 if v is None or v != v else int(v) for v in r) for r in p.astype(object).where(p.notna(), None).itertuples(index=False, name=None))

    assert rows(got.toPandas()) == rows(want)
