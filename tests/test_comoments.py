"""Co-moments of all pairs of columns against plain computation."""

import math

import numpy as np
import pytest

from millrace.functions import comoments
from millrace.reports import profile


def plain(x, i, j):
    rows = [(r[i], r[j]) for r in x if not (math.isnan(r[i]) or math.isnan(r[j]))]
    if len(rows) < 2 or len({a for a, _ in rows}) == 1 or len({b for _, b in rows}) == 1:
        return None
    a, b = (np.array(c) for c in zip(*rows))
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


def table(seed, rows=400, width=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width)) + rng.normal(size=(rows, 1))
    x[:, 1] += 1e9  # far from zero beside how much it varies
    x[:, 2] = 0.1  # constant
    x[:, 3] = np.where(rng.random(rows) < 0.9, np.nan, x[:, 3])
    x[:, 4] = np.where(np.isnan(x[:, 3]), x[:, 4], 0.7)  # constant only beside column 3
    x[rng.random((rows, width)) < 0.1] = np.nan
    x[:, 6] = np.nan
    return x


@pytest.mark.parametrize("seed", range(3))
def test_blocks_in_any_cut_equal_the_plain_computation(spark, seed, monkeypatch):
    x = table(seed)
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(x.shape[1])))
    for parts in (1, 5, 61):
        got = {(r.col_a, r.col_b): r.r for r in profile.correlation(df.repartition(parts), digits=6).collect()}
        for i in range(x.shape[1]):
            for j in range(x.shape[1]):
                want = plain(x, i, j)
                assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=2e-6)), (i, j, parts)


def test_states_merge_in_any_order():
    x = table(9)
    whole = comoments.of_block(x)
    cut = [comoments.of_block(x[a:b]) for a, b in ((0, 1), (1, 70), (70, 400))]
    for order in ((0, 1, 2), (2, 0, 1)):
        state = cut[order[0]]
        for k in order[1:]:
            state = comoments.merged(state, cut[k], state[1].T, cut[k][1].T)
        assert np.allclose(state[0], whole[0]) and np.allclose(state[2:], whole[2:], rtol=1e-6, atol=1e-6)


def test_infinite_cells_spoil_only_their_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("inf"), None), (3.0, 5.0, 4.0), (5.0, 5.5, 4.5)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in profile.correlation(df).collect()}
    assert math.isnan(got["a", "b"]) and not math.isnan(got["a", "c"]) and not math.isnan(got["b", "c"])


def test_the_shuffle_has_a_row_for_each_column_and_task(spark):
    wide = spark.range(0, 20_000, 1, 4).selectExpr(*[f"double((id * {i + 3}) % 17) AS c{i}" for i in range(40)])
    blocks = wide.mapInArrow(lambda b: comoments._blocks(b, 40), comoments._STATE)
    assert blocks.count() == 4 * 40
