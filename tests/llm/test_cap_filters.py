"""Links, components and counts of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.cap_filters import ProductCode, near_vectors, passed, plan


def brute(rows, similarity):
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


def rows_of(dims, rng):
    rows = []
    f = lambda v: [float(x) for x in np.float32(v)]
    for i in range(150):
        rows.append((i, f(rng.normal(size=dims)), int(rng.integers(3))))
    base = rng.normal(size=dims)
    for i in range(60):  # a hot group, some of it scaled
        rows.append((1000 + i, f((base + 0.05 * rng.normal(size=dims)) * (i % 3 + 0.5)), 1))
    for i in range(40):  # chains on both sides of the limit
        base = base + 0.25 * rng.normal(size=dims)
        rows.append((2000 + i, f(base), 2))
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(10)] + [rows[5], (None, rows[5][1], rows[5][2])]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * dims, 1), (4003, rows[5][1], None), (4004, [None] * dims, 1), (4005, [float("nan")] * dims, 1),
             (4006, [float("inf")] * dims, 1), (None, None, None), (4007, f(base[:-1]), 2), (4008, f(base[:-1]), 2), (4000, None, 1), (4009, [1e-30] * dims, 1), (4010, [1e30] * dims, 1)]
    return rows


@pytest.mark.parametrize("kind, dims, cell_rows", [("float", 64, 2048), ("double", 64, 16), ("float", 3, 32)])
def test_links(spark, kind, dims, cell_rows):
    rows = rows_of(dims, np.random.default_rng(dims))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(5)
    df = df.withColumns({c: F.lit("other") for c in ("node", "copies", "first", "links", "filter", "cell", "usable", "a", "b")})
    got = [tuple(r) for r in near_vectors(df, cell_rows=cell_rows, miss=1e-3).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 0.93), key=str)


def test_no_rows(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    alone = spark.createDataFrame([(7, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in near_vectors(alone).select("vec_id", "n_links", "component_id", "kept").collect()] == [(7, 0, 7, True)]


@pytest.mark.parametrize("dims, blocks, words", [(64, 2, 16), (30, 3, 8), (5, 1, 64)])
def test_decoding_finds_every_filter(dims, blocks, words):
    code, x = ProductCode(dims, blocks, words), np.random.default_rng(1).normal(size=(50, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = code.scores(x)
    every = whole[0]
    for s in whole[1:]:
        every = (every[:, :, None] + s[:, None, :]).reshape(len(x), -1)
    for threshold in (0.2, 0.4, 0.6):
        row, found = code.decode(x, threshold)
        assert list(zip(row, found)) == list(zip(*np.nonzero(every >= threshold)))
    assert np.allclose(np.linalg.norm(code.rotated(x), axis=1), 1)


@pytest.mark.parametrize("dims, rows", [(64, 1e4), (64, 1e8), (2, 1e3), (1, 10), (300, 1e4)])
def test_recall_of_plans(dims, rows):
    """Pairs that the plan was not made on, of exactly the similarity."""
    how = plan(dims, rows, rows * rows / 10, 0.93, 0.001)
    rng = np.random.default_rng(99)
    x, g = rng.normal(size=(2, 2000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = x if dims == 1 else 0.93 * x + np.sqrt(1 - 0.93 ** 2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    lists = [set(zip(*(v.tolist() for v in passed(dims, how, z)))) for z in (x, y)]
    recall = len({r for r, _ in lists[0] & lists[1]}) / len(x)
    print(dims, rows, how, len(lists[0]) / len(x), recall)
    assert recall >= 0.995
