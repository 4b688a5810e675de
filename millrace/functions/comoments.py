"""Counts, means and co-moments of all pairs of columns, from one scan.

A task turns each Arrow batch into matrix products and merges them, so it
shuffles one row for each column whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Cells of a batch that are held as matrices at once.
_CELLS = 1 << 20
_STATE = "column int, state binary"


def of_block(x: np.ndarray) -> np.ndarray:
    """(4, columns, columns) of a block of rows in which NaN means missing.

    [0][i][j] counts the rows that have both i and j; [1] is the mean of i in
    them, [2] its sum of squared deviations and [3] that of the products.
    """
    there = ~np.isnan(x)
    endless = np.isinf(x)
    x = np.where(endless, 0.0, x)
    first = x[there.argmax(axis=0), np.arange(x.shape[1])]
    first[~there.any(axis=0)] = 0.0
    # Exactly the value of a column that has only one.
    centre = first + np.where(there, x - first, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    d, m = np.where(there, x - centre, 0.0), there.astype(np.float64)
    n = m.T @ m
    total, squares, products = d.T @ m, (d * d).T @ m, d.T @ d
    size = np.maximum(n, 1)
    state = np.stack([n, centre[:, None] + total / size, squares - total * total / size, products - total * total.T / size])
    # Where a column hardly varies beside its distance from the centre, differences of sums say little: these pairs are taken by themselves.
    poor = (state[2] <= 1e-8 * squares) & (squares > 0)
    for i, j in np.argwhere(np.triu(poor | poor.T)):
        both = there[:, i] & there[:, j]
        for p, q in ((i, j), (j, i)):
            a, b = x[both, p] - x[both, p][0], x[both, q] - x[both, q][0]
            shift, other = a.mean(), b.mean()
            state[1:, p, q] = x[both, p][0] + shift, ((a - shift) ** 2).sum(), ((a - shift) * (b - other)).sum()
    if endless.any():
        e = endless.astype(np.float64)
        touched = (e.T @ m + m.T @ e) > 0
        state[2:, touched] = np.nan
    return state


def merged(a: np.ndarray, b: np.ndarray, mean_of_others_a: np.ndarray, mean_of_others_b: np.ndarray) -> np.ndarray:
    """The state of both sets of rows; the means of the other column of each pair come beside, in the same shape."""
    n = a[0] + b[0]
    size = np.maximum(n, 1)
    weight = a[0] * b[0] / size
    step, other = b[1] - a[1], mean_of_others_b - mean_of_others_a
    mean = np.where(a[0] == 0, b[1], a[1] + step * b[0] / size)
    return np.stack([n, mean, a[2] + b[2] + weight * step * step, a[3] + b[3] + weight * step * other])


def _blocks(batches, width: int) -> Iterator[pa.RecordBatch]:
    state = None
    rows = max(1, _CELLS // width)
    with np.errstate(all="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                more = of_block(np.column_stack([part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)]))
                state = more if state is None else merged(state, more, state[1].T, more[1].T)
    if state is not None:
        # A row has what its column needs to be merged alone: the others' means are the fifth line.
        lines = [np.vstack([state[:, i], state[1][:, i]]).tobytes() for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(lines, pa.binary())], names=["column", "state"])


def _merged(batches, width: int) -> Iterator[pa.RecordBatch]:
    """One row of each column; rows come sorted by column."""
    key, held = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["column", "state"])

    with np.errstate(all="ignore"):
        for batch in batches:
            for column, state in zip(batch.column("column").to_pylist(), batch.column("state")):
                more = np.frombuffer(state.as_py()).reshape(5, width)
                if column != key:
                    if key is not None:
                        yield row()
                    key, held = column, more
                    continue
                own = merged(held[:4], more[:4], held[4], more[4])
                size = np.maximum(own[0], 1)
                others = np.where(held[0] == 0, more[4], held[4] + (more[4] - held[4]) * more[0] / size)
                held = np.vstack([own, others])
    if key is not None:
        yield row()


def correlations(df: DataFrame, cells: list[Column]) -> list[list[float | None]]:
    """Pearson's correlation of every two of the columns over the rows that have both.

    Null where fewer than two rows have both or one side is constant in them,
    not a number where one is infinite; missing and not-a-number cells are
    left out. Repeated rows count each; an empty table gives nulls. What
    comes back has a row for each column.
    """
    width = len(cells)
    wide = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cells)])
    blocks = wide.mapInArrow(lambda b: _blocks(b, width), _STATE)
    found = blocks.repartition("column").sortWithinPartitions("column").mapInArrow(lambda b: _merged(b, width), _STATE).collect()
    state = np.zeros((4, width, width))
    for r in found:
        state[:, r.column] = np.frombuffer(r.state).reshape(5, width)[:4]
    n, _, square, product = state
    with np.errstate(all="ignore"):
        r = np.clip(product / (np.sqrt(square) * np.sqrt(square.T)), -1.0, 1.0)
    known = (n > 1) & (square != 0) & (square.T != 0)
    return [[float(r[i, j]) if known[i, j] else None for j in range(width)] for i in range(width)]
