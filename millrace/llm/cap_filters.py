"""Near duplicates among vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their cosine reaches a
threshold. Two vectors of high cosine pass many filters together, unrelated
ones hardly any. The directions form a random product code: after a random
rotation a vector is cut into blocks, each block has a few random code words,
and a direction is any choice of one word for each block. Several codes of this
kind, each with a rotation of its own, are put together. A vector's list of
all filters that it passes is decoded block by block, dropping a choice as
soon as the best words of the blocks to come cannot lift it to the threshold;
nothing is done for filters that are not passed. Vectors that share a filter
meet and are verified in double precision.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle

from .components import components

#: Rows of a filter beyond which they are dealt into cells; links that a task holds before it reduces them.
_CELL_ROWS, _LINKS = 2048, 1_000_000
#: Independent codes whose lists are put together.
CODES = 12
#: A shuffled row costs about as much as so many comparisons; pairs that a plan is simulated on.
_ROW_COST, _TRIALS = 500, 600
_FOUND = "a long, b long, links long"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


class ProductCode:
    """words ** blocks directions in `dims` dimensions; the same arguments give the same code in any process."""

    def __init__(self, dims: int, blocks: int, words: int, seed: int = 0):
        rng = np.random.default_rng([13, seed, dims, blocks, words])
        self.blocks, self.words, self.width = blocks, words, 1 << (dims - 1).bit_length()
        self.signs = rng.choice([-1.0, 1.0], (3, self.width))
        self.cuts = np.linspace(0, self.width, blocks + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            book = rng.normal(size=(words, b - a))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Three rounds of random signs and a Walsh-Hadamard transform."""
        y = np.zeros((len(x), self.width))
        y[:, :x.shape[1]] = x
        for signs in self.signs:
            y, h = y * signs, 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.width)
                h *= 2
            y /= np.sqrt(self.width)
        return y

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        y = self.rotated(x)
        return [y[:, a:b] @ book.T / np.sqrt(self.blocks) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def decode(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter whose cosine with the unit vector x[row] is at least the threshold; filters ascend in each row."""
        made, step = [(np.zeros(0, int), np.zeros(0, int))], max(1, 2_000_000 // self.words ** min(2, self.blocks))
        for start in range(0, len(x), step):
            scores = self.scores(x[start:start + step])
            best = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
            best = np.vstack([best, np.zeros_like(best[:1])])
            row = np.arange(len(scores[0]))
            found, total = np.zeros(len(row), int), np.zeros(len(row))
            for k, s in enumerate(scores):
                reached = s[row] + total[:, None]
                at, word = np.nonzero(reached >= (threshold - best[k + 1][row])[:, None])
                row, found, total = row[at], found[at] * self.words + word, reached[at, word]
            made.append((row + start, found))
        return tuple(np.concatenate(m) for m in zip(*made))

    def share(self, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
        """Filters per vector, and the share of pairs (x[i], y[i]) with a filter in common."""
        row, found = self.decode(x, threshold)
        other = sum(s[row, found // self.words ** (self.blocks - 1 - k) % self.words] for k, s in enumerate(self.scores(y)))
        return len(row) / len(x), len(np.unique(row[other >= threshold])) / len(x)


@functools.lru_cache(maxsize=64)
def product_code(dims: int, blocks: int, words: int, seed: int = 0) -> ProductCode:
    return ProductCode(dims, blocks, words, seed)


def plan(dims: int, rows: float, squares: float, similarity: float, miss: float) -> tuple[int, int, float]:
    """(blocks, words, threshold) of least estimated cost that lose at most a share `miss` of pairs at the similarity.

    `rows` vectors in groups whose squared sizes add up to `squares`. The
    threshold is the largest at which `CODES` independent codes together still
    give enough simulated pairs of exactly the similarity, the hardest ones, a
    common filter. One code alone would need a much lower one, for the sake of
    a few vectors that lie far from all of its directions.
    """
    rng = np.random.default_rng(dims)
    x, g = rng.normal(size=(2, _TRIALS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-9)
    y = x if dims == 1 else similarity * x + np.sqrt(max(0.0, 1 - similarity ** 2)) * g
    best, least = None, 1 - miss ** (1 / CODES)
    blocks = 1 if dims < 16 else 2  # more blocks list three times as many filters for the same recall
    for words in (8, 16, 32, 64, 128, 256, 512):
        total = words ** blocks
        if total < 64 and dims > 1:
            continue
        # From above: what a threshold lets through is listed, so one that is far too low would cost most.
        code, low, high = product_code(dims, blocks, words), 0.95, 1.0
        while low > -1 and code.share(x, y, low)[1] < least:
            low, high = low - 0.05, low
        for _ in range(5):
            middle = (low + high) / 2
            if code.share(x, y, middle)[1] >= least:
                low = middle
            else:
                high = middle
        each = code.share(x, y, low)[0]
        cost = CODES * (rows * each * _ROW_COST + squares / 2 * each * each / total)
        if best is None or cost < best[0]:
            best = (cost, blocks, words, low)
        elif CODES * rows * each * _ROW_COST > best[0]:
            break
    return best[1:]


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passed(dims: int, how: tuple[int, int, float], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all codes; filters ascend in each row."""
    blocks, words, threshold = how
    lists = [product_code(dims, blocks, words, seed).decode(x, threshold) for seed in range(CODES)]
    row, found = (np.concatenate([x[k] + k * seed * words ** blocks for seed, x in enumerate(lists)]) for k in (0, 1))
    order = np.argsort(row, kind="stable")
    return row[order], found[order]


def _passed(batches, plans: dict[int, tuple[int, int, float]], kind: str):
    """Each node with its vector as bytes and its list of filters."""
    size = np.dtype(kind).itemsize
    for batch in batches:
        lists = batch.column("embedding")
        starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
        dims = np.diff(starts)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            rows = [values[starts[i]:starts[i + 1]].tobytes() for i in at]
            row, found = passed(int(d), plans[int(d)], unit(rows, kind))
            ends = np.searchsorted(row, np.arange(len(at) + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("label").take(pa.array(at)), pa.array([int(d)] * len(at), pa.int32()), batch.column("node").take(pa.array(at)),
                batch.column("copies").take(pa.array(at)), pa.array(rows, pa.binary(int(d) * size)).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int64()))], names=["label", "dims", "node", "copies", "vector", "filters"])


class _Found:
    """Links of a task: how many each node has, and edges with the same components."""

    def __init__(self):
        self.counts, self.edges, self.held = [], [], 0

    def add(self, node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        some = np.flatnonzero(links)
        self.counts.append((node[some], links[some]))
        # A node's edge to the first one that it is linked with would cut components; a forest keeps them.
        label = np.arange(len(node))
        while (label[i] != label[j]).any():
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            while (label[label] != label).any():
                label = label[label]
        other = np.flatnonzero(label != np.arange(len(node)))
        self.edges.append((node[label[other]], node[other]))
        self.held += len(some) + len(other)

    def rows(self) -> pa.RecordBatch:
        nodes, links = (np.concatenate([c[k] for c in self.counts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a, b = (np.concatenate([e[k] for e in self.edges] or [np.zeros(0, np.int64)]) for k in (0, 1))
        own, at = np.unique(nodes, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, links)
        pairs = np.unique(np.stack([a, b]), axis=1)
        self.__init__()
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([own, pairs[0]]), pa.int64()),
            pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(pairs[1], pa.int64())]),
            pa.concat_arrays([pa.array(total, pa.int64()), pa.nulls(pairs.shape[1], pa.int64())])], schema=_FOUND_ARROW)


def _met_before(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i[k] and j[k] share an earlier filter, where they have been counted."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    lists = [earlier[r] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    _, which, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = often[which] > 1
    owner, (_, which) = owner[shared], np.unique(which[shared], return_inverse=True)
    met = np.zeros(len(i), bool)
    for start in range(0, int(which.max(initial=-1)) + 1, 1024):
        inside = (which >= start) & (which < start + 1024)
        has = np.zeros((len(rows), 1024), np.float32)
        has[owner[inside], which[inside] - start] = 1
        met |= (has @ has.T)[a, b] > 0
    return met


def _verified(batches, similarity: float, kind: str):
    """Links of the vectors that meet; rows come sorted by label, length, filter and cell, groups that a batch cuts are carried over."""
    found, carry = _Found(), None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        keys = [table.column(c).combine_chunks() for c in ("label", "dims", "filter", "cell")]
        change = functools.reduce(np.logical_or, [(k.slice(1).to_numpy(zero_copy_only=False) != k.slice(0, len(k) - 1).to_numpy(zero_copy_only=False)) for k in keys])
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        carry = table.slice(starts[-1])
        for a, b in zip(starts, starts[1:]):
            _compare(found, table.slice(a, b - a), similarity, kind)
        if found.held > _LINKS:
            yield found.rows()
    if carry is not None:
        _compare(found, carry, similarity, kind)
    yield found.rows()


def _compare(found: _Found, group: pa.Table, similarity: float, kind: str) -> None:
    if group.num_rows < 2:
        return
    x, side = unit(group.column("vector").to_pylist(), kind), group.column("side").to_numpy()
    node, copies = (group.column(c).to_numpy() for c in ("node", "copies"))
    close = x @ x.T >= similarity
    # In a cell of two different chunks only pairs across them count: each chunk has a cell of its own.
    i, j = np.nonzero(np.triu(close & ((side[:, None] != side) | (side[:, None] == 2)), 1))
    if len(i):
        lists = group.column("earlier").to_pylist()
        new = ~_met_before([np.array(e, np.int64) for e in lists], i, j)
        if new.any():
            found.add(node, copies, i[new], j[new])


def usable(vectors: DataFrame, vector_col: str, label_col: str):
    """Vectors that can link: of a label, not empty, not zero, all components finite."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return F.coalesce(F.col(label_col).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def near_vectors(vectors: DataFrame, similarity: float = 0.93, miss: float = 0.001, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label", cell_rows: int = _CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows of the same label link where the cosine of their vectors, in double
    precision, is at least `similarity`; vectors of different length do not.
    n_links counts the other rows that a row links with, component_id is the
    smallest id that links reach, kept says whether it is the row's own.
    Every link reported holds; a pair of exactly `similarity` is missed with a
    probability of about `miss`, closer ones hardly ever.

    Null labels, null, empty and zero vectors and those with null, NaN or
    infinite components link with nothing. Equal vectors of a label are
    compared once and counted. Null ids are passed over by the minimum, and
    such a row is kept if nothing with an id is reached. Repeated rows count as
    rows. An empty table gives no rows; other columns are not read. Long
    vectors are held a batch at a time. The driver reads a row for each length
    of vectors. Filters of more than `cell_rows` vectors are dealt into cells.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    kind = {"float": "<f4"}.get(dict(vectors.dtypes)[vector_col].removeprefix("array<").rstrip(">"), "<f8")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    given = settle(given.withColumn("usable", usable(given, "embedding", "label")), "vectors")
    used = given.where("usable")
    nodes = used.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.size("embedding").alias("dims"), "label").agg(F.count("*").cast("double").alias("n"))
    plans = {r["dims"]: plan(r["dims"], r["rows"], r["squares"], similarity, miss)
             for r in sizes.groupBy("dims").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares")).collect()}
    passed = nodes.select("label", "embedding", "node", "copies").mapInArrow(
        lambda b: _passed(b, plans, kind), "label string, dims int, node long, copies long, vector binary, filters array<long>")
    passed = settle(passed, "passed")

    large = settle(passed.select("label", "dims", F.explode("filters").alias("filter")).groupBy("label", "dims", "filter").count()
                   .where(F.col("count") > cell_rows).withColumn("many", F.ceil(F.col("count") / (cell_rows // 2))).drop("count"), "large")
    rows = passed.select("label", "dims", "node", "copies", "vector", F.posexplode("filters").alias("_at", "filter"), "filters")
    rows = rows.withColumn("earlier", F.expr("slice(filters, 1, _at)")).drop("filters", "_at")
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= 100_000 else large, ["label", "dims", "filter"], "left")
        rows = rows.withColumn("_own", F.when(F.col("many") > 0, F.pmod(F.xxhash64("node"), F.col("many"))))
        # Cell (x, y), x <= y, is numbered x * many + y; a row of chunk c stands in those with c in them.
        cells = F.expr("""CASE WHEN many > 0 THEN transform(sequence(0L, many - 1), o -> struct(least(o, _own) * many + greatest(o, _own) AS cell,
            CASE WHEN o = _own THEN 2 WHEN o < _own THEN 1 ELSE 0 END AS side)) ELSE array(struct(0L AS cell, 2 AS side)) END""")
        rows = rows.withColumn("_c", F.explode(cells)).withColumns({"cell": F.col("_c.cell"), "side": F.col("_c.side")})
    else:
        rows = rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(2)})
    rows = rows.select("label", "dims", "filter", "cell", "side", "node", "copies", "vector", "earlier")
    found = rows.repartition("label", "dims", "filter", "cell").sortWithinPartitions("label", "dims", "filter", "cell")
    found = settle(found.mapInArrow(lambda b: _verified(b, similarity, kind), _FOUND), "found")

    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    reached = roots.join(nodes.select("node", "first"), "node")
    least = reached.groupBy("root").agg(F.min("first").alias("least"))
    linked = reached.join(least, "root").select("node", "least")
    known = nodes.join(links, "node", "left").join(linked, "node", "left")
    known = known.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    answered = used.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = given.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
