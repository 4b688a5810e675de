"""Near duplicates by SimHash and the generalised pigeonhole principle.

Equal fingerprints are grouped first. The 64 bits are split into parts of bits
that tend to agree; part i gets a threshold t(i), all of them adding up to
radius - parts + 1, so that two fingerprints within the radius are within t(i)
in one part at least. Dynamic programming chooses the thresholds (and the
number of parts) by what they are estimated to cost: rows to shuffle and
candidates to compare. A part within t is found by signatures: one side lists
all values within t / 2 bits of its own (rounded down), the other all within
the rest, and the two share a value. Candidates are verified by their whole
fingerprints where they meet; of the links found in a batch only a spanning
forest goes on to the components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.sources.scratch import settle

from .components import components
from .texts import batch_of, rows_of, texts_of

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Signature groups beyond this are split into cells; links that a batch holds before it reduces them to a forest.
_CELL_ROWS, _LINKS = 4096, 1_000_000
#: A shuffled row costs about as much as so many comparisons.
_ROW_COST = 60


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """SimHash of word shingles, repeats included: a bit is 1 if it is set in over half of their hashes; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, second: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp2): SimHash over `shingle` words with A-Z lower-cased, and over `second` words (0 if not asked for)."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in rows_of(batch):
                words = text.encode().lower().split()
                rows.append((doc_id, _signed(fingerprint(words, shingle)), _signed(fingerprint(words, second, 43)) if second else 0))
            yield batch_of(_PRINTS, rows)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, fp2 long")


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of equal size, each part starting from the lowest bit left and taking those that correlate with it most."""
    set_bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        related = np.abs(np.nan_to_num(np.corrcoef(set_bits.T))) if len(sample) > 1 else np.eye(64)
    left, made = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (related[b, own].sum(), -b))
            left.remove(best)
            own.append(best)
        made.append(sorted(own))
    return made


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 (the part is not used) up that add up to `total` at the least cost; costs[i][t + 1] is that of part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                new = (cost + own[t + 1], chosen + [t])
                if done + t not in after or new < after[done + t]:
                    after[done + t] = new
        best = after
    return best[total][1]


def plan(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to use, at the least estimated cost for `rows` fingerprints.

    `sample` only steers the estimate: any plan finds every pair.
    """
    sample = sample[:1500]
    a, b = np.triu_indices(len(sample), 1)
    differ = sample[a] ^ sample[b]
    found: list[tuple[float, list[tuple[list[int], int]]]] = []
    for parts in range(2, min(radius + 1, 6) + 1) if radius else [1]:
        groups, total = group_bits(sample, parts), radius - parts + 1
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << x for x in bits))
            apart = np.bincount(np.bitwise_count(differ & mask).astype(np.int64), minlength=65)
            own = [0.0]
            for t in range(min(total + parts, len(bits), 6) + 1):
                near, far = t // 2, t - t // 2
                listed = _ball(len(bits), far) + (_ball(len(bits), near) if near < far else 0)
                even = _ball(len(bits), near) * _ball(len(bits), far) / 2 ** len(bits)
                share = max(even, apart[:t + 1].sum() / max(len(differ), 1))
                own.append(rows * listed * _ROW_COST + rows * rows / 2 * share)
            costs.append(own)
        chosen = allocate(costs, total)
        found.append((sum(c[t + 1] for c, t in zip(costs, chosen)), [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _signatures(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(sig, kind, node, fp, fp2): kind 0 lists the near values, 1 the far ones."""
    made = None
    for i, (bits, t) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        radii = {0: t // 2} | ({1: t - t // 2} if t % 2 else {})
        for kind, radius in radii.items():
            flips = [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(bits, k)]
            listed = f"transform(array({', '.join(map(_long, flips))}), x -> xxhash64({i}, (fp & {_long(mask)}) ^ x))"
            own = nodes.select(F.expr(f"explode({listed})").alias("sig"), F.lit(kind).alias("kind"), "node", "fp", "fp2")
            made = own if made is None else made.union(own)
    return made


def _long(x: int) -> str:
    return f"bigint('{x}')"


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one it is linked with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        left, right = label[a], label[b]
        if (left == right).all():
            break
        least = np.minimum(left, right)
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


class _Linker:
    """Compares the rows of each signature and cell, which come sorted."""

    def __init__(self, radius: int, radius2: int):
        self.radius, self.radius2, self.a, self.b, self.held = radius, radius2, [], [], 0

    def take(self, t: dict[str, np.ndarray]) -> None:
        fp, fp2, node, kind, side = t["fp"].view(np.uint64), t["fp2"].view(np.uint64), t["node"], t["kind"], t["side"]
        key, cell = t["sig"], t["cell"]
        at, step = np.arange(len(key) - 1), 1
        while len(at):
            to = at + step
            same = (key[at] == key[to]) & (cell[at] == cell[to])
            at, to = at[same], to[same]
            # In a cell of two different chunks only pairs across them count: each chunk has a cell of its own.
            use = ((kind[at] == 0) | (kind[to] == 0)) & ((side[at] != side[to]) | (side[at] == 2)) & (node[at] != node[to])
            i, j = at[use], to[use]
            close = np.bitwise_count(fp[i] ^ fp[j]) <= self.radius
            i, j = i[close], j[close]
            if self.radius2 < 64:
                close = np.bitwise_count(fp2[i] ^ fp2[j]) <= self.radius2
                i, j = i[close], j[close]
            if len(i):
                self.a.append(node[i])
                self.b.append(node[j])
                self.held += len(i)
                if self.held > _LINKS:
                    self.reduce()
            step += 1
            at = at[at + step < len(key)]

    def reduce(self) -> None:
        if self.held:
            a, b = _forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.held = [a], [b], len(a)

    def edges(self) -> pa.RecordBatch:
        self.reduce()
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.a, self.b))
        self.a, self.b, self.held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _linked(batches, radius: int, radius2: int):
    """Edges of a partition sorted by signature and cell; groups that a batch cuts are carried over."""
    names = ("sig", "cell", "kind", "side", "node", "fp", "fp2")
    linker, carry = _Linker(radius, radius2), None
    for batch in batches:
        t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if carry is not None:
            t = {n: np.concatenate([carry[n], t[n]]) for n in names}
        if not len(t["sig"]):
            continue
        other = np.flatnonzero((t["sig"] != t["sig"][-1]) | (t["cell"] != t["cell"][-1]))
        cut = other[-1] + 1 if len(other) else 0
        carry = {n: v[cut:] for n, v in t.items()}
        linker.take({n: v[:cut] for n, v in t.items()})
        if linker.held > _LINKS // 2:
            yield linker.edges()
    if carry is not None:
        linker.take(carry)
    yield linker.edges()


def link_nodes(nodes: DataFrame, radius: int, radius2: int = 64, cell_rows: int = _CELL_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes (node, fp, fp2) within `radius` bits in fp and `radius2` in fp2.

    A signature with more than `cell_rows` rows is dealt into chunks, and each
    two chunks meet in a cell of their own, so that a task holds two chunks at
    most and every pair still meets.
    """
    rows = nodes.count()
    steer = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(1500).collect()  # for the estimate alone
    parts = plan(np.array([r.fp for r in steer], dtype=np.int64).view(np.uint64), rows, radius)
    sigs = _signatures(nodes, parts).withColumn("cell", F.lit(0).cast("long")).withColumn("side", F.lit(2))
    large = settle(sigs.groupBy("sig").count().where(F.col("count") > cell_rows), "large")
    if not large.isEmpty():
        many = F.ceil(F.coalesce(F.col("count"), F.lit(0)) / (cell_rows // 2)).cast("long")
        dealt = sigs.drop("cell", "side").join(large, "sig", "left").withColumn("_many", many)
        dealt = dealt.withColumn("_own", F.when(F.col("_many") > 0, F.pmod(F.xxhash64("node"), F.col("_many"))))
        # Cell (x, y), x <= y, is numbered x * many + y; a row of chunk c stands in those with c in them.
        cells = F.expr("""CASE WHEN _many > 0 THEN transform(sequence(0L, _many - 1), o -> struct(
            least(o, _own) * _many + greatest(o, _own) AS cell,
            CASE WHEN o = _own THEN 2 WHEN o < _own THEN 1 ELSE 0 END AS side)) ELSE array(struct(0L AS cell, 2 AS side)) END""")
        sigs = dealt.withColumn("_c", F.explode(cells)).select("sig", F.col("_c.cell").alias("cell"), F.col("_c.side").alias("side"), "kind", "node", "fp", "fp2")
    sigs = sigs.select("sig", "cell", "kind", "side", "node", "fp", "fp2")
    return sigs.repartition("sig", "cell").sortWithinPartitions("sig", "cell").mapInArrow(lambda b: _linked(b, radius, radius2), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, second: int | None = None, radius2: int = 64,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable over links, itself included.

    Documents link when their fingerprints differ in at most `radius` bits
    and, where a `second` shingle length is given, those over it in at most
    `radius2`. Null and empty texts have fingerprint 0 and link like any
    other; a null id is passed over by the minimum; repeated rows are
    answered each; an empty table gives no rows; other columns are not read.
    """
    prints = settle(fingerprints(docs, shingle, second, id_col, text_col), "prints")
    nodes = prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("first"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(link_nodes(nodes, radius, radius2))
    reached = roots.join(nodes.select("node", "first"), "node")
    least = reached.groupBy("root").agg(F.min("first").alias("least"))
    linked = reached.join(least, "root").select("node", "least")
    classes = nodes.join(linked, "node", "left").select("fp", "fp2", F.coalesce("least", "first").alias("component_id"))
    return prints.join(classes, ["fp", "fp2"]).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
