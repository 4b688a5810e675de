"""Quality rules: an isolation forest over the statistics that rules look at.

Every text gets its rule statistics in one pass. A forest of random splits is
grown on the statistics of all learnable rows, level by level; the mean path
length of a document says how easily it is set apart from them. The threshold
on that anomaly score is the one that rejects most of the bad rows among them
while it rejects at most a stated share of the good ones.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import order_statistics
from millrace.sources.scratch import settle

from .texts import batch_of, held_out, learnable_labels, rows_of, texts_of

_BLANKS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_marks", "n_distinct_words", "n_bytes")
_STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS + _MORE)])
_STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + _MORE)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total = covered = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def text_stats(text: str) -> tuple[int, ...]:
    """The counts named in COUNTS, and those that only the forest reads."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII blanks alone
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!") + raw.count(b"?"), len(set(words)), len(raw))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document, without a shuffle."""
    def run(batches):
        for batch in batches:
            yield batch_of(_STATS, [(i, *text_stats(t)) for i, t in rows_of(batch)])

    return texts_of(docs, id_col, text_col).mapInArrow(run, _STATS_DDL)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from the columns COUNTS + _MORE; a text without words has all rates zero."""
    words, chars, symbols, dup, repeat, lines, upper, marks, distinct, size = counts.astype(float).T
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    rates = np.column_stack([symbols / c, symbols / n, dup / np.maximum(lines, 1), repeat / n, upper / c, marks / c, distinct / n])
    return np.column_stack([np.log(rates + 0.01), chars / n])


@dataclass
class Forest:
    """Trees as arrays: node i splits `feature[i]` at `split[i]` into nodes left[i] and left[i] + 1; leaves have feature -1 and a path length."""

    feature: list[np.ndarray]
    split: list[np.ndarray]
    left: list[np.ndarray]
    length: list[np.ndarray]
    usual: float
    threshold: float = 1.0

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, split, left = self.feature[tree], self.split[tree], self.left[tree]
        rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            at = np.where(inner, left[at] + (x[rows, np.maximum(feature[at], 0)] >= split[at]), at)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1: 2 to the power of minus the mean path length over the usual one."""
        total = np.zeros(len(x))
        for tree, length in enumerate(self.length):
            total += length[self.leaves(tree, x)]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.usual)


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


_RANGE = [*(f"low{i}" for i in range(8)), *(f"high{i}" for i in range(8))]  # of the eight features
_NODES = pa.schema([("slot", pa.int64()), ("n", pa.int64()), *((c, pa.float64()) for c in _RANGE)])


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + _MORE])


def node_ranges(rows: DataFrame, forest: Forest, nodes: list[tuple[int, int]]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By place in `nodes`, a list of leaves (tree, node): the number of rows there and their least and largest features.

    One scan over all rows; a task gives a row for each leaf it has met.
    """
    slots = [np.full(len(f), -1) for f in forest.feature]
    for slot, (tree, node) in enumerate(nodes):
        slots[tree][node] = slot
    shared = rows.sparkSession.sparkContext.broadcast((forest, slots, len(nodes)))

    def run(batches):
        forest, slots, width = shared.value
        n, low, high = np.zeros(width, dtype=np.int64), np.full((width, 8), np.inf), np.full((width, 8), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = features(_counts_of(batch))
            for tree, own in enumerate(slots):
                at = own[forest.leaves(tree, x)]
                order = np.argsort(at, kind="stable")
                at, part = at[order], x[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                met, open_ = at[starts], at[starts] >= 0
                met = met[open_]
                n[met] += np.diff(np.r_[starts, len(at)])[open_]
                low[met] = np.minimum(low[met], np.minimum.reduceat(part, starts, axis=0)[open_])
                high[met] = np.maximum(high[met], np.maximum.reduceat(part, starts, axis=0)[open_])
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), *map(pa.array, low[met].T), *map(pa.array, high[met].T)], schema=_NODES)

    ddl = "slot long, n long, " + ", ".join(f"{c} double" for c in _RANGE)
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _RANGE]
    found = rows.select(*COUNTS, *_MORE).mapInArrow(run, ddl).groupBy("slot").agg(F.sum("n").alias("n"), *ends).collect()  # a row per leaf
    shared.unpersist()
    return {r.slot: (r.n, np.array(r[2:10]), np.array(r[10:18])) for r in found}


def grow_forest(rows: DataFrame, low: np.ndarray, high: np.ndarray, trees: int, depth_limit: int, seed: int) -> Forest:
    """Trees over all rows, grown level by level: one scan for each level of all trees.

    Half of the splits fall between the rows of a node, half anywhere in the
    node's part of the box from `low` to `high`, so that room where no row lies
    is cut off early too. At most trees * 2 ** depth_limit leaves; a leaf is as
    deep as it would be if its rows were told apart too.
    """
    rng = np.random.default_rng(seed)
    grown = [([-1], [0.0], [0], [0.0]) for _ in range(trees)]
    open_ = [(t, 0, low, high) for t in range(trees)]
    made = Forest([], [], [], [], 1.0)
    for depth in range(depth_limit + 1):
        made = Forest(*([np.array(own) for own in kind] for kind in zip(*grown)), made.usual)
        found = node_ranges(rows, made, [(t, node) for t, node, _, _ in open_])
        if not depth:
            made.usual = _usual(found[0][0] if found else 0) or 1.0
        todo = []
        for slot, (t, node, start, end) in enumerate(open_):
            n, least, most = found.get(slot, (0, start, end))
            inside = (least, most) if rng.random() < 0.5 else (start, end)
            wide = np.flatnonzero(inside[1] > inside[0])
            feature, split, left, length = grown[t]
            if depth == depth_limit or n < 2 or not len(wide):
                length[node] = depth + _usual(n)
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(inside[0][f], inside[1][f])
            feature[node], split[node], left[node] = f, at, len(feature)
            inner_high, inner_low = end.copy(), start.copy()
            inner_high[f] = inner_low[f] = at
            todo += [(t, len(feature), start, inner_high), (t, len(feature) + 1, inner_low, end)]
            feature += [-1, -1]
            split += [0.0, 0.0]
            left += [0, 0]
            length += [0.0, 0.0]
        open_ = todo
        if not open_:
            break
    return Forest(*([np.array(own) for own in kind] for kind in zip(*grown)), made.usual)


def calibrated_threshold(scores: DataFrame, false_share: float) -> float:
    """The lowest of `anomaly` to reject at, so that at most `false_share` of the rows of quality 1 have it or more; 1.01 (rejects none) without bad rows.

    Exact over all rows.
    """
    good, bad = scores.where("quality = 1"), scores.where("quality = 0")
    n, n_bad = scores.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    if not n_bad:
        return 1.01
    floor = -1.0
    if n > (allowed := int(n * false_share)):
        rank = ("anomaly", n - 1 - allowed)
        floor = order_statistics(good, {"anomaly": n}, {rank})[rank]
    least = bad.where(F.col("anomaly") > F.lit(floor)).agg(F.min("anomaly")).first()[0]
    return 1.01 if least is None else float((least + floor) / 2 + 1e-9)


def learnable_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, quality) of every learnable row; of several texts with one id that of the smallest counts."""
    texts = texts_of(docs).where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    stats = rule_statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *_MORE)).alias("s")).select("doc_id", "s.*")
    return settle(stats.join(learnable_labels(labels), "doc_id"), "learnt")


def _with_anomaly(stats: DataFrame, forest: Forest) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # trees * 2 ** (depth_limit + 1) nodes at most

    @F.arrow_udf("double")
    def anomaly(counts: pa.Array) -> pa.Array:
        columns = [c.to_numpy(zero_copy_only=False) for c in counts.flatten()]
        return pa.array(shared.value.score(features(np.column_stack(columns))), pa.float64())

    return stats.withColumn("anomaly", anomaly(F.struct(*COUNTS, *_MORE)))


def fit_forest(docs: DataFrame, labels: DataFrame, trees: int = 100, depth_limit: int = 8, false_share: float = 0.005, seed: int = 7) -> Forest:
    """Grown and calibrated on every learnable row, whatever its length.

    Trees are grown on rows labelled good, so that whatever is unlike them has
    short paths. Without labelled rows the forest rejects nothing.
    """
    stats = learnable_statistics(docs, labels)
    whole = node_ranges(stats, Forest([np.array([-1])], [np.zeros(1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1)], 1.0), [(0, 0)])
    if not whole:
        return Forest([], [], [], [], 1.0, 1.01)
    _, low, high = whole[0]
    forest = grow_forest(stats.where("quality = 1"), low, high, trees, depth_limit, seed)
    scores = settle(_with_anomaly(stats, forest).select("quality", "anomaly"), "scores")
    forest.threshold = calibrated_threshold(scores, false_share)
    return forest


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and the anomaly score of every document.

    Null and empty texts have no words and fail the base; a null id stays
    null; repeated rows are judged each; an empty table gives no rows; other
    columns are not read.
    """
    stats = rule_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = _with_anomaly(stats, forest).withColumn("base_failed", failed)
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < forest.threshold)).alias("kept"), "anomaly")
