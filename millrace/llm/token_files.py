"""Token files compressed by a grammar per shard.

Documents are dealt out by ranges of their id and written in that order. A
shard holds the ids of some documents: pairs of ids that occur often are
replaced by new symbols, again and again, and the shard stores the pairs (its
rules), the length each symbol expands to, and the remaining symbols of each
document. No rule crosses the end of a document, so that any document, or any
run of ids in it, is decoded by itself.

A shard is one row of a Parquet table, which Spark writes and reads in
whatever store it is given.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import batch_of, rows_of, texts_of, tokenizer

_SHARD = pa.schema([
    ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()),
    ("ids", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("ends", pa.binary()), ("symbols", pa.binary())])
_SHARD_DDL = "part int, before long, n_tokens long, doc_ids array<long>, sizes binary, ids binary, rules binary, lengths binary, ends binary, symbols binary"
_HASH = np.uint64(0x9E3779B97F4A7C15)


def build_grammar(tokens: np.ndarray, ends: np.ndarray, least: int, most: int) -> dict:
    """Replace frequent pairs by new symbols, round after round until none is found `least` times.

    tokens: ids of documents one after another; ends: where each ends. A
    round counts all pairs, takes up to `most` of those found `least` times or
    more, most frequent first, and replaces them from left to right. Symbols
    below len(ids) stand for ids, the others for rules in order.
    """
    ids = np.flatnonzero(np.bincount(tokens)).astype(np.uint32)  # a vocabulary is small; nothing is sorted
    numbers = np.zeros(int(ids[-1]) + 1, np.uint32)
    numbers[ids] = np.arange(len(ids), dtype=np.uint32)
    symbols = numbers[tokens]
    rules, n_symbols, ends = [np.zeros((0, 2), np.uint32)], len(ids), ends.astype(np.int64)
    while len(symbols) > 1:
        # Two symbols fit one 32-bit key while there are few of them.
        kind, shift = (np.uint32, 16) if n_symbols + most <= 1 << 16 else (np.uint64, 32)
        keys = symbols[:-1].astype(kind) << kind(shift) | symbols[1:]
        inner = np.ones(len(keys), dtype=bool)
        inner[ends[:-1] - 1] = False
        pairs, counts = np.unique(keys[inner], return_counts=True)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")[:most]]
        chosen = np.sort(pairs[often])
        # A small table by hash finds the chosen pairs; of pairs that share a place one waits for the next round.
        place = lambda k: (k.astype(np.uint64) * _HASH >> np.uint64(46)).astype(np.int64)
        table = np.full(1 << 18, -1, dtype=np.int32)
        table[place(chosen)] = np.arange(len(chosen), dtype=np.int32)
        found = table[place(keys)]
        at = np.flatnonzero((found >= 0) & inner)
        at = at[chosen[found[at]] == keys[at]]
        # Of pairs that overlap in a run, every second one is taken.
        index = np.arange(len(at))
        starts = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, index, 0))
        at = at[(index - starts) % 2 == 0]
        rules.append(np.column_stack([chosen >> kind(shift), chosen & kind((1 << shift) - 1)]).astype(np.uint32))
        symbols[at] = n_symbols + found[at]
        gone = np.zeros(len(symbols), dtype=bool)
        gone[at + 1] = True
        ends = ends - np.cumsum(gone)[ends - 1]
        symbols = symbols[~gone]
        n_symbols += len(chosen)
    made = np.concatenate(rules)
    lengths = np.ones(n_symbols, dtype=np.int64)
    at = len(ids)
    for level in rules:
        lengths[at:at + len(level)] = lengths[level].sum(axis=1)
        at += len(level)
    return {"ids": ids.astype("<u4"), "rules": made.astype("<u4"), "lengths": lengths.astype("<u4"), "ends": ends.astype("<u4"), "symbols": symbols.astype("<u4")}


class Shard:
    """A shard as read back."""

    def __init__(self, row: dict):
        u4 = lambda name: np.frombuffer(row[name], dtype="<u4")
        self.doc_ids = row["doc_ids"]
        self.sizes, self.ids, self.rules, self.lengths = u4("sizes"), u4("ids"), u4("rules").reshape(-1, 2), u4("lengths").astype(np.int64)
        self.ends, self.symbols = u4("ends").astype(np.int64), u4("symbols")
        # What each symbol expands to, one after another; a rule's parts come before it.
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.spelled = np.empty(self.starts[-1], dtype="<u4")
        base = len(self.ids)
        self.spelled[:base] = self.ids
        todo = np.arange(len(self.rules))
        while len(todo):
            made = (self.rules[todo] < base + todo[0]).all(axis=1)  # all rules of a round at least
            ready, todo = todo[made], todo[~made]
            left, right = self.rules[ready].T.astype(np.int64)
            self._copy(base + ready, left, 0)
            self._copy(base + ready, right, self.lengths[left])

    def _copy(self, to: np.ndarray, symbols: np.ndarray, shift) -> None:
        size = self.lengths[symbols]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.spelled[np.repeat(self.starts[to] + shift, size) + within] = self.spelled[np.repeat(self.starts[symbols], size) + within]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.lengths[symbols]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.spelled[np.repeat(self.starts[symbols], size) + within]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the k-th document; only the symbols that cover them are expanded."""
        own = self.symbols[self.ends[k - 1] if k else 0:self.ends[k]]
        reach = np.cumsum(self.lengths[own])
        stop = int(reach[-1]) if stop is None else min(stop, int(reach[-1]))
        if start >= stop:
            return self.spelled[:0]
        first, last = np.searchsorted(reach, start, "right"), np.searchsorted(reach, stop, "left")
        skipped = int(reach[first - 1]) if first else 0
        return self.expand(own[first:last + 1])[start - skipped:stop - skipped]

    def documents(self):
        """(doc_id, ids) of every document, expanded together."""
        tokens, at = self.expand(self.symbols), 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist()):
            yield doc_id, tokens[at:at + n]
            at += n


def token_shards(docs: DataFrame, path: str, end_id: int = 1, shard_tokens: int = 1 << 20, least: int = 8, most: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard, in ascending order of documents within and between parts.

    Each document's ids end in `end_id`. A shard is closed once it has
    `shard_tokens` ids, so a task holds one shard and one document beyond.
    Null texts are empty (their end id alone), null ids come first, repeated
    rows follow each other, an empty table gives no shards.
    """
    def run(batches):
        own, end = tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        ids, parts, total = [], [], 0

        def shard():
            sizes = np.array([len(p) // 4 for p in parts], dtype="<u4")
            made = build_grammar(np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(sizes, dtype=np.int64), least, most)
            return batch_of(_SHARD, [(part, before, total, ids, sizes.tobytes(), *(made[c].tobytes() for c in ("ids", "rules", "lengths", "ends", "symbols")))])

        for batch in batches:
            for doc_id, text in rows_of(batch):
                parts.append(own.encode(text) + end)
                ids.append(doc_id)
                total += len(parts[-1]) // 4
                if total >= shard_tokens:
                    yield shard()
                    before, total, ids, parts = before + total, 0, [], []
        if parts:
            yield shard()

    order = [F.col("doc_id"), F.xxhash64("text")]  # rows of one id, or without any, are dealt out too
    ordered = texts_of(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, _SHARD_DDL)


def write_tokens(docs: DataFrame, path: str, to: str, **options) -> DataFrame:
    """Write the shards of `docs` to the folder `to` and return them as read back from there."""
    token_shards(docs, path, **options).write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.parquet(to)


_DOCUMENTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def document_table(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from shards; start counts the ids of all documents before it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["before"], []
                for doc_id, ids in Shard(row).documents():
                    rows.append((row["part"], doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield batch_of(_DOCUMENTS, rows)

    decoded = shards.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row per part, that is per task that wrote: the only thing that is ordered as a whole and broadcast.
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_first"))
    return decoded.join(F.broadcast(first), "part").select("doc_id", (F.col("start") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32")
