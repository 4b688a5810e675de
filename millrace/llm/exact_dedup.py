"""Exact deduplication over an index of live digests behind cuckoo filters.

The index has one row per part of the digest space: a cuckoo filter of short
fingerprints, and the stored keys (whole digests with the row that stays and
the number of copies). A digest is looked up in the filter first; only a hit
reads the stored keys, and counts when the whole digest is there. Deleting a
row takes its digest out of filter and keys when the last copy goes. When a
fingerprint finds no free slot the filter is doubled and filled again from the
stored keys.

Copies are combined before the shuffle: each task keeps an index of what it
has read and hands on one row per live digest, so a text that is a third of
the table reaches its part as a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle

from .texts import batch_of, rows_of, texts_of

_SLOTS = 4
_KICKS = 200
#: Live digests that a task holds before it hands them on.
_FLUSH = 200_000

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
_LIVE = pa.schema([("part", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("n", pa.int64())])
_INDEX = pa.schema([("part", pa.int32()), ("buckets", pa.int32()), ("filter", pa.binary()), ("digests", pa.list_(pa.binary())),
                    ("keep_ids", pa.list_(pa.int64())), ("keep_rows", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64()))])


class CuckooIndex:
    """Cuckoo filter over digests, with the keys it stands for in content buckets."""

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.filter = [0] * (buckets * _SLOTS)
        self.content: list[list[list]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def may_hold(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.filter[first * _SLOTS:first * _SLOTS + _SLOTS] or mark in self.filter[second * _SLOTS:second * _SLOTS + _SLOTS]

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, keep, copies]; the filter answers most misses alone."""
        if self.may_hold(digest):
            for entry in self.content[self._places(digest)[1]]:
                if entry[0] == digest:
                    return entry
        return None

    def insert(self, digest: bytes, keep: tuple, copies: int = 1) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[1], entry[2] = max(entry[1], keep), entry[2] + copies
            return
        self.size += 1
        self.content[self._places(digest)[1]].append([digest, keep, copies])
        if not self._mark(digest):
            self._grow()

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """Take copies away; the digest dies with the last one. Whether it was live."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[2] -= copies
        if entry[2] <= 0:
            mark, first, second = self._places(digest)
            self.content[first].remove(entry)
            home = first if mark in self.filter[first * _SLOTS:first * _SLOTS + _SLOTS] else second
            self.filter[self.filter.index(mark, home * _SLOTS, home * _SLOTS + _SLOTS)] = 0
            self.size -= 1
        return True

    def _mark(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if not self.filter[slot]:
                    self.filter[slot] = mark
                    return True
        bucket = second
        for kick in range(_KICKS):
            slot = bucket * _SLOTS + (mark + kick) % _SLOTS
            self.filter[slot], mark = mark, self.filter[slot]
            bucket = self._other(bucket, mark)
            for free in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if not self.filter[free]:
                    self.filter[free] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double the filter until every stored key has a slot."""
        kept, buckets = list(self.entries()), self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            for entry in kept:
                self.content[self._places(entry[0])[1]].append(entry)
            if all(self._mark(entry[0]) for entry in kept):
                return

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket

    def row(self, part: int) -> tuple:
        kept = list(self.entries())
        marks = b"".join(m.to_bytes(2, "little") for m in self.filter)
        return (part, self.buckets, marks, [e[0] for e in kept], [e[1][1] for e in kept], [e[1][2] for e in kept], [e[2] for e in kept])

    @classmethod
    def from_row(cls, row: dict) -> CuckooIndex:
        made = cls(row["buckets"])
        made.filter = [int.from_bytes(row["filter"][i:i + 2], "little") for i in range(0, len(row["filter"]), 2)]
        for digest, doc_id, at, n in zip(row["digests"], row["keep_ids"], row["keep_rows"], row["copies"]):
            made.content[made._places(digest)[1]].append([digest, _keep(doc_id, at), n])
            made.size += 1
        return made


def _keep(doc_id: int | None, row: int) -> tuple:
    """Order of rows with one text: null ids first, then by id, then by the row's own number."""
    return (doc_id is not None, doc_id, row) if doc_id is not None else (False, None, row)


def _part(digest: bytes, parts: int) -> int:
    return int.from_bytes(digest[16:20], "little") % parts


def text_digest(text: str) -> bytes:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z alone."""
    return hashlib.sha256(text.encode().lower()).digest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row), written once: `row` numbers the rows, so that repeated rows are told apart."""
    def run(batches):
        for batch in batches:
            yield batch_of(_DIGESTS, [(i, text_digest(t)) for i, t in rows_of(batch)])

    made = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary")
    return settle(made.withColumn("row", F.monotonically_increasing_id()), "digests")


def _combined(rows: DataFrame, parts: int) -> DataFrame:
    """One row per live digest and task."""
    def run(batches):
        index = CuckooIndex()

        def flush():
            return batch_of(_LIVE, [(_part(e[0], parts), e[0], e[1][1], e[1][2], e[2]) for e in index.entries()])

        for batch in batches:
            for doc_id, digest, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "row"))):
                index.insert(digest, _keep(doc_id, row))
            if index.size >= _FLUSH:
                yield flush()
                index = CuckooIndex()
        yield flush()

    return rows.mapInArrow(run, "part int, digest binary, keep_id long, keep_row long, n long")


def _merge(key: tuple[pa.Scalar, ...], live: pa.Table) -> pa.Table:
    index = CuckooIndex()
    for doc_id, row, digest, n in zip(*(live.column(c).to_pylist() for c in ("keep_id", "keep_row", "digest", "n"))):
        index.insert(digest, _keep(doc_id, row), n)
    return pa.Table.from_batches([batch_of(_INDEX, [index.row(key[0].as_py())])])


_INDEX_DDL = "part int, buckets int, filter binary, digests array<binary>, keep_ids array<long>, keep_rows array<long>, copies array<long>"


def build_index(rows: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """The index of a `digests` table: one row per part, as many parts as hold about `rows_per_part` keys each."""
    parts = max(1, -(-rows.count() // rows_per_part))
    return _combined(rows, parts).groupBy("part").applyInArrow(_merge, _INDEX_DDL)


def delete_rows(index: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """The index without the copies in a `digests` table.

    Digests that are not live are passed over. Whoever deletes the row that
    stays must say anew which one stays, by inserting the rows that are left.
    """
    def run(_key: tuple[pa.Scalar, ...], old: pa.Table, gone: pa.Table) -> pa.Table:
        made = []
        for row in old.to_pylist():
            live = CuckooIndex.from_row(row)
            for digest, n in zip(gone.column("digest").to_pylist(), gone.column("n").to_pylist()):
                live.delete(digest, n)
            made.append(live.row(row["part"]))
        return pa.Table.from_batches([batch_of(_INDEX, made)])

    return index.groupBy("part").cogroup(_combined(rows, parts).groupBy("part")).applyInArrow(run, _INDEX_DDL)


def live_digests(index: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, n): the stored keys of an index, one row each."""
    zipped = F.arrays_zip("digests", "keep_ids", "keep_rows", "copies")
    return index.select(F.explode(zipped).alias("e")).select(
        F.col("e.digests").alias("digest"), F.col("e.keep_ids").alias("keep_id"), F.col("e.keep_rows").alias("keep_row"), F.col("e.copies").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased) the row with the largest id stays; of rows
    that repeat an id, one. Null texts are empty, null ids come before all
    others, an empty table gives no rows, other columns are not read.
    """
    rows = digests(docs, id_col, text_col)
    live = live_digests(build_index(rows))
    return rows.join(live, "digest", "left").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text `exact_dedup` keeps; rows that repeat id and text count once.

    Rows are known by id and digest, so that null and repeated ids are safe.
    """
    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array((text_digest(t.as_py() or "") for t in texts), pa.binary())

    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so that none of these clashes
    of, keep, kept_of = f"{free}of", f"{free}keep", f"{free}kept"
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(keep), F.unhex("text_sha256").alias(kept_of))
    named = docs.withColumn(of, digest(F.col(text_col))).dropDuplicates([id_col, of])
    return named.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(of) == F.col(kept_of)), "left_semi").drop(of)
