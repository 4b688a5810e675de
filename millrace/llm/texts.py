"""What the text operators share: their input columns, scratch tables and a word-wise cached tokenizer."""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is empty, a null id stays null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """Ids and texts, of which only a few hundred are Python strings at once."""
    for i in range(0, batch.num_rows, 256):
        part = batch.slice(i, 256)
        yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learnable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): one row for each id outside the held-out fold; ids with both labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    known = known.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    return known.where("quality = other").drop("other")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, max_chars: int) -> DataFrame:
    """(doc_id, text, quality) of at most `rows` learnable documents per label, in an order that a hash gives.

    Ids are picked from the small label table first, those with both labels
    left out; the documents are scanned once and their texts shuffled only if
    picked, since at most 2 * rows ids are broadcast. Of several texts with one
    id one is taken, by hash. Texts over `max_chars` are left out of the sample
    (not out of any result).
    """
    known = learnable_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("quality = 1").orderBy(*order).limit(rows).union(known.where("quality = 0").orderBy(*order).limit(rows))
    found = texts_of(docs).where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"), F.first("quality").alias("quality"))


class Recent(dict):
    """Values made once for each key and kept in two generations of at most `limit` keys; what is asked for again outlives the rest."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CachedTokenizer:
    """Token ids of whole texts, exactly as the `tokenizers` library gives them.

    Plain text (printable, up to Latin-1) is merged by `tiktoken` over the same
    vocabulary, which is several times faster; anything else goes to the
    library itself. Where the vocabulary drops white space, a text is cut at
    blanks and line ends and each distinct word is encoded once.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        parsed = json.loads(self.library.to_str())
        model, letters = parsed["model"], _byte_letters()
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.words = Recent(self.word_ids)
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = ["".join(m) for m in model["merges"]]
        base = len(vocab) - len(merged)
        # Ranks can stand for merges only if ids follow the order of the merges.
        self.ranked = base == (512 if self.suffix else 256) and all(vocab[t] == base + i for i, t in enumerate(merged))
        pattern = _PATTERN if not self.suffix else "[^ ]+ "
        if self.ranked:
            end = self.suffix
            ranks = {bytes(letters[c] for c in (t[:-len(end)] if end and t.endswith(end) else t)) + (b" " if end and t.endswith(end) else b""): i for t, i in vocab.items()}
            if end:  # the blank that ends a word has no id of its own; these ranks are never reached alone
                ranks = {k: v for k, v in ranks.items() if k != b" "} | {b" ": max(ranks.values()) + 1}
            self.ranked = len(ranks) == len(vocab)
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={} if end else self.special)
        self.split = regex.compile(_WORDS) if self.suffix else None

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word_ids(self, word: str) -> bytes:
        if not (self.ranked and word.isprintable() and max(word, default="") <= "\xff" and "<|" not in word):
            return self._library(word) if word else b""
        word = word.lower()
        parts = word + " " if word.isalpha() else "".join([w + " " for w in self.split.findall(word)])
        ids = self.fast.encode_ordinary(parts)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.suffix:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        if self.ranked and max(text, default="") <= "\xff" and text.replace("\n", "").isprintable():
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return self._library(text)


# How the two kinds of vocabularies cut text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each vocabulary and Python worker, kept between tasks."""
    return CachedTokenizer(path)
