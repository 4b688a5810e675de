"""Repeated passages by prefix-free parsing.

Every position that starts a window of `length` bytes has a trigger: the
smallest rolling hash among the first positions of its window. Positions with
one trigger form a phrase, so that texts are cut by what they say, not by
where it stands, and equal windows have equal triggers at equal distances.

The dictionary of phrases, each with the bytes its windows reach to, is made
by counting: a phrase found twice is repeated as a whole, however many copies
there are, and one whose text after the trigger is found once cannot be. What
is left are phrases that agree in part, at the ends of repeated passages. They
are put in order twice: the parse, by the text from the trigger on, and the
dictionary, by the text before it read backwards. Neighbours in the two
suffix arrays share prefixes as long as their common prefix, which gives the
classes of equal windows for each distance from the trigger. A trigger text
with very many phrases is not ordered in one task; its windows are counted by
fingerprint instead.

Only one copy of each phrase enters the orders, so highly repetitive text
costs as much as its distinct part.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.sources.scratch import settle

from .texts import batch_of, rows_of, texts_of

_GRAM = 16
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15
#: Phrases that share a trigger text beyond this are counted by window, not ordered; phrases ordered at once.
_BUCKET, _AT_ONCE = 4096, 8192

_ROWS = pa.schema([("core", pa.int64()), ("reach", pa.int64()), ("uid", pa.int64()), ("loc", pa.int64())])
_CONTEXTS = pa.schema([("core", pa.int64()), ("uid", pa.int64()), ("loc", pa.int64()), ("single", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())])
_FOUND = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class Parser:
    """Cuts texts into phrases; holds powers for fingerprints of any stretch of a text."""

    def __init__(self, length: int):
        self.length = length
        self.reach = min(length * 4 // 5, length - _GRAM + 1)  # positions among which a trigger is chosen, inside the window
        self.codes = _mix(np.arange(1, 257, dtype=_U) * _U(_FACTOR))
        self.size = 0
        self._powers(1 << 16)

    def _powers(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, 2 * self.size)
            back = pow(_FACTOR, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, _U), np.cumprod(np.full(self.size, f, _U))]) for f in (_FACTOR, back))

    def stretches(self, raw: bytes):
        """Function from starts and ends to 64-bit fingerprints."""
        b = np.frombuffer(raw, np.uint8)
        self._powers(len(b))
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum(self.codes[b] * self.up[:len(b)], out=sums[1:])
        return lambda start, end: _mix((sums[end] - sums[start]) * self.down[start])

    def phrases(self, raw: bytes):
        """(start of the first window, trigger, start of the last window, fingerprints) of each phrase, or None for a short text."""
        n = len(raw)
        if n < self.length:
            return None
        of = self.stretches(raw)
        at = np.arange(n - _GRAM + 1, dtype=np.int64)
        low = of(at, at + _GRAM) >> _U(32) << _U(32) | at.astype(_U)
        done = 1
        while done < self.reach:  # smallest of the next `done` positions, the leftmost of equals
            step = min(done, self.reach - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        trigger = (low[:n - self.length + 1] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        return first, trigger[first], np.append(first[1:], len(trigger)) - 1, of

    def rows(self, raw: bytes):
        """(core, reach, loc) of each phrase.

        core: the text from the trigger on that all windows of a phrase with
        this trigger hold; reach: all their text, with the trigger's place in
        it; loc: first window, trigger and last window in one number.
        """
        found = self.phrases(raw)
        if found is None:
            return None
        first, trigger, last, of = found
        before, width = trigger - first, last - first
        core = of(trigger, trigger + self.length - self.reach + 1)
        reach = _mix(of(first, last + self.length) ^ (before << 8 | width).astype(_U))
        return core.view(np.int64), reach.view(np.int64), first << 16 | before << 8 | width


def _place(loc: np.ndarray):
    return loc >> 16, loc >> 8 & 255, loc & 255


def _uid(doc_id: int | None, raw: bytes) -> int:
    """Names a row by its id and text; rows that repeat both are copies of each other and may share it."""
    x = xxh64_intdigest(raw, (doc_id or 0) & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def phrase_rows(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        parser = Parser(length)
        for batch in batches:
            made = []
            for doc_id, text in rows_of(batch):
                raw = text.encode()
                own = parser.rows(raw)
                if own is not None:
                    made.append((*own[:2], np.full(len(own[2]), _uid(doc_id, raw)), own[2]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*made)], schema=_ROWS)

    return texts.mapInArrow(run, "core long, reach long, uid long, loc long")


def _packed(texts: DataFrame) -> DataFrame:
    """(uid, doc_id, packed): texts compressed, for the shuffles that bring them to their phrases."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = [(i, t.encode()) for i, t in rows_of(batch)]
            yield batch_of(schema, [(_uid(i, raw), i, pack(raw)) for i, raw in rows])

    return texts.mapInArrow(run, "uid long, doc_id long, packed binary")


def _contexts(batches, length: int):
    """The bytes that the windows of each wanted phrase reach to."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for uid, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("uid", "packed", "wanted"))):
            raw = unpack(packed)
            for w in wanted:
                first, _, width = _place(w["loc"])
                rows.append((w["core"], uid, w["loc"], w["single"], w["large"], raw[first:first + width + length]))
        yield batch_of(_CONTEXTS, rows)


def _order(bucket: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of a byte matrix within buckets, and each row's common prefix with the one before it (-1 at a bucket's first)."""
    order = np.lexsort((np.ascontiguousarray(texts).view(f"S{texts.shape[1]}").ravel(), bucket))
    apart = texts[order[1:]] != texts[order[:-1]]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), texts.shape[1])
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeated_windows(bucket: np.ndarray, loc: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, window within it) of every window that another phrase of the same bucket has too."""
    first, before, width = _place(loc)
    # Bytes count from 1, so that 0 ends a text; no byte of UTF-8 is above 244.
    right = np.zeros((len(loc), length), np.uint8)
    left = np.zeros((len(loc), max(int(before.max(initial=0)), 1)), np.uint8)
    for i, (text, d) in enumerate(zip(contexts, before.tolist())):
        own = np.frombuffer(text, np.uint8) + np.uint8(1)
        after = own[d:d + length]
        right[i, :len(after)] = after
        left[i, :d] = own[:d][::-1]
    parse, parse_common = _order(bucket, right)
    words, words_common = _order(bucket, left)
    out_phrase, out_window = [], []
    a, b = np.empty(len(loc), np.int64), np.empty(len(loc), np.int64)
    for d in range(int((before - width).min(initial=0)), int(before.max(initial=0)) + 1):
        here = np.flatnonzero((before >= d) & (before - width <= d))
        if len(here) < 2:
            continue
        a[parse] = np.cumsum(parse_common < length - d)
        b[words] = np.cumsum(words_common < d)
        _, same, many = np.unique(a[here] << 32 | b[here], return_inverse=True, return_counts=True)
        twice = here[many[same] > 1]
        out_phrase.append(twice)
        out_window.append(before[twice] - d)
    if not out_phrase:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_phrase), np.concatenate(out_window)


def _ordered(batches, length: int):
    """(uid, start, stop) of repeated windows among phrases that come sorted by core."""
    held: list[tuple] = []

    def solve(rows: list[tuple]):
        core, uid, loc, single, text = zip(*rows)
        loc, uid = np.array(loc), np.array(uid)
        bucket = np.unique(np.array(core), return_inverse=True)[1]
        phrase, window = repeated_windows(bucket, loc, list(text), length)
        wanted = np.array(single)[phrase]  # the others are repeated anyway
        phrase, window = phrase[wanted], window[wanted]
        order = np.lexsort((window, phrase))
        phrase, window = phrase[order], window[order]
        new = np.flatnonzero((np.diff(phrase, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
        last = np.append(new[1:], len(phrase)) - 1 if len(new) else new
        start = loc[phrase[new]] >> 16
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid[phrase[new]], start + window[new], start + window[last])], schema=_FOUND)

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("core", "uid", "loc", "single", "bytes")))
        if len(held) >= _AT_ONCE:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield solve(held[:cut])
                held = held[cut:]
    if held:
        yield solve(held)


def _window_rows(batches, length: int):
    """One row per window of phrases in large buckets: 128 bits of fingerprint, its place, and whether it is asked about."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("uid", pa.int64()), ("at", pa.int64()), ("single", pa.bool_())])
    for batch in batches:
        rows = []
        for uid, loc, single, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "loc", "single", "bytes"))):
            for k in range((loc & 255) + 1):
                own = hashlib.blake2b(text[k:k + length], digest_size=16).digest()
                rows.append((int.from_bytes(own[:8], "little", signed=True), int.from_bytes(own[8:], "little", signed=True), uid, (loc >> 16) + k, single))
        yield batch_of(schema, rows)


def _removed(batches, length: int):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc_id, packed, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "starts", "stops"))):
            raw = unpack(packed)
            spans: list[list[int]] = []
            for start, stop in sorted(zip(starts or [], stops or [])):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop + length)
                else:
                    spans.append([start, stop + length])
            kept, at = hashlib.sha256(), 0
            for start, stop in spans:
                kept.update(raw[at:start])
                at = stop
            kept.update(raw[at:])
            rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        yield batch_of(_RESULT, rows)


def _release(df: DataFrame) -> None:
    """Let Spark's cleaner take the shuffle files of finished steps, which would else stay until the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, length: int = 200, bucket: int = _BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Removed is each byte that lies in a stretch of `length` bytes which also
    starts elsewhere, in the same or another document; overlaps count, and
    stretches are judged on the input. Null and empty texts have no bytes, a
    null id stays null, rows that repeat are copies of each other, an empty
    table gives no rows, other columns are not read. `length` is from 40 to
    300.
    """
    if not 40 <= length <= 300:
        raise ValueError("length must be from 40 to 300")
    texts = texts_of(docs, id_col, text_col)
    rows = settle(phrase_rows(texts, length), "phrases")
    # Counts are written before they are joined, so that a frequent core is split among tasks by the join.
    again = settle(rows.groupBy("core").count().where("count > 1").select("core"), "again")
    shared = settle(rows.join(again, "core", "left_semi"), "shared")
    _release(docs)
    dictionary = settle(shared.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(F.struct("uid", "loc")).alias("one")), "dictionary")
    _release(docs)

    # Phrases found twice are repeated as a whole.
    first, width = F.shiftright("loc", 16), F.col("loc").bitwiseAND(F.lit(255))
    whole = shared.join(dictionary.where("n > 1").select("core", "reach"), ["core", "reach"]).select("uid", first.alias("start"), (first + width).alias("stop"))

    # Where one trigger text has several phrases, those found once may be repeated in part.
    mixed = settle(dictionary.groupBy("core").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 AND least = 1"), "mixed")
    asked = dictionary.join(mixed, "core").select(
        F.col("one.uid").alias("uid"), F.struct("core", F.col("one.loc").alias("loc"), (F.col("n") == 1).alias("single"), (F.col("many") > bucket).alias("large")).alias("w"))
    asked = asked.groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    packed = _packed(texts)
    # Rows with the same id and text are one text, whose stretches are looked at once.
    contexts = settle(packed.join(asked, "uid").select("uid", "packed", "wanted").dropDuplicates(["uid"]).mapInArrow(
        lambda b: _contexts(b, length), "core long, uid long, loc long, single boolean, large boolean, bytes binary"), "contexts")
    _release(docs)
    ordered = contexts.where("NOT large").drop("large").repartition("core").sortWithinPartitions("core").mapInArrow(
        lambda b: _ordered(b, length), "uid long, start long, stop long")
    windows = contexts.where("large").mapInArrow(lambda b: _window_rows(b, length), "w1 long, w2 long, uid long, at long, single boolean")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    counted = windows.where("single").join(twice, ["w1", "w2"]).select("uid", F.col("at").alias("start"), F.col("at").alias("stop"))

    spans = whole.union(ordered).union(counted).groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    found = settle(spans.select("uid", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops")), "found")
    _release(docs)
    return packed.join(found, "uid", "left").select("doc_id", "packed", "starts", "stops").mapInArrow(
        lambda b: _removed(b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
