"""Best-fit packing of documents into sequences of a fixed length.

The plan is made over a histogram of lengths, not over documents: lengths are
taken from long to short, and as many pieces of a length as there are go at
once to the fullest open sequences that still have room. What comes out is a
short list of slots, each for a run of ranks within a length; pieces find
theirs by joining on length and rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import settle

from .texts import batch_of, rows_of, texts_of, tokenizer

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Ranks are counted in groups of about so many pieces of one length.
_GROUP_ROWS = 20_000


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces in each sequence, offset of the first) by best fit over counts.

    Sequences with equal room are kept as runs of numbers. Each length starts
    one run at most and cuts two, and a run takes as many different lengths as
    a sequence does, so that the plan is bounded by the capacity whatever the
    number of documents.
    """
    room: dict[int, list[list[int]]] = {}
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def put(first: int, free: int, each: int, many: int) -> None:
            nonlocal rank, left
            slots.append((length, rank, each * many, first, each, capacity - free))
            rank, left = rank + each * many, left - each * many
            if free > each * length:
                room.setdefault(free - each * length, []).append([first, many])

        for free in sorted(f for f in room if f >= length):
            runs, each = room.pop(free), free // length
            while runs and left:
                first, many = runs.pop()
                take = min(many, left // each)
                if take:
                    put(first, free, each, take)
                if take < many and left:
                    put(first + take, free, left, 1)
                    take += 1
                if take < many:
                    runs.append([first + take, many - take])
            if runs:
                room.setdefault(free, []).extend(runs)
            if not left:
                break
        each = capacity // length
        if left >= each:
            many = left // each
            put(sequences, capacity, each, many)
            sequences += many
        if left:
            put(sequences, capacity, left, 1)
            sequences += 1
    return slots


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each document and an end id, cut where they are longer than a sequence.

    All pieces but the first are as long as a sequence, so that only one per
    document is left to fit. A null or empty text is its end id alone.
    """
    def run(batches):
        own, end = tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in rows_of(batch):
                ids = own.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield batch_of(_PIECES, rows)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`token_pieces` with sequence_id and offset, gapless from 0 in each sequence.

    Repeated rows are packed each, null ids stay null, an empty table gives no
    rows, other columns are not read. Tokens are made once; what is written,
    shuffled and ranked is one narrow row per piece.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, path, capacity, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counted = pieces.groupBy("length").count().collect()  # capacity rows at most
    groups = max(1, -(-sum(r["count"] for r in counted) // _GROUP_ROWS))
    slots = spark.createDataFrame(plan_slots({r["length"]: r["count"] for r in counted}, capacity),
                                  "length long, _first long, _ranks long, _sequence long, _each long, _offset long")

    # Rank within a length: groups of a length are numbered one after another, so that a frequent length is many tasks.
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = pieces.groupBy("length", "_group").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_group")) - F.col("count")).drop("count")
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(slots), "length").where((at >= 0) & (at < F.col("_ranks")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"))
