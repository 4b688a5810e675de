"""Token counts of whole texts by a two-tier lookup on the map side.

Counting needs no ids, only how many each word has. The lengths of the most
frequent words are looked up in a small table that every task gets by
broadcast; all other words are encoded in the worker and remembered there.
The table comes from a sketch that is filled where the rows are: sketches are
shuffled, words never are. It only decides which tier answers; any table gives
the same counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import encoder
from .texts import Recent, batch_of, rows_of, texts_of, tokenizer

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
#: Longest word, in bytes, that the broadcast table takes: with `frequent` words it stays under frequent * (this + 1) bytes.
_LONGEST = 64


def frequent_words(docs: DataFrame, most: int = 20_000, tracked: int = 65_536, text_col: str = "text") -> list[str]:
    """About the `most` most frequent words between blanks and line ends of all texts.

    Each task keeps a frequent-items sketch of `tracked` words for its part;
    the sketches of a 256th of the tasks are merged, and the `most` items of
    each of these 256 are added up, so that what is shuffled beyond sketches
    has 256 * `most` rows however large the table is.
    """
    words = docs.select(F.explode(F.split(F.translate(F.col(text_col), "\n", " "), " ")).alias("word"), (F.spark_partition_id() % 256).alias("part"))
    words = words.where((F.col("word") != "") & (F.octet_length("word") <= _LONGEST))
    tops = words.groupBy("part").agg(F.expr(f"approx_top_k(word, {most}, {tracked})").alias("top")).select(F.explode("top").alias("e"))
    found = tops.groupBy("e.item").agg(F.sum("e.count").alias("n")).orderBy(F.desc("n"), "item").limit(most)
    return [r["item"] for r in found.collect() if r["item"] is not None]


class Lengths(dict):
    """First tier; what it does not hold is asked of the second."""

    def __init__(self, table: dict[str, int], second: Recent):
        super().__init__(table)
        self.second = second

    def __missing__(self, word: str) -> int:
        return self.second[word]


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 2048, frequent: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, without added special tokens.

    `path` names a vocabulary of the tokenizers library, or a sentencepiece
    model (.model). Where words cannot be counted by themselves, texts are
    encoded as a whole. Null texts count as empty, null ids stay null,
    repeated rows are counted each, an empty table gives no rows, other
    columns are not read. Nothing but sketches is shuffled.
    """
    texts = texts_of(docs, id_col, text_col)
    words = not path.endswith(".model") and bool(tokenizer(path).suffix)
    table = None
    if words:
        top = frequent_words(texts, frequent)
        lengths = [len(tokenizer(path).words[w]) // 4 for w in top]
        table = docs.sparkSession.sparkContext.broadcast(("\n".join(top), lengths))

    def run(batches):
        if path.endswith(".model"):
            own = encoder(path)
            many = lambda ts: [len(b) // 4 - 2 for b in own.encode_batch(ts)[0]]
        elif words:
            own = tokenizer(path)
            joined, lengths = table.value
            first = dict(zip(joined.split("\n"), lengths)) if lengths else {}
            find = Lengths(first | {"": 0}, Recent(lambda w: len(own.word_ids(w)) // 4)).__getitem__
            many = lambda ts: [sum(map(find, t.replace("\n", " ").split(" "))) for t in ts]
        else:
            own = tokenizer(path)
            many = lambda ts: [len(own.encode(t)) // 4 for t in ts]
        for batch in batches:
            ids, ts = zip(*rows_of(batch)) if batch.num_rows else ((), ())
            yield batch_of(_COUNTS, [(i, len(t.encode()), n) for i, t, n in zip(ids, ts, many(list(ts)))])

    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
