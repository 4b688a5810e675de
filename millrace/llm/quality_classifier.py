"""Quality classifier by compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts
labelled bad. A text resembles the side whose dictionary makes it smaller: the
difference of the two compressed sizes over their sum, with the compressed
size per byte beside it, goes through a logistic curve that is fitted on rows
the dictionaries were not trained on.

A dictionary helps at the start of what is compressed, so texts are compressed
in pieces of `piece` bytes, each by itself; every piece of every text counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import held_out, labelled_sample, texts_of


@dataclass
class CompressionClassifier:
    """What the fit leaves: two dictionaries, and the weights of the curve (none of it grows with the corpus)."""

    good: bytes
    bad: bytes
    weights: list[float]
    level: int
    piece: int

    def sizes(self):
        """Function from a text to (bytes, size beside the good dictionary, size beside the bad one)."""
        def packer(raw: bytes):
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            data.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        good, bad, piece = packer(self.good), packer(self.bad), self.piece

        def measure(text: str) -> tuple[int, int, int]:
            raw = text.encode()
            parts = [raw[i:i + piece] for i in range(0, len(raw), piece)]
            return len(raw), sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)

        return measure

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = _terms(sizes) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _terms(sizes: np.ndarray) -> np.ndarray:
    """Columns of the curve; an empty text has only the constant."""
    raw, good, bad = sizes.reshape(-1, 3).astype(float).T
    difference = (bad - good) / np.maximum(good + bad, 1)
    density = np.where(raw > 0, (good + bad) / 2 / np.maximum(raw, 1), 0.0)
    return np.column_stack([np.ones(len(raw)), 10 * difference, 5 * density, 20 * difference * density])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str], size: int, piece: int) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    parts = [raw[i:i + piece] for raw in (t.encode() for t in texts) for i in range(0, len(raw), piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[:size] or b"        "


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, max_chars: int = 50_000, dictionary_bytes: int = 65_536,
                   level: int = 3, piece: int = 1024) -> CompressionClassifier:
    """Trained on at most `sample_rows` learnable rows of each label, half for the dictionaries and half for the curve.

    Equal texts stay in one half. The sample has as many rows of each label as
    it can; the curve's constant is moved to the labels' true shares, which
    are counted over all learnable rows. Without rows of both labels every text gets
    the share of label 1 (0.5 without any label).
    """
    rows = sorted(((r.doc_id, r.text, r.quality) for r in labelled_sample(docs, labels, sample_rows, max_chars).collect()), key=lambda r: r[0])
    first = [r for r in rows if zlib.crc32(r[1].encode()) % 2 == 0]
    second = [r for r in rows if zlib.crc32(r[1].encode()) % 2 == 1] or first
    sides = [[t for _, t, q in first if q == side] for side in (1, 0)]
    made = CompressionClassifier(*(_dictionary(s, dictionary_bytes, piece) for s in sides), [0.0, 0.0, 0.0, 0.0], level, piece)
    truth = np.array([q for _, _, q in second], dtype=float)
    if all(sides) and 0 < truth.sum() < len(truth):
        measure = made.sizes()
        made.weights = _logistic(_terms(np.array([measure(t) for _, t, _ in second])), truth).tolist()
        learnable = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)) & F.col("quality").isin(0, 1))
        shares = {int(r.quality): r["count"] for r in learnable.groupBy("quality").count().collect()}
        made.weights[0] += float(np.log(shares[1] / shares[0]) - np.log(truth.sum() / (len(truth) - truth.sum())))
    elif rows:
        share = min(max(sum(r[2] for r in rows) / len(rows), 1e-6), 1 - 1e-6)
        made.weights[0] = float(np.log(share / (1 - share)))
    return made


def score_quality(docs: DataFrame, classifier: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, without a shuffle.

    Null texts count as empty and get the curve's constant; a null id is not
    held out; repeated rows are scored each; an empty table gives no rows;
    other columns are not read.
    """
    made = texts_of(docs, id_col, text_col).withColumn("score", quality_score(classifier)("text"))
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def quality_score(classifier: CompressionClassifier):
    """A column function from text to score, which compresses Arrow batches."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        measure = classifier.sizes()
        sizes = [measure(t.as_py() or "") for t in texts]
        return pa.array(classifier.score(np.array(sizes)) if sizes else [], pa.float64())

    return score
