"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on,
with the columns of `documents`; the last one gives packed pieces. `run`
writes each stage's rows as Parquet in the shared folder and reads them again
for the next, so that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import drop_copies
from millrace.llm.near_texts import near_texts
from millrace.llm.packing import pack
from millrace.llm.quality_classifier import fit_classifier, quality_score
from millrace.llm.secrets import mask_secrets
from millrace.sources.scratch import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good.

    Null and empty texts have a score like any other, long texts are read
    whole, repeated rows are judged alike, and an empty table stays empty.
    """
    classifier = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(classifier)("text") >= 0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id.

    Null counts as empty; of rows with the same id and text one stays; a text
    of any length is told by its digest; an empty table stays empty.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Near duplicates share 0.8 or more of their five-word shingles (exact
    Jaccard of the sets) and are proposed by SimHash. Rows that share an id
    stay or go together; a null id stays where nothing with an id is like it.
    Texts without words are one group; of equal texts one row stays. Long
    texts are compared whole, and an empty table stays empty.
    """
    found = near_texts(docs, shingle=5, similarity=0.8)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays._id), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew.

    A null text becomes an empty one; long texts are read whole; repeated rows
    all stay; an empty table stays empty.
    """
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is its end token alone, a long one is cut into
    pieces, each repeated row has pieces of its own; no rows give no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: SQL has no tokenizer, dictionary compression or fingerprint of shingles.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
