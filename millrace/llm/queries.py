"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import scratch_path

from .cap_filters import near_vectors
from .conversation_repair import damage_and_repair
from .exact_dedup import exact_dedup
from .merkle import manifest
from .packing import pack
from .quality_classifier import fit_classifier, score_quality
from .quality_rules import apply_rules, fit_forest
from .secrets import scan_secrets, secret_report
from .sentencepieces import round_trip
from .simhash import hex_fingerprint, near_duplicates
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .token_files import document_table, write_tokens

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@query("op1_sentencepiece")
def op1(spark, sf):
    return round_trip(_documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_best_fit_packing")
def op2(spark, sf):
    return pack(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query("op3_quality_classifier")
def op3(spark, sf):
    docs = _documents(spark, sf)
    return score_quality(docs, fit_classifier(docs, _labels(spark, sf)))


@query("op4_quality_rules")
def op4(spark, sf):
    docs = _documents(spark, sf)
    return apply_rules(docs, fit_forest(docs, _labels(spark, sf)))


@query("op5_simhash")
def op5(spark, sf):
    found = near_duplicates(_documents(spark, sf), shingle=3, radius=3)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_secret_scan")
def op6(spark, sf):
    return secret_report(scan_secrets(_documents(spark, sf)))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op7(spark, sf):
    return exact_dedup(_documents(spark, sf))


@query("op8_token_counts")
def op8(spark, sf):
    return count_tokens(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


@query("op9_token_files")
def op9(spark, sf):
    return document_table(write_tokens(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"), end_id=1))


@query("op10_substring_dedup")
def op10(spark, sf):
    return remove_repeats(_documents(spark, sf), length=200)


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query("op11_merkle_manifest", f"""
    WITH RECURSIVE leaf AS (
        SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n_chars='n_chars')} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format(n_chars='(n_chars + 1)')} END AS tampered FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
    node(tree, level, pos, n, h) AS (
        SELECT tree, 0, pos, n, leaf FROM placed
        UNION ALL SELECT tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 2),
    sub AS (SELECT tree, h AS subroot FROM node WHERE n = 1),
    subplaced AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sub),
    top(level, pos, n, h) AS (
        SELECT 0, pos, n, subroot FROM subplaced
        UNION ALL SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2),
    folded(tree, row, level, pos, n, h, proof) AS (
        SELECT tree, pos, 0, pos, n, coalesce(tampered, leaf), '' FROM placed
        UNION ALL SELECT f.tree, f.row, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                         sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
        FROM folded f LEFT JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
    over(tree, row, level, pos, n, h, proof) AS (
        SELECT f.tree, f.row, 0, s.pos, s.n, f.h, f.proof FROM folded f JOIN subplaced s ON s.tree = f.tree WHERE f.n = 1
        UNION ALL SELECT f.tree, f.row, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                         sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
        FROM over f LEFT JOIN top s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
    SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
    FROM placed p JOIN over o ON o.tree = p.tree AND o.row = p.pos AND o.n = 1 JOIN sub s ON s.tree = p.tree CROSS JOIN (SELECT h FROM top WHERE n = 1) t""")
def op11(spark, sf):
    return manifest(_documents(spark, sf))


@query("op13_cap_filter_dedup", """
    WITH RECURSIVE v AS (
        SELECT row_number() OVER () AS row, vec_id, label, embedding::double[] AS e,
               label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND coalesce(isfinite(x), false)))
               AND list_bool_or(list_transform(embedding, lambda x: coalesce(x <> 0, false))) AS usable FROM embeddings),
    pair AS (SELECT a.row AS a, b.row AS b, b.vec_id AS b_id FROM v a JOIN v b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
             WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(row, other) AS (SELECT row, row FROM v UNION SELECT r.row, p.b FROM reach r JOIN pair p ON p.a = r.other),
    least AS (SELECT r.row, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.row = r.other GROUP BY 1),
    linked AS (SELECT a AS row, count(*) AS n FROM pair GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM v JOIN least USING (row) LEFT JOIN linked USING (row)""")
def op13(spark, sf):
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op12_conversation_repair")
def op12(spark, sf):
    return damage_and_repair(spark.read.parquet(f"{sf}/conversations.parquet"))
