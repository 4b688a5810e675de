"""Bounds and methods that hold whatever repeats: samples, grammars, parts of credentials, the agenda's ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import secrets, sentencepieces, texts, token_files


def test_sample_has_a_row_per_id_and_no_more_than_asked(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(40) for k in range(300 if i == 0 else 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = texts.labelled_sample(docs, labels, 100, 1000).collect()
    want = {i for i in range(40) if i not in (4, 5) and zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(r.doc_id for r in got) == sorted(want) and all(r.quality == r.doc_id % 2 for r in got)
    few = texts.labelled_sample(docs, labels, 2, 1000).collect()
    assert sorted(r.quality for r in few) == [0, 0, 1, 1]


def test_grammar_goes_on_until_no_pair_is_left():
    phrase = np.arange(1, 200, dtype=np.uint32)
    made = token_files.build_grammar(np.tile(phrase, 64), np.array([199 * 64]), 8, 4096)
    symbols = made["symbols"]
    pairs = np.stack([symbols[:-1], symbols[1:]], 1)
    assert not len(pairs) or np.unique(pairs, axis=0, return_counts=True)[1].max() < 8
    assert len(symbols) < 16


@pytest.mark.parametrize("text", ["https://example.com/a/r/commit/" + "0123456789abcdef" * 2 + "01234567", "AKIA0BCD1234", "see https://example.com and " + "0af1" * 10])
def test_a_part_does_not_complete_itself(text):
    assert not [k for k, _, _ in secrets.find_spans(text) if k not in ("assign", "access", "hex")]


def test_ids_are_those_of_the_agenda(monkeypatch):
    own = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    whole = own.encode_batch(["some plain words", ""])
    monkeypatch.setattr(sentencepieces.PieceEncoder, "merge", lambda self, text: [5])
    other = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids, replaced = other.encode_batch(["some plain words", ""])
    assert ids == whole[0] and whole[1] == [0, 0] and replaced == [3, 0]  # the check puts each word right, and says so


def test_rules_are_learnt_from_every_row(spark):
    """Leaf counts are those of all learnable rows, and the threshold is the exact one."""
    from millrace.llm import quality_rules as rules

    docs = spark.createDataFrame([(i, "plain words " * (30 + i % 50) + ("# ! " * (i % 40) if i % 10 == 0 else "") + "x" * (60_000 if i == 1 else 1)) for i in range(9000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 <> 0) AS quality")
    stats = rules.learnable_statistics(docs, labels)
    learnable = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert stats.count() == len(learnable) > 6000 and stats.where("word_chars > 50000").count() == 1
    forest = rules.fit_forest(docs, labels, trees=5, depth_limit=4)
    table = stats.toPandas()
    x, good = rules.features(table[list(rules.COUNTS + rules._MORE)].to_numpy()), table.quality.to_numpy() == 1
    assert forest.usual == rules._usual(int(good.sum()))
    for tree in range(5):
        feature, left, depth = forest.feature[tree], forest.left[tree], {0: 0}
        for node in range(len(feature)):
            if feature[node] >= 0:
                depth[left[node]] = depth[left[node] + 1] = depth[node] + 1
        held = np.bincount(forest.leaves(tree, x[good]), minlength=len(feature))
        assert all(forest.length[tree][i] == depth[i] + rules._usual(int(held[i])) for i in depth if feature[i] < 0)
    scores = forest.score(x)
    ranked = np.sort(scores[good])[::-1]
    floor = ranked[int(good.sum() * 0.005)]
    assert forest.threshold == (scores[~good & (scores > floor)].min() + floor) / 2 + 1e-9
