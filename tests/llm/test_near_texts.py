"""Near duplicates against a brute-force version, with pairs on both sides of 0.8: no false links, and those that are found by similarity."""

import random

import numpy as np

import corpus_pipeline
from millrace.llm.near_texts import confirm, near_texts, shingle_hashes


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(3, 8))) for _ in range(n)]


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def pairs():
    """Isolated pairs by scattered and block edits, some in a common passage."""
    rng = random.Random(11)
    passage, rows = words_of(rng, 40), []
    for i in range(360):
        n = (60, 200, 600)[i % 3]
        base = words_of(rng, n) + passage * (i % 4 == 0)
        other, edits = list(base), rng.randint(1, max(n // 18, 2)) if i % 2 else rng.randint(1, n // 4)
        at = rng.sample(range(n), edits) if i % 2 else range(rng.randint(0, n - edits), n)[:edits]
        for k in at:
            other[k] = words_of(rng, 1)[0]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other).upper())]
    return rows


def groups(rows):
    """The smallest id of each row's component over all pairs of rows."""
    sets, label = [shingles(t or "") for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and alike(sets[a], sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {g: min((i for (i, _), x in zip(rows, label) if x == g and i is not None), default=None) for g in set(label)}
    return [least[g] for g in label]


def check(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda t: tuple((x is not None, x) for x in t)
    got = sorted((tuple(r) for r in near_texts(docs, **settings).collect()), key=key)
    assert got == sorted([(i, g) for (i, _), g in zip(rows, groups(rows))], key=key)


def test_pairs_on_both_sides_of_the_threshold(spark):
    """At the default radius nothing false is linked and pairs are found by band; at a radius of all bits none is missed."""
    rows = pairs()
    sets = [shingles(t) for _, t in rows]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 100 < sum(x >= 0.8 for x in like) < 260
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(tuple(r) for r in near_texts(docs).collect())
    linked = [got[r[0]] != r[0] for r in rows[1::2]]
    for low, high, least in ((0, 0.8, None), (0.8, 0.85, 0.8), (0.85, 0.9, 0.9), (0.9, 1.01, 0.97)):
        band = [hit for hit, x in zip(linked, like) if low <= x < high]
        print(low, high, len(band), sum(band) / max(len(band), 1))
        assert sum(band) == 0 if least is None else sum(band) >= least * len(band)
    assert all(x >= 0.8 for x, hit in zip(like, linked) if hit)
    near = [hit for hit, x in zip(linked, like) if x >= 0.8]
    assert sum(near) >= 0.9 * len(near)
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {i for i, g in got.items() if i == g}


def test_a_group_whose_members_differ_from_one_another(spark):
    rng = random.Random(12)
    base, rows = words_of(rng, 120), []
    for i in range(250):
        own = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            own[k] = words_of(rng, 1)[0]
        rows.append((i, " ".join(own)))
    check(spark, rows)
    check(spark, rows, chunk=4000)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (None, " \n"), (7, "one two"), (6, "One  Two"), (None, "one two three"), (8, "a b c d e"), (8, "a b c d e"), (9, "a b c d f"),
            (1, "x " * 3000), (None, "X " * 50), (3, "é 漢字 é é é é"), (None, "nothing is like this text here")]
    check(spark, rows)
    assert near_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_confirmed_links_against_all_pairs():
    rng = random.Random(4)
    bases = [words_of(rng, 60) for _ in range(4)]
    sets = []
    for _ in range(60):
        own = list(rng.choice(bases))
        for k in rng.sample(range(60), rng.randint(0, 5)):
            own[k] = words_of(rng, 1)[0]
        sets.append(np.unique(shingle_hashes([w.encode() for w in own], 5)))
    sets += [np.zeros(0, np.uint64)] * 2
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both, whole = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
            if both >= 0.8 * whole:
                label = [label[a] if x == label[b] else x for x in label]
    got = list(range(len(sets)))
    for a, b in zip(*confirm(range(len(sets)), [0] * len(sets), sets, 0.8, 64)):
        got = [got[a] if x == got[b] else x for x in got]
    assert [[x == y for y in label] for x in label] == [[x == y for y in got] for x in got]
