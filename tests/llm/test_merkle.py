"""Roots, proofs and verdicts against a tree that is built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.merkle import Witnesses, fold, manifest, witness
from millrace.llm.numbering import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    fields = (doc_id, source, lang, None if n is None else n + more, text)
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves):
    """All levels, and the path of each leaf: (sibling, whether it is on the left) or None."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        paths.append([(lv[(i >> h) ^ 1], bool((i >> h) & 1)) if (i >> h) ^ 1 < len(lv) else None for h, lv in enumerate(levels[:-1])])
    return levels[-1][0], paths


def climb(node, path):
    for step in path:
        node = sha(node) if step is None else sha(step[0], node) if step[1] else sha(node, step[0])
    return node


def expected(rows):
    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted([r for r in rows if r[2] == lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, *tree([leaf_of(r) for r in own]))
    root, over = tree([t[1] for t in trees.values()])
    out = []
    for (own, subroot, paths), top in zip(trees.values(), over):
        for r, path in zip(own, paths):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = climb(leaf_of(r, 1 if bad else 0), path + top)
            out.append((r[0], leaf_of(r), subroot, root, sha(*[s[0] for s in path + top if s]), folded, folded == root))
    return out


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, -i]), rng.choice(["", "text é 漢", None, "x" * 1000]), langs[0] if rng.random() < 0.6 else rng.choice(langs),
             rng.choice(["a", "", None]), rng.choice([None, 3, 0, 2**63 - 1])) for i in range(n)]
    return rows + rows[:5] + [(None, "t", langs[0], None, 1), (None, None, None, None, None), (7, "other", langs[0], "s", 2)]


@pytest.mark.parametrize("n, langs, levels", [(300, ["en", None, "é", "~", ""], 3), (40, ["l%d" % i for i in range(30)], 2), (200, ["en"], 10), (70, ["en", "de"], 1)])
def test_manifest(spark, n, langs, levels):
    rows = rows_of(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("other") for c in ("tree", "pos", "_part", "block", "digest", "total")})
    got = [tuple(r) for r in manifest(docs, levels=levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    row = manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")
    assert manifest(one.where("false")).collect() == []


@pytest.mark.parametrize("n", [*range(1, 20), 100])
def test_witnesses_of_every_size(n):
    leaves = [sha(str(i)) for i in range(n)]
    grown = Witnesses()
    for x in leaves:
        grown.append(x)
    root, sides = grown.close()
    want, paths = tree(leaves)
    assert root == want
    joined = ["".join(s) for s in sides]
    for i, path in enumerate(paths):
        own = witness(joined, i)
        assert own == "".join(s[0] for s in path if s)
        assert fold(leaves[i], i, n, own) == root
        assert fold(sha("x"), i, n, own) != root


@pytest.mark.parametrize("groups", [["a"], ["a", None, "b", "c"], ["g%d" % i for i in range(50)]])
def test_numbered(spark, groups):
    rng = random.Random(2)
    rows = [(groups[0] if rng.random() < 0.5 else rng.choice(groups), rng.randint(0, 10**6)) for _ in range(500)]
    got = [tuple(r) for r in numbered(spark.createDataFrame(rows, "g string, x long").repartition(7), "g", [F.col("x")]).collect()]
    seen, want = {}, []
    for g, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        seen[g] = seen.get(g, -1) + 1
        want.append((g, x, seen[g]))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert numbered(spark.createDataFrame([], "g string, x long"), "g", [F.col("x")]).collect() == []
