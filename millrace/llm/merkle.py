"""A manifest of a dataset: a Merkle tree over its rows with a witness for each row.

Leaves are appended to a tree in order. Subtrees that wait for a sibling stay
open and hold partial witnesses of their leaves; when the sibling is complete
both are joined and each side's witnesses are extended by the other's root.
Leaves that share a subtree share what it is extended by, so that an append
costs the same however many leaves are open. Aligned blocks of 1,024 leaves
are grown by separate tasks; their roots are appended to further blocks in the
same way, until each tree has one root.
"""

from __future__ import annotations

import hashlib
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle

from .numbering import numbered

#: Levels of a block of 1,024 leaves; trees up to which a table of them is broadcast.
LEVELS, _FEW = 10, 100_000

_BLOCK = "tree string, block long, n long, root string, sides array<string>"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels over n nodes."""
    return (n - 1).bit_length()


class Witnesses:
    """A tree that grows by appending nodes and keeps the witness of each.

    `open` holds complete subtrees that wait for a sibling, the largest first:
    (height, root, sides). sides[h] is a list with the sibling of each node of
    height h in the subtree, in order: the partial witness of node i is
    sides[0][i], sides[1][i >> 1] and so on.
    """

    def __init__(self):
        self.open: list[tuple[int, str, list[list[str]]]] = []

    @staticmethod
    def _joined(left, right):
        height, a, sides = left
        _, b, others = right
        for own, more in zip(sides, others):
            own += more
        sides.append([b, a])
        return height + 1, digest(a + b), sides

    def append(self, node: str) -> None:
        new = (0, node, [])
        while self.open and self.open[-1][0] == new[0]:
            new = self._joined(self.open.pop(), new)
        self.open.append(new)

    def close(self) -> tuple[str, list[list[str]]]:
        """The root and the sides; a last node without a sibling is hashed alone, and has no entry at that height."""
        new = self.open.pop()
        while self.open:
            if self.open[-1][0] == new[0]:
                new = self._joined(self.open.pop(), new)
            else:
                new = (new[0] + 1, digest(new[1]), [*new[2], []])
        return new[1], new[2]


def raised(root: str, n: int, levels: int) -> str:
    """The root of n nodes that stands `levels` above them, as the last of its tree."""
    for _ in range(levels - depth(n)):
        root = digest(root)
    return root


def witness(sides: list[str], i: int) -> str:
    """The siblings of node i, lowest first; `sides` has one string of digests for each height."""
    found = (s[64 * (i >> h):64 * (i >> h) + 64] for h, s in enumerate(sides))
    return "".join(found)


def fold(node: str, i: int, n: int, siblings: str) -> str:
    """The root of a tree of n nodes that node i and its siblings give."""
    at = 0
    while n > 1:
        if i ^ 1 < n:
            other, at = siblings[at:at + 64], at + 64
            node = digest(other + node if i & 1 else node + other)
        else:
            node = digest(node)
        i, n = i >> 1, (n + 1) >> 1
    return node


def _grown(batches, payload: list[tuple[str, pa.DataType]], levels: int):
    """Block rows of nodes that come sorted by tree and place; a block is never in two tasks."""
    key, tree, rows = None, Witnesses(), [[] for _ in payload]

    def row():
        n = len(rows[0]) if payload else count
        root, sides = tree.close()
        columns = [pa.array([x], t) for x, t in ((key[0], pa.string()), (key[1], pa.int64()), (n, pa.int64()), (root, pa.string()), (["".join(s) for s in sides], pa.list_(pa.string())))]
        columns += [pa.array([v], pa.list_(t)) for v, (_, t) in zip(rows, payload)]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "block", "n", "root", "sides", *[p for p, _ in payload]])

    count = 0
    for batch in batches:
        get = {c: batch.column(c).to_pylist() for c in ("tree", "pos", "digest", *[p for p, _ in payload])}
        for i, (name, pos, node) in enumerate(zip(get["tree"], get["pos"], get["digest"])):
            if key != (name, pos >> levels):
                if key is not None:
                    yield row()
                key, tree, rows, count = (name, pos >> levels), Witnesses(), [[] for _ in payload], 0
            tree.append(node)
            count += 1
            for own, (p, _) in zip(rows, payload):
                own.append(get[p][i])
    if key is not None:
        yield row()


def blocks(nodes: DataFrame, levels: int, payload: list[tuple[str, str, pa.DataType]] = ()) -> DataFrame:
    """(tree, block, n, root, sides, ...) of nodes (tree, pos, digest, ...): a row for each aligned block, with lists of the payload columns."""
    kept = [(p, t) for p, _, t in payload]
    laid = nodes.withColumn("_block", F.shiftright("pos", levels)).repartition("tree", "_block").sortWithinPartitions("tree", "pos").drop("_block")
    made = laid.mapInArrow(lambda b: _grown(b, kept, levels), ", ".join([_BLOCK, *[f"{p} array<{sql}>" for p, sql, _ in payload]]))
    return settle(made, "blocks")


def _appended(batches, levels: int):
    """Roots of blocks as nodes of the next ones."""
    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "n", "root")]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([raised(r[3], r[2], levels) for r in rows], pa.string())], names=["tree", "pos", "digest"])


def _siblings(batches, levels: int):
    """The siblings of each node of a block within it."""
    for batch in batches:
        for tree, block, n, sides in zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "n", "sides")]):
            first = block << levels
            yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
                                              pa.array([witness(sides, i) for i in range(n)], pa.string())], names=["tree", "block", "above"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcasting if the table is known to have few rows."""
    return F.broadcast(df) if rows <= _FEW else df


def roots(lowest: DataFrame, totals: DataFrame, trees: int, largest: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(tree, root) of each tree and (tree, block, above), the siblings of each lowest block up to the root.

    `totals` has (tree, total), the nodes of each tree, `trees` rows; the
    largest has `largest` nodes. There is one round for each factor of 1,024.
    """
    spark, grown, done = lowest.sparkSession, [lowest], []
    for k in range(1, max(1, ceil(depth(largest) / levels)) + 1):
        more = grown[-1].select("tree", "block", "n", "root").join(small(totals, trees), "tree")
        done.append(more.where(F.col("total") <= 1 << levels * k).select("tree", "root"))
        if largest <= 1 << levels * k:
            break
        more = more.where(F.col("total") > 1 << levels * k).select("tree", "block", "n", "root")
        grown.append(blocks(more.mapInArrow(lambda b: _appended(b, levels), "tree string, pos long, digest string"), levels))
    above = spark.createDataFrame([], "tree string, block long, above string")
    for level in reversed(grown[1:]):
        own = level.select("tree", "block", "n", "sides").mapInArrow(lambda b: _siblings(b, levels), "tree string, block long, above string")
        higher = above.select("tree", F.col("block").alias("_up"), F.col("above").alias("_more"))
        own = own.withColumn("_up", F.shiftright("block", levels)).join(higher, ["tree", "_up"], "left")
        above = settle(own.select("tree", "block", F.concat("above", F.coalesce("_more", F.lit(""))).alias("above")), "above")
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return settle(found, "roots"), above


def _proved(batches, levels: int):
    """Document rows of blocks that know the siblings above them."""
    names = ("block", "doc_id", "digest", "tampered", "sides", "above", "total", "place", "trees", "top", "subroot", "all_root")
    for batch in batches:
        for r in range(batch.num_rows):
            block, ids, leaves, tampered, sides, above, total, place, trees, top, subroot, root = (batch.column(c)[r].as_py() for c in names)
            proofs, folded = [], []
            for i, leaf in enumerate(leaves):
                own = witness(sides, i) + above
                proofs.append(digest(own + top))
                at = fold(tampered[i] or leaf, (block << levels) + i, total, own)
                folded.append(fold(at, place, trees, top))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(leaves, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()),
            ], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def framed(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_table(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, digest, tampered): the leaf of each row, and where `tampered` holds that of the row with n_chars one larger."""
    number = F.col("n_chars").cast("decimal(20,0)")
    leaf = lambda n: F.sha2(F.concat(*[framed(c) for c in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n, F.col("text"))]), 256)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(number).alias("digest"), F.when(tampered & number.isNotNull(), leaf(number + 1)).alias("tampered"))


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of `docs` (doc_id, source, lang, n_chars, text).

    A tree for each lang has its rows by doc_id; the roots of these trees, by
    lang, are the leaves of the last one. Rows where `tampered` holds are
    proved with n_chars one larger, by default where 7 divides the crc32 of
    the id; they fail to verify. Nulls: each field may be null and is hashed
    as `-`; null ids come first and null langs are a tree of their own, the
    first. An empty text is hashed like any other, a text of any length by
    Spark's own function. Rows with the same id are ordered by their leaf;
    equal rows have places of their own, and equal leaves. An empty table
    gives no rows. Other columns are not read.

    A lang of any size is spread over tasks, in blocks of 2 to the power of
    `levels` rows, which do not change the result. A table of lang roots is broadcast
    while there are at most 100,000 of them.
    """
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0, F.lit(False))
    leaves = settle(leaf_table(docs, tampered), "leaves")
    nodes = numbered(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    lowest = blocks(nodes, levels, [("doc_id", "long", pa.int64()), ("digest", "string", pa.string()), ("tampered", "string", pa.string())])
    totals = settle(lowest.groupBy("tree").agg(F.sum("n").alias("total")), "totals")
    trees, largest = totals.agg(F.count("*"), F.max("total")).first()
    if not trees:
        return docs.sparkSession.createDataFrame([], _PROOF)
    subroots, above = roots(lowest, totals, trees, largest, levels)

    # The roots by lang are the leaves of one more tree.
    tops = numbered(subroots.select(F.lit("").alias("one"), "tree", F.col("root").alias("digest")), "one", [F.col("tree")])
    tops = settle(tops, "tops")
    last = blocks(tops.select(F.col("one").alias("tree"), "pos", "digest"), levels)
    one = docs.sparkSession.createDataFrame([("", trees)], "tree string, total long")
    whole, over = roots(last, one, 1, trees, levels)
    root = whole.first()["root"]
    own = last.select("tree", "block", "n", "sides").mapInArrow(lambda b: _siblings(b, levels), "tree string, block long, above string")
    own = own.select(F.col("block").alias("place"), F.shiftright("block", levels).alias("_up"), F.col("above").alias("_own"))
    own = own.join(over.select(F.col("block").alias("_up"), F.col("above").alias("_more")), "_up", "left")
    own = own.select("place", F.concat("_own", F.coalesce("_more", F.lit(""))).alias("top"))
    known = tops.select("tree", F.col("pos").alias("place"), F.col("digest").alias("subroot")).join(own, "place").join(totals, "tree")
    known = settle(known.withColumns({"trees": F.lit(trees), "all_root": F.lit(root)}), "known")

    # What stands above a block is joined to light rows first, then to the blocks, which are all of bounded size.
    light = lowest.select("tree", "block").join(above, ["tree", "block"], "left").join(small(known, trees), "tree")
    light = light.withColumn("above", F.coalesce("above", F.lit("")))
    return lowest.join(light, ["tree", "block"]).mapInArrow(lambda b: _proved(b, levels), _PROOF)
