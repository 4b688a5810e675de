"""Near duplicates that SimHash proposes and whole shingle sets confirm.

Texts with the same set of word shingles are one node. Nodes whose two-word
fingerprints are within a radius, and whose fingerprints over the shingles
themselves are within a looser one, are linked by the generalised pigeonhole
of `simhash`; components of these links are the candidates. Inside a component
nodes are compared by the exact Jaccard similarity of their sets, of which one
is read for each node; large components are dealt into cells in which any two
chunks meet. Links below the limit go, and components are formed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.sources.scratch import settle

from .components import components
from .simhash import link_nodes
from .texts import texts_of

#: Rows of a batch that are looked at together; shingles of a chunk of a large component; nodes up to which their texts' hashes are broadcast.
_SLICE, _CHUNK, _FEW = 256, 500_000, 1_000_000
_PRINTS = "doc_id long, mark long, fp long, fp2 long, key binary, n int"
_PRINT_FIELDS = [("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("key", pa.binary()), ("n", pa.int32())]


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, in order; fewer words are one run, none have none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, at, ends = b" ".join(words), -1, []
    for w in words:
        at += len(w) + 1
        ends.append(at)
    size = min(size, len(words))
    starts = [0, *[e + 1 for e in ends]]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:])), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """SimHash as a signed number: a bit is 1 if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only few texts are Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, _SLICE):
            yield batch.slice(i, _SLICE)


def _prints(batches, shingle: int, seed: int):
    for batch in slices(batches):
        rows = []
        for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
            words = text.encode().lower().split()
            hashes = shingle_hashes(words, shingle)
            own = np.unique(hashes)
            rows.append((doc_id, mark, majority(shingle_hashes(words, 2, seed)), majority(hashes), blake2b(own.tobytes(), digest_size=16).digest(), len(own)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_PRINT_FIELDS)], names=[f for f, _ in _PRINT_FIELDS])


def _sets(batches, shingle: int):
    for batch in slices(batches):
        sets = [np.unique(shingle_hashes(t.encode().lower().split(), shingle)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])


def _confirmed(batches, similarity: float, far: int):
    """Links that join all nodes of a cell that confirmed links join; rows come sorted by root and cell."""
    key, held = None, []

    def links():
        a, b = confirm(*zip(*held), similarity, far)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in slices(batches):
        for root, cell, node, fp, shingles in zip(*(batch.column(c).to_pylist() for c in ("root", "cell", "node", "fp", "shingles"))):
            if key != (root, cell):
                if len(held) > 1:
                    yield links()
                key, held = (root, cell), []
            held.append((node, fp, np.frombuffer(shingles, np.uint64)))
    if len(held) > 1:
        yield links()


def confirm(nodes, prints, sets, similarity: float, far: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the nodes over pairs of sufficient Jaccard similarity.

    From a node of a group those left are compared with its set; those that
    are alike join the group and are gone through in turn. So a group of n
    nodes that are all alike costs n comparisons. Fingerprints more than `far`
    apart are taken for different.
    """
    prints, size = np.array(prints, np.int64).view(np.uint64), np.array([len(s) for s in sets])
    left, a, b = np.arange(len(nodes)), [], []
    todo: list[int] = []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        p = todo.pop()
        small, large = np.minimum(size[left], size[p]), np.maximum(size[left], size[p])
        maybe = left[(small >= similarity * large - 1e-6) & (np.bitwise_count(prints[left] ^ prints[p]) <= far)]
        if not len(maybe):
            continue
        if not size[p]:
            like = maybe
        else:
            every = np.concatenate([sets[i] for i in maybe])
            at = np.minimum(np.searchsorted(sets[p], every), size[p] - 1)
            owner = np.repeat(np.arange(len(maybe)), size[maybe])
            both = np.bincount(owner[sets[p][at] == every], minlength=len(maybe))
            like = maybe[both >= similarity * (size[maybe] + size[p] - both) - 1e-6]
        a += [nodes[p]] * len(like)
        b += [nodes[i] for i in like]
        todo += like.tolist()
        left = np.setdiff1d(left, like, assume_unique=True)
    return a, b


def near_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 11, loose: int = 18,
               id_col: str = "doc_id", text_col: str = "text", chunk: int = _CHUNK) -> DataFrame:
    """(doc_id, component_id) of every document; component_id is the smallest id reachable over links, itself included.

    Documents link when the sets of their `shingle`-word shingles, A-Z
    lower-cased, have a Jaccard similarity of `similarity` or more and SimHash
    proposes them: two-word fingerprints within `radius` bits and fingerprints
    over the shingles within `loose`, or both of them linked to others so. No
    link is false; some pairs are missed, more of them close to the limit.

    Null and empty texts have no shingles and are all alike; a shorter text
    is one shingle. A null id is passed over by the minimum; repeated rows are
    answered each; an empty table gives no rows; other columns are not read. A
    text is whole in its task, one slice of 256 texts at a time.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    prints = settle(texts.mapInArrow(lambda b: _prints(b, shingle, 43), _PRINTS), "prints")
    nodes = prints.groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("fp", "fp2", "mark")).alias("p"), F.first("n").alias("n"))
    nodes = settle(nodes.select("key", "first", "p.*", "n").withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = settle(link_nodes(nodes.select("node", "fp", "fp2"), radius, loose), "links")
    proposed = components(links)
    members = settle(proposed.join(nodes, "node").select("root", "node", "key", "fp", "mark", "n"), "members")

    marks = members.select("mark").distinct()
    known = members.count()
    wanted = texts.join(F.broadcast(marks) if known <= _FEW else marks, "mark", "left_semi")
    sets = wanted.select("text").mapInArrow(lambda b: _sets(b, shingle), "key binary, shingles binary").dropDuplicates(["key"])
    large = members.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > 2 * chunk)
    large = settle(large.select("root", F.ceil(F.col("total") / chunk).alias("many")), "large")
    heavy = large.count()
    rows = members.join(F.broadcast(large) if heavy <= _FEW else large, "root", "left")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("many")))
    # Cells of two chunks x < y are numbered x * many + y; chunks of their own need none.
    cells = F.expr("CASE WHEN many > 1 THEN transform(filter(sequence(0L, many - 1), o -> o <> _own), o -> least(o, _own) * many + greatest(o, _own)) ELSE array(0L) END")
    rows = rows.join(sets, "key").select("root", "node", "fp", "shingles", F.explode(cells).alias("cell"))
    found = rows.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(lambda b: _confirmed(b, similarity, radius + 8), "a long, b long")

    roots = components(found)
    reached = roots.join(nodes.select("node", "first"), "node")
    least = reached.groupBy("root").agg(F.min("first").alias("least"))
    linked = reached.join(least, "root").select("node", "least")
    classes = nodes.join(linked, "node", "left").select("key", F.coalesce("least", "first").alias("component_id"))
    return prints.join(classes, "key").select("doc_id", "component_id")
