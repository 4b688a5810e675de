"""Repair of conversation structure by lightest derivations.

A conversation is right when the initials of its roles are `(s?(ua)+)?`. Rows
can be kept, given another role, deleted, and empty turns can be inserted. An
item says in which state of that pattern a conversation may be after its first
i rows; deductions combine it with an edit of the next row, or with an insert,
to a further item. Items are popped from an agenda in the order of their
weight (cost, rows, audit), the audit being the edits' initials. No deduction
gives less than what it is drawn from, so that an item is final when it is
popped, and the agenda stops at the goal item.

Conversations are cut into segments of bounded length. A segment derives its
lightest way from each state to each other; these ways are in turn the
premises of deductions over the whole conversation.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle

from .numbering import numbered

#: States: at the start, after s, after u, after ua. States that may end a conversation.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Roles that an edit may give, by the state it is made in, and the state it leads to.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SEGMENT = 512
_SPACES = " \t\n\x0b\f\r"

_PARTS = "conv string, seg long, n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, ways array<struct<p:int,q:int,cost:long,audit:string>>"
_WAY = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_KNOWN = "conv string, pos long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def edits(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letter) of the edits of a row."""
    made = [(p, p, 3, "D") for p in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = fault == TRUNCATED
        made += [(p, NEXT[p][initial], 0 + more, "K") for p in range(4) if initial in NEXT[p]]
        made += [(p, q, 2 + more, "R") for p, (_, q) in enumerate(GIVEN)]
    return made


INSERTS = [(p, q, 2, "I") for p, (_, q) in enumerate(GIVEN)]


def lightest(seeds: dict[int, tuple[int, str]], steps: list[list[tuple[int, int, int, str]]], inserts: list[tuple[int, int, int, str]],
             goal: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each state after all steps, or with a goal that of the first goal state to be final.

    Seeds are the states before the first step, a step's premises lead from
    state to state. Of two derivations of one item with the same cost neither
    audit begins with the other, since a longer one has inserts that cost
    more; so adding to an audit keeps their order, and weights only grow.
    """
    by_state = [[[e for e in step if e[0] == p] for p in range(4)] for step in steps]
    free = [[e for e in inserts if e[0] == p] for p in range(4)]
    agenda = [(cost, 0, audit, state) for state, (cost, audit) in seeds.items()]
    heapq.heapify(agenda)
    final, ended = set(), {}
    while agenda:
        cost, at, audit, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(steps):
            if goal is None:
                ended[state] = (cost, audit)
            elif state in goal:
                return {state: (cost, audit)}
        else:
            for _, q, more, letters in by_state[at][state]:
                if (at + 1, q) not in final:
                    heapq.heappush(agenda, (cost + more, at + 1, audit + letters, q))
        for _, q, more, letters in free[state]:
            if (at, q) not in final:
                heapq.heappush(agenda, (cost + more, at, audit + letters, q))
    return ended


def _segments(batches, length: int):
    """A row for each segment; rows come sorted by conversation and place, a segment is never in two tasks."""
    key, rows = None, []

    def row():
        initials, faults, turns = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows if r[2] is not None]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        steps = [edits(a, f) for a, f in zip(initials, faults)]
        ways = []
        for p in range(4) if key[1] else (0,):
            # A segment that is not full is the last one: only what ends the conversation counts.
            found = lightest({p: (0, "")}, steps, INSERTS, None if len(rows) == length else ENDS)
            ways += [{"p": p, "q": q, "cost": c, "audit": a} for q, (c, a) in found.items()]
        distinct = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)
        values = (*key, len(rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), pairs, initials[0], initials[-1],
                  turns[0] if turns else None, turns[-1] if turns else None, distinct, ways)
        types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3, _WAY]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in re.split(r", (?=\w+ )", _PARTS)])

    for batch in batches:
        get = {c: batch.column(c).to_pylist() for c in ("conv", "pos", "initial", "fault", "turn")}
        for conv, pos, *own in zip(*get.values()):
            if key != (conv, pos // length):
                if key is not None:
                    yield row()
                key, rows = (conv, pos // length), []
            rows.append(own)
    if key is not None:
        yield row()


def _conversations(batches, length: int):
    """Of each conversation its numbers and its audit (pos is null), and the audit of each segment beside the place of its first row."""
    names = [x.split()[0] for x in _KNOWN.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6]
    key, state, total, first, last, before = None, {}, [0] * 5, None, None, ""

    def rows():
        # The goal is reached from the states that may end a conversation.
        cost, audit = min(v for q, v in state.items() if q in ENDS)
        gaps = min(2**63 - 1, last - first + 1 - total[4]) if first is not None else 0
        pieces = re.findall(r"(?:I*[DKR]){1,%d}" % length, audit)
        pieces[-1] += audit[sum(map(len, pieces)):]
        made = [(key, None, audit, gaps, *total[:4], cost)] + [(key, i * length, p, *[None] * 6) for i, p in enumerate(pieces)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), types)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != key:
                if key is not None:
                    yield rows()
                key, state, total, first, last, before = r["conv"], {0: (0, "")}, [0] * 5, None, None, ""
            state = lightest(state, [[(w["p"], w["q"], w["cost"], w["audit"]) for w in r["ways"]]], [])
            joint = bool(before is not None and r["seg"] and before + r["first_initial"] not in ("su", "ua", "au"))
            again = last is not None and last == r["first_turn"]
            for i, v in enumerate((r["blank"], r["duplicate"], r["truncated"], r["illegal"] + joint, r["turns"] - again)):
                total[i] += v
            before = r["last_initial"]
            first = r["first_turn"] if first is None else first
            last = r["last_turn"] if r["last_turn"] is not None else last
    if key is not None:
        yield rows()


def _repaired(batches):
    """The digest of each repaired conversation, read row by row in order; its edits come before the rows they are for."""
    key, audit, at, state, digest, some = None, "", 0, 0, None, False

    def turn(role, text):
        nonlocal some
        digest.update((("\n" if some else "") + role + ":" + text).encode())
        some = True

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = GIVEN[state]
            turn(role, "")
            at += 1

    for batch in batches:
        ended = []
        for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
            if conv != key:
                if key is not None:
                    inserts()
                    ended.append((key, digest.hexdigest()))
                key, audit, at, state, digest, some = conv, "", 0, 0, hashlib.sha256(), False
            if not kind:
                audit, at = text, 0
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                turn(role, text)
                state = NEXT[state][role[0]]
            elif edit == "R":
                given, state = GIVEN[state]
                turn(given, text)
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ended], pa.string()), pa.array([e[1] for e in ended], pa.string())], names=["conv", "repaired_sha256"])
    if key is not None:
        inserts()
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text); conv names a conversation, the empty string those without an id, and missing words are a blank."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = lambda c: F.col(c).cast("long")
    return conversations.select(F.coalesce(number("conv_id").cast("string"), F.lit("")).alias("conv"), number("conv_id").alias("conv_id"),
                                number("turn").alias("turn"), word("role").alias("role"), word("text").alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text) with a part of the rows dropped, emptied, cut of stops, repeated or given another role, by the crc32 of their place."""
    rows = _rows(conversations)
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_how", F.crc32(place) % 20).where("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv", "conv_id", "turn", "role", "text", F.explode(F.expr("CASE WHEN _how = 3 THEN array(1, 2) ELSE array(1) END"))).drop("col")


def repair(rows: DataFrame, length: int = _SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in rows (conv, turn, role, text).

    Rows are taken by turn, nulls first; those of one turn by role and text.
    """
    placed = numbered(rows.select("conv", "turn", "role", "text"), "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    placed = settle(placed, "placed")
    said = F.rtrim("text", F.lit(_SPACES))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    lines = settle(placed.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), same.alias("same"), (F.length(said) == 0).alias("empty"),
                                 F.right(said, F.lit(1)).isin(".", "!", "?").alias("stopped")), "lines")
    # The first row of each kind is found by counting; it is joined by its place, of which there is one.
    firsts = lines.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("new"))
    fault = F.when(F.col("empty"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("stopped"), TRUNCATED).otherwise(0)
    lines = lines.join(firsts, ["conv", "pos"], "left").select("conv", "pos", "initial", "turn", fault.alias("fault"), F.expr(f"pos div {length}").alias("seg"))
    parts = lines.repartition("conv", "seg").sortWithinPartitions("conv", "pos").mapInArrow(lambda b: _segments(b, length), _PARTS)
    known = settle(parts.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(lambda b: _conversations(b, length), _KNOWN), "known")
    texts = placed.select("conv", "pos", F.lit(1).alias("kind"), "role", "text")
    texts = texts.union(known.where("pos is not null").select("conv", "pos", F.lit(0), F.lit(""), "audit"))
    made = texts.repartition("conv").sortWithinPartitions("conv", "pos", "kind").mapInArrow(_repaired, "conv string, repaired_sha256 string")
    return known.where("pos is null").drop("pos").join(made, "conv")


def damage_and_repair(conversations: DataFrame, length: int = _SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of (conv_id, turn, role, text).

    Nulls: a missing id is a conversation of its own, a missing turn comes
    first and is no gap, a missing role or text is one blank. Empty texts are
    blank rows, texts of any length are read whole and one at a time. Rows of
    the same turn are taken by role and text; repeated rows are duplicates. A
    conversation that loses all rows has zeros, an empty audit and the digest
    of nothing; gaps beyond 2**63 - 1 are that number. An empty table gives no
    rows, other columns are not read.

    A conversation of any length is placed, judged and derived by segments of
    `length` rows, which do not change the result. Its audit is one value, and
    its digest needs its texts in order, so one task reads them as a stream,
    holding a batch of rows and four audits.
    """
    every = _rows(conversations).select("conv", "conv_id").distinct()
    found = every.join(repair(damage(conversations), length), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
