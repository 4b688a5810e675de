"""Repairs against all edits that there are, and against a table of suffixes for long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.conversation_repair import ENDS, INSERTS, damage_and_repair, edits, lightest

RIGHT = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, found):
    """(cost, audit) and the turns, by the cheapest way on from each row and pattern state, over whole strings."""
    def move(state, initial):
        if state in ("", "a") and initial == "u":
            return "u"
        if state == "" and initial == "s":
            return "s"
        if state == "s" and initial == "u":
            return "u"
        return "a" if state == "u" and initial == "a" else None

    memo = {}
    for i in range(len(rows), -1, -1):
        for _ in range(3):  # inserts lead from state to state at the same place
            for state in ("", "s", "u", "a"):
                options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
                for role in ("user", "assistant"):
                    to = move(state, role[0])
                    if to and (i, to) in memo:
                        c, a, t = memo[i, to]
                        options.append((2 + c, "I" + a, ((role, ""), *t)))
                if i < len(rows):
                    _, _, role, text = rows[i]
                    c, a, t = memo[i + 1, state]
                    options.append((3 + c, "D" + a, t))
                    if found[i] not in ("b", "d"):
                        for given, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                            to = move(state, given[:1])
                            if to:
                                c, a, t = memo[i + 1, to]
                                options.append((cost + (found[i] == "t") + c, letter + a, ((given, text), *t)))
                if options:
                    memo[i, state] = min(options)
    return memo[0, ""]


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(damaged([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        cost, audit, turns = best(own, found) if own else (0, "", ())
        assert RIGHT.fullmatch("".join(r[0] for r, _ in turns))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest))
    return out


def rows_of(sizes, seed):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else "user" if turn % 2 == 0 else "assistant"
            text = rng.choice(["Yes.", "no", " \n", None, "Why?", "Why? \x85", "wörd 漢!\n", "x" * 3000 + "."]) if rng.random() < 0.3 else f"turn {rng.randint(0, 10**6)}."
            rows.append((None if conv == 3 else conv * 7, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, text))
    return rows + rows[:3]


@pytest.mark.parametrize("sizes, length, seed", [([1, 2, 3, 4, 5, 6, 8] * 12, 512, 1), ([1, 5, 9, 60, 6, 40, 3, 12], 3, 2), ([200, 30], 16, 3)])
def test_repairs(spark, sizes, length, seed):
    rows = rows_of(sizes, seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.withColumns({c: F.lit("other") for c in ("conv", "pos", "seg", "audit", "kind", "fault")})
    got = [tuple(r) for r in damage_and_repair(df, length).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_no_rows_and_rows_that_all_go(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in damage_and_repair(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert damage_and_repair(df.where("false")).collect() == []
    far = spark.createDataFrame([(gone, -2**63, "user", "Hi."), (gone, 2**63 - 1, "user", "Oh.")], "conv_id long, turn long, role string, text string")
    assert damage_and_repair(far).first().gaps == 2**63 - 1


def test_lightest_against_all_edits():
    """Every string of edits of short conversations, with up to two inserts at each place."""
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("uasx"), rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]
        every = []
        for chosen in itertools.product("KRD", repeat=len(rows)):
            for free in itertools.product(range(3), repeat=len(rows) + 1):
                audit = "".join("I" * n + e for n, e in zip(free, (*chosen, "")))
                cost = sum({"I": 2, "K": 0, "R": 2, "D": 3}[x] for x in audit)
                if any(f in (1, 2) and e != "D" for (_, f), e in zip(rows, chosen)):
                    continue
                cost += sum(f == 3 and e != "D" for (_, f), e in zip(rows, chosen))
                # A letter that may become anything matches either of u and a.
                left = [a if e == "K" else "?" for n, (a, _), e in zip(free, [*rows, ("", 0)], (*chosen, "")) for a, e in [("", "I")] * n + ([(a, e)] if e not in ("", "D") else [])]
                n = len(left)
                for shape in [x for x in ("ua" * (n // 2), "s" + "ua" * (n // 2)) if len(x) == n and x != "s"]:
                    if all(a == b or a == "?" and b in "ua" for a, b in zip(left, shape)):
                        every.append((cost, audit))
        got = lightest({0: (0, "")}, [edits(a, f) for a, f in rows], INSERTS, ENDS)
        assert list(got.values()) == [min(every)], rows
