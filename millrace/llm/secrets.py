"""Secrets in texts, and parts of credentials that only count together.

Three kinds are reported wherever they stand (the base). Weaker ones are
reported only where the parts that complete them are near: an access
identifier too short for the base, an assigned value too short for it, and an
endpoint say little alone, but two different parts of one credential within a
scope do. Scopes are joined as intervals: parts are sorted by place, and a
part looks up by bisection how far the parts of each other role reach that
start before its scope ends, so that a text with many parts costs n log n and
no pairs are made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import batch_of, rows_of, texts_of

#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
_ROLES = {"assign": "secret", "access": "identifier", "hex": "digits", "weak_access": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
#: What completes a weak part of a role. Bare hexadecimal digits may be any checksum, so they complete identifiers only.
_PARTNERS = {"identifier": ("secret", "endpoint", "digits"), "secret": ("identifier", "endpoint"), "endpoint": ("identifier", "secret")}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are maximal, so asking for the length at once finds the same spans as dropping short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_WEAK_ACCESS = re.compile(r"AKIA[A-Z0-9]{4,13}(?![A-Z0-9])")
_ENDPOINT = re.compile(r"(?:https?|s3|postgres|mysql|redis|amqp)://[A-Za-z0-9.@:/_?=&%-]+")

_SPANS = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _parts(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans and weak ones, as (start, kind's place in KINDS, end)."""
    base, weak = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)], []
    low = text.encode().lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 12:
                base.append((m.start(), 0, m.end()))
            elif size >= 6 and any(c.isdigit() for c in m[2]):
                weak.append((m.start(), 4, m.end()))
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        weak += [(m.start(), 3, m.end()) for m in _WEAK_ACCESS.finditer(text)]
    if "://" in text:
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return base, weak


def find_spans(text: str, scope: int = 200) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    A weak part counts if a part of another role stands at most `scope` code
    points away, from the end of the one to the start of the other, and the two
    do not overlap: any two of identifier, secret and endpoint complete each
    other, bare hexadecimal digits an identifier alone.
    """
    base, weak = _parts(text)
    if weak:
        starts: dict[str, list[int]] = {}
        ends: dict[str, list[int]] = {}
        for start, kind, end in sorted(base + weak):
            starts.setdefault(_ROLES[KINDS[kind]], []).append(start)
            ends.setdefault(_ROLES[KINDS[kind]], []).append(end)
        for role in ends.values():
            role.sort()

        def completed(start: int, kind: int, end: int) -> bool:
            for role in _PARTNERS[_ROLES[KINDS[kind]]]:
                ahead, behind = ends.get(role, ()), starts.get(role, ())
                before, after = bisect_right(ahead, start), bisect_left(behind, end)
                if before and ahead[before - 1] >= start - scope or after < len(behind) and behind[after] <= end + scope:
                    return True
            return False

        base = base + [p for p in weak if completed(*p)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(base)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>) for every document, without a shuffle.

    Null and empty texts have no spans, repeated rows are answered each, an
    empty table gives no rows, other columns are not read.
    """
    def run(batches):
        for batch in batches:
            yield batch_of(_SPANS, [(i, [dict(zip(("kind", "start", "end"), s)) for s in find_spans(t, scope)]) for i, t in rows_of(batch)])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind: string, start: int, end: int>>")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from `scan_secrets`."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def mask(text: str, scope: int = 200) -> str:
    """The text with each found span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in find_spans(text, scope):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", scope: int = 200) -> DataFrame:
    """The same rows and columns with secrets masked in `text_col`; null texts stay null."""
    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else mask(t, scope) for x in texts), pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col)))
