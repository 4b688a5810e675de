"""Equality joins in which null matches null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, kind
from ..functions.ordered import same

_JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def matched(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str) -> DataFrame:
    """Null-safe equi-join of two tables without common column names.

    Adaptive execution splits the partitions of hot keys in inner and one-sided
    joins by what was shuffled, with nothing counted beforehand.  It cannot
    split a full join, so that is a left join and the right rows without a
    partner.
    """
    on = same([col(k) for k in left_on], [col(k) for k in right_on])
    if how != "full":
        return left.join(right, on, how)
    alone = right.join(left.select(*[col(k) for k in left_on]), on, "left_anti")
    return left.join(right, on, "left").unionByName(alone, allowMissingColumns=True)


def merge(left: DataFrame, right: DataFrame, left_key: str | list[str], right_key: str | list[str],
          join_type: str = "inner", suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Join on one or more key pairs; null keys match each other.

    Keys of the same name become one column, other common names get a suffix.
    """
    left_on = [left_key] if isinstance(left_key, str) else list(left_key)
    right_on = [right_key] if isinstance(right_key, str) else list(right_key)
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("matching left and right keys are required")
    if join_type not in _JOIN_TYPES:
        raise ValueError(f"invalid join type: {join_type}")
    for side, keys in ((left, left_on), (right, right_on)):
        if missing := [k for k in keys if k not in side.columns]:
            raise ValueError(f"key columns not found: {missing}")
    for l, r in zip(left_on, right_on):
        if kind(left.schema[l].dataType) != kind(right.schema[r].dataType):
            raise ValueError(f"cannot join {l!r} with {r!r}: their types differ")
    how = _JOIN_TYPES[join_type]
    shared = [l for l, r in zip(left_on, right_on) if l == r]
    both = (set(left.columns) & set(right.columns)) - set(shared)

    l = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    r = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    l_at = {c: f"l{i}" for i, c in enumerate(left.columns)}
    r_at = {c: f"r{i}" for i, c in enumerate(right.columns)}
    joined = matched(l, r, [l_at[k] for k in left_on], [r_at[k] for k in right_on], how)
    out = []
    for c in left.columns:
        if c in shared:
            key = {"right": F.col(r_at[c]), "full": F.coalesce(F.col(l_at[c]), F.col(r_at[c]))}.get(how, F.col(l_at[c]))
            out.append(key.alias(c))
        else:
            out.append(F.col(l_at[c]).alias(c + suffixes[0] if c in both else c))
    for c in right.columns:
        if c not in shared:
            out.append(F.col(r_at[c]).alias(c + suffixes[1] if c in both else c))
    return joined.select(*out)
