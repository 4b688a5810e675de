"""Statistics of whole tables, one bounded row per column.

* `measure` fuses aggregates into as few passes as generated code allows.
* `frequencies` turns columns into one (slot, value, count) table, combined on
  the map side; distinct counts, modes, top values, and the quantiles of columns
  that one task can sort are read from it.
* `order_statistics` finds the quantiles of longer columns: it narrows them down
  with a quantile sketch whose every answer is checked by counting.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, is_floating, is_nested, is_whole

ROW_LIMIT = 5_000_000  # values of one column that one task may sort
_SKETCH = 20_000  # size of a quantile sketch; its ranks are off by some 0.02 percent
_AIM = 0.0005  # share of the rows to look at on either side of a sketched rank
_PICKS = "array<struct<upto:bigint,count:bigint,value:double>>"
_FIELDS = 96  # Spark generates code for aggregates of up to a hundred buffer fields


def value(df: DataFrame, name: str) -> Column:
    """The column with not-a-number read as null."""
    return F.nanvl(col(name), F.lit(None)) if is_floating(df.schema[name].dataType) else col(name)


def measure(df: DataFrame, wanted: dict, fields: int = 4) -> dict:
    """Evaluate named aggregates of up to `fields` buffer fields each.

    Aggregates of one column should follow each other: where they do not fit
    into one pass, each pass then reads other columns.
    """
    keys, per_pass = list(wanted), max(1, _FIELDS // fields)
    out = {}
    for start in range(0, len(keys), per_pass):
        part = keys[start : start + per_pass]
        row = df.agg(*[wanted[k].alias(f"m{i}") for i, k in enumerate(part)]).first()
        out.update(zip(part, row))
    return out


def null_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    cols = df.columns if cols is None else cols
    got = measure(df, {None: F.count(F.lit(1)), **{c: F.count(value(df, c)) for c in cols}}, fields=1)
    total = got.pop(None)
    return total, {c: total - n for c, n in got.items()}


def moment_aggregates(df: DataFrame, c: str) -> dict:
    """n, extremes, mean, sample deviation and skewness of a numeric column."""
    v = value(df, c)
    d = v.cast("double")
    return {(c, "n"): F.count(v), (c, "min"): F.min(v), (c, "max"): F.max(v), (c, "mean"): F.avg(d),
            (c, "std"): F.stddev_samp(d), (c, "skew"): F.skewness(d)}


def moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    got = measure(df, {k: a for c in cols for k, a in moment_aggregates(df, c).items()}, fields=2)
    return {c: finish_moments(got, c) for c in cols}


def finish_moments(got: dict, c: str) -> dict:
    """Adds what follows from the measured values: population deviation, adjusted skewness."""
    n, std = got[c, "n"], got[c, "std"]
    return {"n": n, "min": got[c, "min"], "max": got[c, "max"], "mean": got[c, "mean"], "std": std,
            "std_pop": 0.0 if n == 1 else None if std is None else std * math.sqrt((n - 1) / n),
            "skew": adjusted_skew(got[c, "skew"], n, std)}


def adjusted_skew(g: float | None, n: int, std: float | None) -> float | None:
    """Bias-adjusted skewness from the population one; zero for a constant column."""
    if n < 3:
        return None
    if not std or g is None or math.isnan(g):
        return 0.0
    return g * math.sqrt(n * (n - 1)) / (n - 2)


def quantiles(
    df: DataFrame, cols: list[str], probs: list[float], row_limit: int = ROW_LIMIT,
    known: dict[str, int] | None = None, accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; approximate if `accuracy` is given.

    `known` gives the non-null count of each column, where it is known.
    """
    if not cols:
        return {}
    if accuracy:
        got = measure(df, {c: F.percentile_approx(value(df, c).cast("double"), list(probs), accuracy) for c in cols})
        return {c: got[c] if got[c] is not None else [None] * len(probs) for c in cols}
    n = known or measure(df, {c: F.count(value(df, c)) for c in cols}, fields=1)
    return quantiles_and_distinct(df, cols, probs, [], n, row_limit)[0]


def quantiles_and_distinct(
    df: DataFrame, cols: list[str], probs: list[float], counted: list[str], n: dict[str, int], row_limit: int = ROW_LIMIT,
) -> tuple[dict[str, list[float | None]], dict[str, int]]:
    """Exact quantiles of `cols` and distinct counts of `counted`; `n` are the non-null counts."""
    spots = {c: [p * (n[c] - 1) for p in probs] for c in cols if n[c]}
    ranks = {c: sorted({k for s in at for k in (math.floor(s), math.ceil(s))}) for c, at in spots.items()}
    short = {c: ks for c, ks in ranks.items() if n[c] <= row_limit}
    unique, found = summarize(df, list(dict.fromkeys([*short, *counted])), short)
    if long := {(c, k) for c, ks in ranks.items() if c not in short for k in ks}:
        found |= order_statistics(df, n, long, row_limit)
    return {c: interpolate(found, c, spots.get(c), len(probs)) for c in cols}, unique


def interpolate(found: dict, c: str, spots: list[float] | None, wanted: int) -> list[float | None]:
    if spots is None:
        return [None] * wanted
    out = []
    for s in spots:
        below, above = found[c, math.floor(s)], found[c, math.ceil(s)]
        out.append(below + (above - below) * (s - math.floor(s)))
    return out


def summarize(df: DataFrame, cols: list[str], ranks: dict[str, list[int]]) -> tuple[dict, dict]:
    """Distinct counts of the columns, and the k-th smallest values of those in `ranks`.

    Both come from one shuffle of (column, value) pairs; a column in `ranks` is
    then sorted by one task, so it must not be longer than that task can take.
    """
    parts = []
    plain = [c for c in cols if c not in ranks]
    for members in ([c for c in cols if c in ranks], plain):
        for slots, table in frequencies(df, members):
            picks = _ranked(table, {slot: ranks.get(c, []) for slot, c in slots.items()}) if members is not plain else table.groupBy(
                "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("picks", F.lit(None).cast(_PICKS))
            parts.append((slots, picks.withColumn("part", F.lit(len(parts)))))
    unique, found = dict.fromkeys(cols, 0), {}
    if not parts:
        return unique, found
    rows = parts[0][1]
    for _, more in parts[1:]:
        rows = rows.unionByName(more)
    for row in rows.collect():
        c = parts[row.part][0][row.slot]
        unique[c] = row.n
        found |= {(c, k): v for k, v in _at_ranks(row.picks or [], ranks.get(c, [])).items()}
    return unique, found


def _ranked(table: DataFrame, ranks: dict[str, list[int]]) -> DataFrame:
    """Per slot its number of values, and (upto, count, value) of the few that hold its ranks."""
    counted = table.withColumn("upto", F.sum("count").over(W.partitionBy("slot").orderBy("value")))
    wanted = F.lit(False)
    for slot, ks in ranks.items():
        held = F.lit(False)
        for k in ks:
            held = held | ((F.col("upto") > k) & (F.col("upto") - F.col("count") <= k))
        wanted = wanted | ((F.col("slot") == slot) & held)
    pick = F.when(wanted, F.struct("upto", "count", F.col("value").cast("double").alias("value")))
    return counted.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.collect_list(pick).alias("picks"))


def _at_ranks(picks: list, ks: list[int]) -> dict[int, float]:
    return {k: p.value for k in ks for p in picks if p.upto - p["count"] <= k < p.upto}


def _clusters(ranks: list[int], gap: float) -> list[list[int]]:
    """Ranks close to each other, to be narrowed down together."""
    out: list[list[int]] = []
    for k in sorted(ranks):
        if out and k - out[-1][-1] <= gap:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def order_statistics(
    df: DataFrame, n: dict[str, int], ranks: set[tuple[str, int]], row_limit: int = ROW_LIMIT
) -> dict[tuple[str, int], float]:
    """The k-th smallest value (from 0) of a column for each wanted (column, k).

    Every round sketches the open intervals that hold the ranks, counts on both
    sides of the sketch's answers, and keeps the part that holds each rank.  A
    round leaves about a thousandth of the rows and never loses the value,
    whatever the sketch says: the counts decide.
    """
    found: dict[tuple[str, int], float] = {}
    spans: dict[tuple, tuple[int, int, list[int]]] = {}  # (column, low, high): rows below, rows inside, ranks
    for c, k in ranks:
        spans.setdefault((c, None, None), (0, n[c], []))[2].append(k)
    df = df.select(*[value(df, c).cast("double").alias(c) for c in dict.fromkeys(c for c, _ in ranks)])

    def number(c: str) -> Column:
        return col(c)

    def inside(c: str, low: float | None, high: float | None) -> Column:
        test = number(c).isNotNull()
        if low is not None:
            test = test & (number(c) > F.lit(low))
        return test & (number(c) < F.lit(high)) if high is not None else test

    while wide := {s: v for s, v in spans.items() if v[1] > row_limit}:
        aims = {}
        for span, (below, size, ks) in wide.items():
            for cluster in _clusters(ks, _AIM * size):
                aims[span, tuple(cluster)] = (max(0.0, (cluster[0] - below) / size - _AIM),
                                              min(1.0, (cluster[-1] + 1 - below) / size + _AIM))
        sketched = measure(df, {
            span: F.kll_sketch_get_quantile_double(
                F.kll_sketch_agg_double(F.when(inside(*span), number(span[0])), _SKETCH),
                F.array(*[F.lit(x) for (s, _), pair in aims.items() if s == span for x in pair]))
            for span in wide}, fields=1)
        answers = {span: iter(sketched[span]) for span in wide}
        cuts = {key: (next(answers[key[0]]), next(answers[key[0]])) for key in aims}
        tests = {}
        for (span, cluster), pair in cuts.items():
            for name, cut in zip("ab", pair):
                within = inside(*span)
                tests[span, cluster, name, "lt"] = F.count_if(within & (number(span[0]) < F.lit(cut)))
                tests[span, cluster, name, "le"] = F.count_if(within & (number(span[0]) <= F.lit(cut)))
        counted = measure(df, tests, fields=1)
        narrowed = {s: v for s, v in spans.items() if s not in wide}
        for (span, cluster), (a, b) in cuts.items():
            (c, low, high), (below, size, _) = span, wide[span]
            lt_a, le_a, lt_b, le_b = (counted[span, cluster, e, m] for e in "ab" for m in ("lt", "le"))
            for k in cluster:
                at = k - below
                if lt_a <= at < le_a:
                    found[c, k] = a
                elif lt_b <= at < le_b:
                    found[c, k] = b
                else:
                    kept = ((c, low, a), (below, lt_a)) if at < lt_a else (
                        ((c, a, b), (below + le_a, lt_b - le_a)) if at < lt_b else ((c, b, high), (below + le_b, size - le_b)))
                    narrowed.setdefault(kept[0], (*kept[1], []))[2].append(k)
        spans = narrowed

    if spans:
        found |= _pick(df, [(span, below, ks) for span, (below, _, ks) in spans.items()], inside, number)
    return found


def _pick(df: DataFrame, spans: list, inside, number) -> dict[tuple[str, int], float]:
    """Order statistics inside intervals that hold few rows each."""
    tests = [inside(*span) for span, _, _ in spans]
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    picks = F.array(*[F.when(t, F.struct(F.lit(i).alias("t"), number(span[0]).alias("v")))
                      for i, (t, (span, _, _)) in enumerate(zip(tests, spans))])
    table = (df.filter(any_of).select(F.explode(F.array_compact(picks)).alias("p"))
             .groupBy(F.col("p.t").cast("string").alias("slot"), F.col("p.v").alias("value")).count())
    ranks = {str(i): [k - below for k in ks] for i, (_, below, ks) in enumerate(spans)}
    found = {}
    for row in _ranked(table, ranks).collect():
        span, below, _ = spans[int(row.slot)]
        found |= {(span[0], k + below): v for k, v in _at_ranks(row.picks, ranks[row.slot]).items()}
    return found


def _family(dtype: T.DataType) -> str:
    if is_whole(dtype):
        return "bigint"
    if is_floating(dtype):
        return "double"
    return "string" if is_nested(dtype) else dtype.simpleString()


def frequencies(df: DataFrame, cols: list[str]) -> list[tuple[dict[str, str], DataFrame]]:
    """Per type family: slot names, and a table (slot, value, count) of non-null values."""
    families = defaultdict(list)
    for c in cols:
        families[_family(df.schema[c].dataType)].append(c)
    out = []
    for type_name, members in families.items():
        slots = {str(i): c for i, c in enumerate(members)}
        typed = []
        for slot, c in slots.items():
            v = F.to_json(col(c)) if is_nested(df.schema[c].dataType) else value(df, c)
            typed.append(v.cast(type_name).alias(slot))
        table = (df.select(*typed).unpivot([], list(slots), "slot", "value")
                 .filter(F.col("value").isNotNull()).groupBy("slot", "value").count())
        out.append((slots, table))
    return out


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, int]:
    if approx:
        return measure(df, {c: F.approx_count_distinct(value(df, c)) for c in cols})
    return summarize(df, cols, {})[0]


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value of each column, the smallest one on a tie."""
    out = dict.fromkeys(cols)
    for slots, table in frequencies(df, cols):
        best = table.groupBy("slot").agg(F.min(F.struct((-F.col("count")).alias("c"), "value"))["value"].alias("value"))
        for row in best.collect():
            out[slots[row.slot]] = row.value
    return out
