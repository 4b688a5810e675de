"""Statistics that follow arriving rows: a mergeable state per column and arrival, from which steps are fitted anew without reading old rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, is_nested, is_whole, kind, numeric_columns, present
from ..functions.stats import value
from ..operators.fill import UNKNOWN
from ..plans.steps import STEPS, apply_step, describe_step, fit_step
from .incremental import on_stream, split_at_state

#: Of quantile sketches the parameter that sets their error (about 0.4 % of the ranks), and the values that a list of frequent ones tracks.
_K, _ITEMS = 800, 10_000


def column_states(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, low, high, mean, m2, ranks, items) of each column, from one scan.

    Counts, extremes and moments are exact; `ranks` is a quantile sketch of
    numbers, `items` a list of frequent values as text.
    """
    made, parts = [], []
    for i, f in enumerate(df.schema):
        v = value(df, f.name)
        number = v.cast("double") if kind(f.dataType) == NUMERIC else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_nested(f.dataType) else v.cast("string")
        cells = {"rows": F.count(F.lit(1)), "nulls": F.count_if(v.isNull()), "low": F.min(number), "high": F.max(number), "mean": F.avg(number),
                 "m2": F.var_pop(number) * F.count(number), "ranks": F.kll_sketch_agg_double(number, F.lit(_K)),
                 "items": F.call_function("approx_top_k_accumulate", text, F.lit(_ITEMS))}
        made += [c.alias(f"{n}{i}") for n, c in cells.items()]
        parts.append(F.struct(F.lit(f.name).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in cells]))
    return df.agg(*made).select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def add_states(df: DataFrame, store: str, arrival: int) -> None:
    """Keep the states of an arrival; one that is retried replaces its own."""
    column_states(df).write.mode("overwrite").parquet(f"{store}/arrival={arrival}")


def merged_states(spark: SparkSession, store: str) -> DataFrame:
    """The states of all arrivals as one, a row per column; only the store is read."""
    parts = spark.read.parquet(store).withColumn("n", (F.col("rows") - F.col("nulls")).cast("double"))
    every = W.partitionBy("column")
    mean = F.sum(F.col("n") * F.col("mean")).over(every) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(every), F.lit(0.0))
    parts = parts.withColumn("all_mean", mean)
    return parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("all_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2).alias("m2"), F.kll_merge_agg_double("ranks").alias("ranks"),
        F.call_function("approx_top_k_combine", "items", F.lit(_ITEMS)).alias("items"))


def described(states: DataFrame) -> DataFrame:
    """(column, rows, nulls, low, high, mean, std, median, mode) of merged states; the median and the mode are as good as their sketches."""
    n = F.col("rows") - F.col("nulls")
    some = F.col("mean").isNotNull()
    # Of the frequent values those found most often, and of these the smallest, numbers as numbers.
    held = states.withColumn("found", F.expr("filter(approx_top_k_estimate(items, 1000), x -> x.item IS NOT NULL)"))
    held = held.withColumn("n_mode", F.expr("array_max(transform(found, x -> x.count))"))
    ties = F.expr("array_min(transform(filter(found, x -> x.count = n_mode), x -> struct(try_cast(x.item AS double) AS number, x.item AS item))).item")
    return held.select(
        "column", "rows", "nulls", "low", "high", "mean", F.when(some & (n > 1), F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5))).alias("median"), ties.alias("mode"))


@dataclass(frozen=True)
class Known:
    """What is known of a column behind some steps: a stored state, nulls that became a value, and a scale."""

    rows: int
    nulls: int
    low: float | None
    high: float | None
    mean: float | None
    m2: float
    ranks: bytes | None
    mode: str | None
    filled: float | None = None
    mass: int = 0
    offset: float = 0.0
    width: float = 1.0

    def filled_with(self, v) -> Known:
        if not self.nulls:
            return self
        if self.mean is None or not isinstance(v, (int, float)):
            return replace(self, nulls=0)
        v, n, w = float(v), self.rows - self.nulls, self.nulls
        mean = (n * self.mean + w * v) / (n + w)
        return replace(self, nulls=0, low=min(self.low, v), high=max(self.high, v), mean=mean, m2=self.m2 + n * (self.mean - mean) ** 2 + w * (v - mean) ** 2,
                       filled=v, mass=w)

    def scaled(self, offset: float, width: float) -> Known:
        move = lambda x: None if x is None else (x - offset) / width
        return replace(self, low=move(self.low), high=move(self.high), mean=move(self.mean), m2=self.m2 / width ** 2,
                       offset=self.offset + offset * self.width, width=self.width * width, filled=self.filled)

    @property
    def std(self) -> float | None:
        n = self.rows - self.nulls
        return math.sqrt(self.m2 / (n - 1)) if self.mean is not None and n > 1 else None


def quantiles_of(spark: SparkSession, known: dict[str, Known], ranks: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of columns from their sketches; values that replaced nulls weigh in at their place."""
    able = [c for c, k in known.items() if k.mean is not None]
    if not able:
        return {c: [None] * len(ranks) for c in known}
    held = spark.createDataFrame([tuple(bytearray(known[c].ranks) for c in able)], ", ".join(f"s{i} binary" for i in range(len(able))))
    filled = {c: (known[c].filled, known[c].mass) for c in able if known[c].mass}
    asked = [F.kll_sketch_get_rank_double(f"s{i}", F.lit(float(x))).alias(f"r{i}_{j}") for i, c in enumerate(able) if c in filled
             for j, x in enumerate((math.nextafter(filled[c][0], -math.inf), filled[c][0]))]
    places = held.select(*asked).first().asDict() if asked else {}
    fixed: dict[tuple[str, int], float] = {}
    wanted = []
    for i, c in enumerate(able):
        k = known[c]
        n = k.rows - k.nulls - k.mass
        for j, p in enumerate(ranks):
            place = p * (n + k.mass)
            if k.mass and place > places[f"r{i}_0"] * n and place <= places[f"r{i}_1"] * n + k.mass:
                fixed[c, j] = k.filled
                continue
            own = place - k.mass if k.mass and place > places[f"r{i}_0"] * n else place
            wanted.append(F.kll_sketch_get_quantile_double(f"s{i}", F.lit(min(max(own / n, 0.0), 1.0))).alias(f"q{i}_{j}"))
    got = held.select(*wanted).first().asDict() if wanted else {}
    out: dict[str, list[float | None]] = {c: [None] * len(ranks) for c in known}
    for i, c in enumerate(able):
        raw = [fixed[c, j] if (c, j) in fixed else got[f"q{i}_{j}"] for j in range(len(ranks))]
        out[c] = [(x - known[c].offset) / known[c].width for x in raw]
    return out


def plain_steps(steps: list[dict]) -> tuple[list[dict], list[dict]]:
    """The leading steps that no statistic enters, and the rest; states describe rows behind the former."""
    described_ = [describe_step(s) for s in steps]
    known = [(n, c) for n, c in described_ if n in STEPS]
    first = next((i for i, (n, c) in enumerate(known) if STEPS[n].fit and c.get("strategy") != "constant"), len(known))
    return [{"type": n, "config": c} for n, c in known[:first]], [{"type": n, "config": c} for n, c in known[first:]]


def _fit_plain(spark: SparkSession, schema: T.StructType, steps: list[dict]) -> tuple[list[dict], DataFrame]:
    df, fitted = spark.createDataFrame([], schema), []
    for s in steps:
        config = {**s["config"], "only_missing": False} if s["type"] == "fill_missing" else s["config"]
        state = fit_step(df, s["type"], config)
        fitted.append({"name": s["type"], "config": config, "fitted": state})
        df = df if s["type"] == "drop_duplicates" else apply_step(df, s["type"], config, state)
    return fitted, df


def remember(spark: SparkSession, schema: T.StructType, steps: list[dict], store: str) -> Callable[[DataFrame, int], None]:
    """What `clean_new_files` observes arrivals with: their states behind the plain steps."""
    _, after = split_at_state(_fit_plain(spark, schema, plain_steps(steps)[0])[0])
    return lambda batch, arrival: add_states(on_stream(batch, after), store, arrival)


def refit(spark: SparkSession, schema: T.StructType, steps: list[dict], store: str) -> list[dict]:
    """The steps fitted to all rows that have arrived, from the store alone.

    What a step needs is carried through the steps before it: names, filled
    nulls, scales. Behind a step that drops rows by a statistic nothing is
    known, and a step there that needs statistics is refused; so is one over a
    column that a step has made or cast.
    """
    plain, rest = plain_steps(steps)
    fitted, df = _fit_plain(spark, schema, plain)
    own = {r["column"]: r for r in merged_states(spark, store).select("column", "ranks", "m2").collect()}  # a row per column
    known: dict[str, Known | None] = {}
    for r in described(merged_states(spark, store)).collect():
        known[r["column"]] = Known(r["rows"], r["nulls"], r["low"], r["high"], r["mean"], own[r["column"]]["m2"] or 0.0, own[r["column"]]["ranks"], r["mode"])
    gone = None
    for s in rest:
        name, config = s["type"], s["config"]
        if STEPS[name].fit and gone:
            raise ValueError(f"{name}: the rows behind {gone} are not described")
        state = _fit_known(spark, df, known, name, config) if STEPS[name].fit else None
        if name in ("fill_missing", "fill_by_type"):
            config = {**config, "only_missing": False}
        fitted.append({"name": name, "config": config, "fitted": state})
        before, df = df, df if name == "drop_duplicates" else apply_step(df, name, config, state)
        if name in ("rename_columns", "snake_case_columns"):
            known = {new: known.get(old) for old, new in zip(before.columns, df.columns)}
        elif name in ("fill_missing", "fill_by_type"):
            known = {c: k.filled_with(state[c]) if k and state.get(c) is not None else k for c, k in known.items()}
        elif name in ("normalize", "standardize"):
            known = {c: k.scaled(*state[c]) if c in state else k for c, k in known.items()}
        elif name == "cast_types":
            known = {c: None if c in (config.get("mapping") or {}) else k for c, k in known.items()}
        elif name in ("derive_column", "bucket_column"):
            known[config.get("name")] = None
        elif not STEPS[name].keeps_rows:
            gone = name
    return fitted


def _fit_known(spark: SparkSession, df: DataFrame, known: dict[str, Known | None], name: str, config: dict):
    """What `fit_step` would measure on the table."""
    def of(cols):
        unknown = [c for c in cols if known.get(c) is None]
        if unknown:
            raise ValueError(f"{name}: nothing is known of {unknown}")
        return {c: known[c] for c in cols}

    if name in ("drop_missing", "drop_high_null", "keep_low_null"):
        limit = config.get("threshold_pct", 50) / 100 if name == "drop_missing" else config.get("threshold", 0.8)
        shares = {c: k.nulls / k.rows for c, k in of(df.columns).items() if k.rows}
        return [c for c, x in shares.items() if x > limit or (name == "keep_low_null" and x == limit)]
    if name in ("fill_missing", "fill_by_type"):
        strategy, cols = config.get("strategy", "median"), present(df, config.get("columns"))
        if name == "fill_by_type":
            strategy, cols = "median", [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
        numbers = of([c for c in cols if kind(df.schema[c].dataType) == NUMERIC])
        if strategy == "mode":
            modes = {c: k.mode for c, k in of([c for c in cols if not is_nested(df.schema[c].dataType)]).items()}
            return {c: UNKNOWN if v is None else _typed(v, df.schema[c].dataType) for c, v in modes.items()}
        if strategy == "constant":
            return dict.fromkeys(cols, config.get("value", UNKNOWN))
        found = {c: k.mean for c, k in numbers.items()} if strategy == "mean" else {c: q[0] for c, q in quantiles_of(spark, numbers, [0.5]).items()}
        whole = [c for c, k in numbers.items() if is_whole(df.schema[c].dataType) and not k.nulls]
        return {**{c: round(v) if c in whole and v is not None else v for c, v in found.items()}, **dict.fromkeys([c for c in cols if c not in numbers], UNKNOWN)}
    cols = of(numeric_columns(df, config.get("columns")))
    if name == "normalize":
        return {c: (k.low, k.high - k.low) for c, k in cols.items() if k.low is not None and k.high != k.low}
    if name == "standardize":
        return {c: (k.mean, k.std) for c, k in cols.items() if k.std}
    if name == "remove_outliers" and config.get("method", "iqr") == "zscore":
        return {c: (k.mean, k.std) for c, k in cols.items()}
    if name == "remove_outliers":
        far, made = float(config.get("threshold", 1.5)), quantiles_of(spark, cols, [0.25, 0.75])
        return {c: (None, None) if a is None else (a - far * (b - a), b + far * (b - a)) for c, (a, b) in made.items()}
    raise ValueError(f"{name} cannot be fitted from states")


def _typed(text: str, dtype: T.DataType):
    """A value that was kept as text, as the column's own; other types are cast where they are filled in."""
    if is_whole(dtype):
        return int(text)
    return float(text) if isinstance(dtype, (T.FloatType, T.DoubleType)) else text
