"""Column profiles and the reports that are read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import CATEGORICAL, DATETIME, NUMERIC, col, flat, kinds
from ..functions.comoments import correlations
from ..functions.stats import value

PROFILE = (
    "column string, dtype string, kind string, total bigint, missing bigint, missing_pct double, unique bigint, "
    "unique_pct double, min double, max double, mean double, median double, std double, skew double, "
    "q1 double, q3 double, zeros bigint, negatives bigint")


_QUARTERS = [0.25, 0.5, 0.75]


def pct(part: float, whole: float, digits: int = 2) -> float:
    return round(part / whole * 100, digits) if whole else 0.0


def _rounded(x, digits: int = 4):
    return None if x is None else round(float(x), digits) + 0.0  # no negative zero


def column_stats(df: DataFrame, approx: bool = False, row_limit: int = stats.ROW_LIMIT) -> list[dict]:
    """One dict per column, unrounded.

    Two passes: fused moments, then quartiles and distinct counts from one shuffle.
    `approx` answers the latter with sketches.
    """
    by_kind = kinds(df)
    numeric = [c for c, k in by_kind.items() if k == NUMERIC]
    wanted = {None: F.count(F.lit(1))}
    for c, k in by_kind.items():
        v = value(df, c)
        if k == NUMERIC:
            wanted |= {**stats.moment_aggregates(df, c), (c, "zeros"): F.count_if(v == 0), (c, "negatives"): F.count_if(v < 0)}
        else:
            wanted[c, "n"] = F.count(v)
        if k == DATETIME:
            wanted |= {(c, "min"): F.min(v).cast("string"), (c, "max"): F.max(v).cast("string")}
    got = stats.measure(df, wanted, fields=2)
    n = {c: got[c, "n"] for c in df.columns}
    if approx:
        quarts = stats.quantiles(df, numeric, _QUARTERS, known=n, accuracy=10_000)
        unique = stats.distinct_counts(df, df.columns, approx=True)
    else:
        quarts, unique = stats.quantiles_and_distinct(df, numeric, _QUARTERS, df.columns, n, row_limit)
    out = []
    for f in df.schema:
        c, n = f.name, got[f.name, "n"]
        s = {"column": c, "dtype": f.dataType.simpleString(), "kind": by_kind[c], "total": got[None],
             "missing": got[None] - n, "unique": unique[c], "n": n}
        if by_kind[c] == NUMERIC and not n:
            s["kind"] = CATEGORICAL  # nothing to measure
        elif by_kind[c] == NUMERIC:
            q1, median, q3 = quarts[c]
            s |= {**stats.finish_moments(got, c), "zeros": got[c, "zeros"], "negatives": got[c, "negatives"]}
            s |= {"q1": q1, "median": median, "q3": q3}
        elif by_kind[c] == DATETIME:
            s |= {"first": got[c, "min"], "last": got[c, "max"]}
        s |= {"missing_pct": pct(s["missing"], s["total"]), "unique_pct": pct(s["unique"], s["total"])}
        out.append(s)
    return out


def profile(df: DataFrame, measured: list[dict] | None = None, **options) -> DataFrame:
    rows = []
    for s in measured or column_stats(df, **options):
        rows.append((s["column"], s["dtype"], s["kind"], s["total"], s["missing"], s["missing_pct"], s["unique"],
                     s["unique_pct"], *[_rounded(s.get(m)) for m in ("min", "max", "mean", "median", "std", "skew", "q1", "q3")],
                     s.get("zeros"), s.get("negatives")))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def datetime_profile(df: DataFrame) -> DataFrame:
    cols = [c for c, k in kinds(df).items() if k == DATETIME]
    row = df.agg(*[F.array(F.min(col(c)).cast("string"), F.max(col(c)).cast("string")).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first() if cols else []
    return df.sparkSession.createDataFrame([(c, *m) for c, m in zip(cols, row)], "column string, min string, max string")


def sample_values(df: DataFrame, order_by: list[str], n: int = 5, columns: list[str] | None = None) -> DataFrame:
    """The first n non-null values of every column, as text; the smaller text first on a tie.

    One scan for all columns: each task keeps n values per column before anything is shuffled.
    """
    cols = df.columns if columns is None else columns
    at, slots = [f"_at{i}" for i in range(len(order_by))], [str(i) for i in range(len(cols))]
    cells = [F.when(value(df, c).isNotNull(), flat(df, c).cast("string")).alias(slot) for slot, c in zip(slots, cols)]
    table = (df.select(*[col(o).alias(a) for a, o in zip(at, order_by)], *cells)
             .unpivot(at, slots, "slot", "value").filter("value is not null"))
    place = F.row_number().over(W.partitionBy("slot").orderBy(*at, "value"))
    name = F.array(*[F.lit(c) for c in cols])[F.col("slot").cast("int")]
    return table.withColumn("position", place).filter(F.col("position") <= n).select(name.alias("column"), "position", "value")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 15) -> DataFrame:
    """The k most frequent values of each categorical column, smaller value first on a tie."""
    cols = columns or [c for c, kind_ in kinds(df).items() if kind_ == CATEGORICAL]
    parts = []
    for slots, table in stats.frequencies(df, cols):
        name = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])[F.col("slot")]
        best = W.partitionBy("slot").orderBy(F.desc("count"), F.asc("value"))
        parts.append(table.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                     .select(name.alias("column"), F.col("value").cast("string").alias("value"), "count", "rank"))
    return reduce(DataFrame.unionByName, parts)


def _distinct_up_to(df: DataFrame, cols: list[str], enough: int) -> dict[str, int]:
    """Distinct counts, exact where a sketch does not show far more than enough of them."""
    seen = stats.distinct_counts(df, cols, approx=True)
    few = [c for c in cols if seen[c] <= 10 * enough]
    return seen | stats.distinct_counts(df, few)


def histogram(df: DataFrame, measured: list[dict] | None = None, max_bins: int = 20) -> DataFrame:
    """Equal-width bins per numeric column; the last bin takes its upper edge too."""
    if measured is None:
        numeric = [c for c, k in kinds(df).items() if k == NUMERIC]
        ends = stats.measure(df, {**{(c, "min"): F.min(value(df, c)) for c in numeric},
                                  **{(c, "max"): F.max(value(df, c)) for c in numeric}}, fields=1)
        unique = _distinct_up_to(df, numeric, max_bins)
        measured = [{"column": c, "min": ends[c, "min"], "max": ends[c, "max"], "unique": unique[c]}
                    for c in numeric if ends[c, "min"] is not None]
    plans = []
    for s in (m for m in measured if "min" in m):
        lo, hi = float(s["min"]), float(s["max"])
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        plans.append((s["column"], lo, hi, min(max_bins, max(s["unique"], 2))))
    # The first guess by division can be one bin off an edge; the edges decide.
    slots = [str(i) for i in range(len(plans))]
    guessed, placed = [], []
    for s, (c, lo, hi, n) in zip(slots, plans):
        v, b, width = F.col(f"v{s}"), F.col(f"b{s}"), F.lit((hi - lo) / n)
        number = value(df, c).cast("double")
        guess = F.least(F.floor((number - lo) / (hi - lo) * n).cast("int"), F.lit(n - 1))
        guessed += [number.alias(f"v{s}"), guess.alias(f"b{s}")]
        below = (v < F.lit(lo) + b * width).cast("int")
        above = ((b < n - 1) & (v >= F.lit(lo) + (b + 1) * width)).cast("int")
        placed.append(F.when(v.isNotNull(), b - below + above).alias(s))
    counted = (df.select(*guessed).select(*placed).unpivot([], slots, "slot", "bin")
               .filter("bin is not null").groupBy("slot", "bin").count())
    edges = [(str(i), c, b, round(lo + b * (hi - lo) / n, 2), round(hi if b == n - 1 else lo + (b + 1) * (hi - lo) / n, 2))
             for i, (c, lo, hi, n) in enumerate(plans) for b in range(n)]
    grid = df.sparkSession.createDataFrame(edges, "slot string, column string, bin int, lo double, hi double")
    return grid.join(counted, ["slot", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def missing_report(df: DataFrame) -> DataFrame:
    total, nulls = stats.null_counts(df)
    return df.sparkSession.createDataFrame(
        [(c, n, pct(n, total)) for c, n in nulls.items()], "column string, count bigint, pct double")


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, repeats beyond the first, distinct rows; copies are combined before the shuffle."""
    copies = df.groupBy(*[flat(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]).count()
    total = F.coalesce(F.sum("count"), F.lit(0))
    return (copies.agg(total.alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"))
            .select("total_rows", (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"), "unique_rows")
            .withColumn("dupe_pct", F.coalesce(
                F.bround(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")).cast("double"), 2), F.lit(0.0))))


def outlier_report(df: DataFrame, measured: list[dict] | None = None, row_limit: int = stats.ROW_LIMIT) -> DataFrame:
    """Numeric columns with ten values or more that have values outside 1.5 quartile ranges or |z| > 3."""
    if measured is None:
        numeric = [c for c, k in kinds(df).items() if k == NUMERIC]
        base = stats.moments(df, numeric)
        quarts = stats.quantiles(df, numeric, [0.25, 0.75], row_limit, {c: base[c]["n"] for c in numeric})
        measured = [{"column": c, "kind": NUMERIC, **base[c], "q1": quarts[c][0], "q3": quarts[c][1]} for c in numeric]
    wanted, bounds = {}, {}
    for s in (m for m in measured if m["kind"] == NUMERIC and m["n"] >= 10):
        c, iqr = s["column"], s["q3"] - s["q1"]
        bounds[c] = (s["q1"] - 1.5 * iqr, s["q3"] + 1.5 * iqr, s["n"])
        v = value(df, c)
        wanted[c, "iqr"] = F.count_if((v < bounds[c][0]) | (v > bounds[c][1]))
        wanted[c, "z"] = (F.count_if(F.abs((v - F.lit(float(s["mean"]))) / F.lit(float(s["std_pop"]))) > 3)
                          if s["std_pop"] else F.count_if(F.lit(False)))
    got = stats.measure(df, wanted, fields=1) if wanted else {}
    rows = [(c, got[c, "iqr"], got[c, "z"], round(lo, 4), round(hi, 4), pct(got[c, "iqr"], n))
            for c, (lo, hi, n) in bounds.items() if got[c, "iqr"] or got[c, "z"]]
    return df.sparkSession.createDataFrame(
        rows, "column string, iqr_outliers bigint, zscore_outliers bigint, iqr_lo double, iqr_hi double, pct_flagged double")


def pearson(x, y):
    """Correlation over the rows that have both values; null where one side is constant.

    `corr` itself refuses constant columns, so the size comes from the share of
    explained variance and the sign from the covariance.
    """
    x, y = x.cast("double"), y.cast("double")
    together, explained = F.covar_samp(x, y), F.regr_r2(y, x)
    return F.when((together != 0) | (explained < 1), F.sqrt(explained) * F.signum(together))


def correlation(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """All ordered pairs of numeric columns, from one scan whose shuffle grows with the columns and not with the rows."""
    numeric = columns or [c for c, k in kinds(df).items() if k == NUMERIC]
    schema = "col_a string, col_b string, r double"
    if len(numeric) < 2:
        return df.sparkSession.createDataFrame([], schema)
    found = correlations(df, [value(df, c) for c in numeric])
    rows = [(a, b, _rounded(1.0 if i == j and found[i][j] is not None else found[i][j], digits))
            for i, a in enumerate(numeric) for j, b in enumerate(numeric)]
    return df.sparkSession.createDataFrame(rows, schema)


def schema_listing(df: DataFrame) -> DataFrame:
    """Type, kind and whether nulls occur, per column, with the row count."""
    total, nulls = stats.null_counts(df)
    rows = [(f.name, f.dataType.simpleString(), kinds(df)[f.name], nulls[f.name] > 0, total) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, kind string, nullable boolean, row_count bigint")


def file_summary(df: DataFrame, file_column: str = "file_name") -> DataFrame:
    """Rows, missing cells and repeated rows of every file read together."""
    cols = [c for c in df.columns if c != file_column]
    cells = sum([F.when(value(df, c).isNull(), 1).otherwise(0) for c in cols], F.lit(0))
    copies = (df.select(col(file_column).alias("file"), cells.alias("gaps"),
                        *[flat(df, c).alias(f"k{i}") for i, c in enumerate(cols)])
              .groupBy("file", *[f"k{i}" for i in range(len(cols))])
              .agg(F.count(F.lit(1)).alias("copies"), F.sum("gaps").alias("gaps")))
    return copies.groupBy("file").agg(
        F.sum("copies").alias("rows"), F.sum("gaps").alias("missing"), F.sum(F.col("copies") - 1).alias("dupes")).select(
        "file", "rows", F.lit(len(cols)).cast("bigint").alias("cols"), "missing", "dupes")
