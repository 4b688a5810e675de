"""Run a list of step descriptions over a table."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..operators import fill, group, rows, scale, shape
from ..sources.scratch import settle

STEP_LOG = ("position int, step string, status string, rows_before bigint, rows_after bigint, rows_delta bigint, "
            "duration_s double, error string")


@dataclass(frozen=True)
class Step:
    """How a step is applied; `fit` measures the table first where that is needed."""

    apply: Callable[..., DataFrame]
    fit: Callable[..., Any] | None = None
    keeps_rows: bool = True
    shuffles: bool = False
    by_row: bool = True  # fitted, each row is treated by itself

    def moves_rows(self, config: dict) -> bool:
        return self.shuffles or config.get("strategy") in ("ffill", "bfill")


def _fit_fill(df, strategy="median", columns=None, value=None, only_missing=True):
    return None if strategy in ("ffill", "bfill") else fill.fit_fill(df, strategy, columns, value, only_missing)


def _apply_fill(df, fitted, strategy="median", columns=None, value=None, order_by=None, partition_by=None):
    if strategy in ("ffill", "bfill"):
        return fill.fill_missing(df, strategy, columns, order_by=order_by, partition_by=partition_by)
    return fill.apply_fill(df, fitted, strategy)


def _drop_fitted(df, fitted):
    return shape.drop_columns(df, fitted)


def _scaler(method: str) -> Step:
    return Step(lambda df, fitted: scale.apply_scale(df, fitted), lambda df, columns=None: scale.fit_scale(df, method, columns))


STEPS: dict[str, Step] = {
    "drop_duplicates": Step(rows.drop_duplicates, keeps_rows=False, shuffles=True, by_row=False),
    "drop_nulls": Step(rows.drop_nulls, keeps_rows=False),
    "fill_missing": Step(_apply_fill, _fit_fill),
    "fill_by_type": Step(fill.apply_by_type, fill.fit_by_type),
    "drop_missing": Step(_drop_fitted, lambda df, threshold_pct=50: shape.sparse_columns(df, threshold_pct / 100)),
    "drop_high_null": Step(_drop_fitted, lambda df, threshold=0.8: shape.sparse_columns(df, threshold)),
    "keep_low_null": Step(_drop_fitted, lambda df, threshold=0.8: shape.sparse_columns(df, threshold, inclusive=True)),
    "normalize": _scaler("normalize"),
    "standardize": _scaler("standardize"),
    "filter_rows": Step(rows.filter_rows, keeps_rows=False),
    "cast_types": Step(shape.cast_types),
    "rename_columns": Step(shape.rename_columns),
    "drop_columns": Step(shape.drop_columns),
    "snake_case_columns": Step(shape.snake_case_columns),
    "trim_strings": Step(shape.trim_strings),
    "aggregate": Step(group.aggregate, keeps_rows=False, shuffles=True, by_row=False),
    "derive_column": Step(shape.derive_column),
    "bucket_column": Step(shape.bucket_column),
    "remove_outliers": Step(
        lambda df, fitted, method="iqr", threshold=1.5: rows.keep_within(df, fitted, method, float(threshold)),
        lambda df, columns=None, method="iqr", threshold=1.5: rows.outlier_bounds(df, columns, method, float(threshold)),
        keeps_rows=False),
    "repartition": Step(shape.repartition, shuffles=True),
    "window": Step(group.window, shuffles=True, by_row=False),
    "sql": Step(group.sql_step, keeps_rows=False, shuffles=True, by_row=False),
    "passthrough": Step(shape.passthrough),
}
#: What a setting that does not fit the table raises. Failures of Spark jobs are none of these.
BAD_SETTINGS = (AnalysisException, ParseException, ValueError, TypeError, KeyError)
OTHER_NAMES = {
    "deduplicate": "drop_duplicates", "cast": "cast_types", "snake_case_cols": "snake_case_columns",
    "spark_repartition": "repartition",
}
_OTHER_KEYS = {"casts": "mapping"}


def describe_step(step: dict) -> tuple[str, dict]:
    """Name and settings of a step in any of its written forms.

    ``{"type", "config"}``, ``{"op", ...settings}`` or ``{"operation", ...settings}``.
    """
    if "operation" in step:
        name, config = step["operation"], {k: v for k, v in step.items() if k != "operation"}
        config |= config.pop("window", {}) or {}
    elif "op" in step:
        name, config = step["op"], {k: v for k, v in step.items() if k != "op"}
        if name == "aggregate":
            config["suffix"] = True
    else:
        name, config = step.get("type", ""), dict(step.get("config") or {})
    config = {_OTHER_KEYS.get(k, k): v for k, v in config.items()}
    return OTHER_NAMES.get(name, name), config


def _settings(fn: Callable, config: dict) -> dict:
    known = inspect.signature(fn).parameters
    return {k: v for k, v in config.items() if k in known}


def fit_step(df: DataFrame, name: str, config: dict) -> Any:
    fit = STEPS[name].fit
    return fit(df, **_settings(fit, config)) if fit else None


def apply_step(df: DataFrame, name: str, config: dict, fitted: Any = None) -> DataFrame:
    step = STEPS[name]
    args = (df, fitted) if step.fit else (df,)
    return step.apply(*args, **_settings(step.apply, config))


@dataclass
class Result:
    df: DataFrame
    log: list[dict] = field(default_factory=list)

    @property
    def status(self) -> str:
        """success, or partial if a step was left out."""
        return "partial" if any(e["status"] == "failed" for e in self.log) else "success"

    def log_frame(self, spark: SparkSession) -> DataFrame:
        names = ("step", "status", "rows_before", "rows_after", "rows_delta", "duration_s", "error")
        return spark.createDataFrame([(i + 1, *[e.get(n) for n in names]) for i, e in enumerate(self.log)], STEP_LOG)


def run_steps(df: DataFrame, steps: list[dict], metrics: bool = False) -> Result:
    """Fold the steps over the table.

    A step whose settings do not fit is logged and left out, an unknown one is
    skipped; a Spark job that fails is raised.  Before
    a step measures the table, the outcome of an earlier shuffle is written once,
    so that neither the measuring nor the final pass repeats it.  `metrics` adds
    row counts to the log; only steps that can change the count are counted.
    """
    result = Result(df)
    count = df.count() if metrics else None
    unsettled = False
    for written in steps:
        name, config = describe_step(written)
        if name not in STEPS:
            result.log.append({"step": name, "status": "skipped", "error": "unknown type"})
            continue
        step, started, entry = STEPS[name], time.monotonic(), {"step": name, "rows_before": count}
        try:
            if unsettled and step.fit:
                result.df, unsettled = settle(result.df), False
            after = apply_step(result.df, name, config, fit_step(result.df, name, config))
            unsettled = unsettled or step.moves_rows(config)
            if metrics and not step.keeps_rows:
                if unsettled:
                    after, unsettled = settle(after), False
                count = after.count()
            result.df = after
            entry["status"] = "success"
            if metrics:
                entry |= {"rows_after": count, "rows_delta": entry["rows_before"] - count}
        except BAD_SETTINGS as e:  # the run goes on without the step; a job that fails ends it
            entry |= {"status": "failed", "error": str(e).splitlines()[0]}
        entry["duration_s"] = round(time.monotonic() - started, 3)
        result.log.append(entry)
    return result


def fit_steps(df: DataFrame, steps: list[dict]) -> list[dict]:
    """The steps with everything they measure on this table, to run them on other rows."""
    fitted, unsettled = [], False
    for written in steps:
        name, config = describe_step(written)
        if name not in STEPS:
            continue
        if name in ("fill_missing", "fill_by_type"):
            config = {**config, "only_missing": False}
        if STEPS[name].fit and unsettled:  # once for each shuffle; the steps behind it are on single rows
            df, unsettled = settle(df), False
        state = fit_step(df, name, config)
        fitted.append({"name": name, "config": config, "fitted": state})
        df = apply_step(df, name, config, state)
        unsettled = unsettled or STEPS[name].moves_rows(config)
    return fitted


def apply_steps(df: DataFrame, fitted: list[dict]) -> DataFrame:
    for f in fitted:
        df = apply_step(df, f["name"], f["config"], f["fitted"])
    return df
