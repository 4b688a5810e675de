"""Run saved steps over files that have arrived since the last time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import flat, is_nested
from ..plans.steps import STEPS, apply_step


def clean_new_files(spark: SparkSession, folder: str, schema: T.StructType, fitted: list[dict], out: str,
                    checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None,
                    unique_by: list[str] | None = None, event_time: str | None = None, delay: str = "1 day",
                    observe: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process every file not yet seen, then stop; returns all that was written so far.

    The steps carry the statistics they were fitted with (`fit_steps`), so a new
    file is treated like the table they were fitted on.  Each micro-batch owns a
    folder and replaces it when it is retried, so no row is written twice.
    `unique_by` drops rows already seen in earlier files, by columns of the
    files; `drop_duplicates` does so wherever it stands among the steps, by the
    columns there are at that place.  With `event_time` keys are forgotten after
    the delay, which bounds the state.  Other steps must treat each row by
    itself: one that looks at several rows would answer for a batch instead of
    the table and is refused.

    `observe` gets every micro-batch as it stands behind the last
    `drop_duplicates` (else as it comes in), with its number; it may be called
    again for a batch that is retried.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(folder)
    if event_time:
        stream = stream.withWatermark(event_time, delay)
    if unique_by:
        stream = _seen_once(stream, unique_by, bool(event_time))
    before, after = split_at_state(fitted)
    stream = on_stream(stream, before, bool(event_time))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if observe:
            batch = batch.persist()
            observe(batch, batch_id)
        on_stream(batch, after).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if observe:
            batch.unpersist()

    query = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def split_at_state(fitted: list[dict]) -> tuple[list[dict], list[dict]]:
    """The steps up to the last that needs rows of earlier files, which run on the stream, and those on single rows behind it.

    Refused are steps that look at several rows and have no state to do so.
    """
    refused = [s["name"] for s in fitted if not (row_wise([s]) or _is_stateful(s))]
    if refused:
        raise ValueError(f"not row by row: {refused}")
    if any(_is_stateful(s) and s["config"].get("order_by") for s in fitted):
        raise ValueError("which of several copies comes first is not known before all files are")
    last = max((i + 1 for i, s in enumerate(fitted) if _is_stateful(s)), default=0)
    return fitted[:last], fitted[last:]


def on_stream(df: DataFrame, fitted: list[dict], watermarked: bool = False) -> DataFrame:
    """The steps in their order over a stream; duplicates are told by the state of the query."""
    for s in fitted:
        if _is_stateful(s):
            df = _seen_once(df, s["config"].get("subset"), watermarked)
        else:
            df = apply_step(df, s["name"], s["config"], s["fitted"])
    return df


def _is_stateful(step: dict) -> bool:
    return step["name"] == "drop_duplicates"


def _seen_once(stream: DataFrame, subset: list[str] | None, watermarked: bool) -> DataFrame:
    """The first row of each key, or of each whole row; maps and other nested values are told apart by their text."""
    if subset and (missing := [c for c in subset if c not in stream.columns]):
        raise ValueError(f"columns not found: {missing}")
    keys = subset or stream.columns
    texts = {f"_key{i}": flat(stream, c) for i, c in enumerate(keys) if is_nested(stream.schema[c].dataType)}
    plain = [c for c in keys if not is_nested(stream.schema[c].dataType)]
    keyed = stream.withColumns(texts) if texts else stream
    kept = keyed.dropDuplicatesWithinWatermark([*plain, *texts]) if watermarked else keyed.dropDuplicates([*plain, *texts])
    return kept.drop(*texts)


def row_wise(steps: list[dict]) -> bool:
    """Whether the fitted steps treat each row by itself, so that batches add up to the whole."""
    return all(STEPS[s["name"]].by_row and s["config"].get("strategy") not in ("ffill", "bfill") for s in steps)


def follow_log(spark: SparkSession, folder: str, schema: T.StructType, run_id, since_id: int, out: str,
               checkpoint: str, run: str = "run_id", id: str = "id", fmt: str = "parquet") -> DataFrame:
    """Append log rows of one run beyond an id as their files arrive."""
    lines = spark.readStream.schema(schema).format(fmt).load(folder)
    wanted = lines.filter((F.col(run) == run_id) & (F.col(id) > since_id))
    query = (wanted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)
