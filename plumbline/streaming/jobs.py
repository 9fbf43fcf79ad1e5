"""Structured Streaming forms of the training-step metrics.

Every job reads a stream and writes files with a checkpoint, so it restarts
where it stopped. Results are read back as tables.

Averages and alarms depend on order. They are folded per run over pieces of
event time that the watermark has closed, and leave the stream once; see
`folds`. A source that falls silent closes nothing more: a row of a null run
(a heartbeat) moves the watermark on and is otherwise left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import config as C
from plumbline.operators.sequence import axis_weights
from plumbline.schemas import EVENTS
from plumbline.streaming.folds import AlarmFold, EmaFold, first_calls


def event_stream(spark: SparkSession, path: str, pattern: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; without `files_per_batch` Spark takes what is there."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for the queries started inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _fold_to_table(folded: DataFrame, path: str, on_late: Callable[[int], None] | None) -> DataFrame:
    """Process everything available; returns all rows that have left the stream so far.

    `on_late` gets the number of row groups that came behind the watermark (as
    far as Spark keeps the progress of micro-batches).
    """
    spark = folded.sparkSession
    with _rocks(spark):
        query = (
            folded.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start(f"{path}/out")
        )
        query.awaitTermination()
    if on_late:
        on_late(sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators))
    return spark.read.schema(folded.schema).parquet(f"{path}/out")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available and return what was written."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/out")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def stream_step_means(stream: DataFrame, path: str, run: str, step: Column, values: dict[str, Column],
                      delay: str = "1 day", piece: str = "1 day") -> DataFrame:
    """Mean per run and step, updated while rows of the step arrive.

    Spark keeps sums per run, step and `piece` of event time, and drops a piece
    once the watermark has passed it; rows later than `delay` are ignored. Each
    micro-batch writes the pieces it changed. Reading takes the newest version
    of every piece and adds the pieces of a step, so a step may span any number
    of pieces and micro-batches, in any order within the delay.
    """
    aggs = [a for n, v in values.items() for a in (F.sum(v).alias(f"__s_{n}"), F.count(v).alias(f"__c_{n}"))]
    sums = stream.withWatermark("ts", delay).groupBy(
        F.window("ts", piece).alias("piece"), run, step.alias("step")
    ).agg(F.count(F.lit(1)).alias("n"), *aggs)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    query = (
        sums.writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return step_means(stream.sparkSession.read.parquet(f"{path}/out"), run, list(values))


def step_means(pieces: DataFrame, run: str, names: list[str]) -> DataFrame:
    """One row per run and step from the written versions of its pieces."""
    columns = ["n", *[f"__{k}_{n}" for n in names for k in "sc"]]
    newest = pieces.groupBy(run, "step", "piece").agg(F.max_by(F.struct(*columns), "version").alias("r"))
    total = newest.groupBy(run, "step").agg(*[F.sum(f"r.{c}").alias(c) for c in columns])
    return total.select(run, "step", "n", *[
        F.when(F.col(f"__c_{n}") > 0, F.col(f"__s_{n}") / F.col(f"__c_{n}")).alias(n) for n in names])


def _millis(duration: str) -> int:
    """Milliseconds of an interval of days or less."""
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def _with_run(stream: DataFrame, run: str, delay: str) -> DataFrame:
    """Rows of a run, behind the watermark of all rows.

    The rule names the event time: otherwise Spark would drop heartbeats before they move the watermark.
    """
    return stream.withWatermark("ts", delay).where(F.col(run).isNotNull() | F.col("ts").isNull())


def _ema_fold(stream: DataFrame, run: str, step: Column, values: dict[str, Column], alpha: float,
              start: float | None, delay: str, piece: str, quiet: str | None) -> DataFrame:
    """Stream of closed steps: run, step, n, the axes' means and their averages, late."""
    axes = list(values)
    aggs = [a for n, v in values.items() for a in (F.sum(v.cast("double")).alias(f"s_{n}"), F.count(v).alias(f"c_{n}"))]
    pieces = _with_run(stream, run, delay).groupBy(
        F.window("ts", piece), run, step.cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    known = pieces.where("step IS NOT NULL").select(
        run, "window", F.unix_millis("window.end").alias("end"), "step", "n", *[f"{k}_{a}" for a in axes for k in "sc"])
    kind = stream.schema[run].dataType.simpleString()
    schema = ", ".join([f"`{run}` {kind}", "step bigint", "n bigint", *[f"`{a}` double" for a in axes],
                        *[f"`ema_{a}` double" for a in axes], "late boolean"])
    fold = EmaFold(run, axes, alpha, start, _millis(quiet or piece))
    return known.groupBy(run).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def stream_ema(stream: DataFrame, path: str, run: str, step: Column, values: dict[str, Column],
               alpha: float = C.EMA_ALPHA, delay: str = "1 day", piece: str = "1 day", quiet: str | None = None,
               on_late: Callable[[int], None] | None = None) -> DataFrame:
    """EMA of the per-step means, one row per closed step, in the order of steps.

    Steps rise with event time. A step is closed by a later one, or once the
    watermark (the latest time less `delay`) has passed its last `piece` of event
    time by `quiet` (as long as a piece; longer if a run may fall silent within a
    step). A part of a step that comes after the step was closed moves no
    average; it is in the output folder as a row with `late` set.
    """
    folded = _ema_fold(stream, run, step, values, alpha, None, delay, piece, quiet)
    out = _fold_to_table(folded, path, on_late)
    complete = [F.col(f"ema_{a}").isNotNull() for a in values]
    return out.where(~F.col("late") & complete[0]).select(run, "step", *[f"ema_{a}" for a in values])


def stream_adaptive_weights(stream: DataFrame, path: str, run: str, step: Column, values: dict[str, Column],
                            strategy: str = "mean_inverse", delay: str = "1 day", piece: str = "1 day",
                            quiet: str | None = None, on_late: Callable[[int], None] | None = None) -> DataFrame:
    """Axis weights after each closed step; the running means are the stream's state."""
    axes = ["ahimsa", "dharma", "helpfulness"]
    folded = _ema_fold(stream, run, step, {a: values[a] for a in axes}, C.ADAPTIVE_GAMMA, C.ADAPTIVE_START,
                       delay, piece, quiet)
    means = folded.where(~F.col("late") & F.col("ema_ahimsa").isNotNull()).select(
        run, "step", *[F.col(f"ema_{a}").alias(f"mean_{a}") for a in axes])
    out = _fold_to_table(axis_weights(means, strategy), path, on_late)
    return out.select(run, "step", *[f"weight_{a}" for a in axes])


def stream_error_alarm(stream: DataFrame, path: str, run: str, order: list[str], failed: Column,
                       threshold: float = C.ERROR_RATE_THRESHOLD, min_calls: int = C.ERROR_RATE_MIN_CALLS,
                       delay: str = "1 day", piece: str = "1 hour", on_late: Callable[[int], None] | None = None) -> DataFrame:
    """One alarm row per run, which leaves the stream when the first breach is closed.

    The calls of a run and `piece` of event time are held until the watermark has
    passed them, wherever a hot run's pieces lie; each is put in order and cut
    down to the failed calls that can be a first breach. The fold per run goes
    over these few. `order` starts with the event time.
    """
    columns = [stream.schema[c] for c in order]
    calls = _with_run(stream, run, delay).groupBy(F.window("ts", piece), run).agg(
        F.sort_array(F.collect_list(F.struct(*order, failed.alias("__failed")))).alias("list"))
    held = calls.select(run, F.unix_millis("window.end").alias("end"), "list")
    kind = stream.schema[run].dataType.simpleString()
    listed = ", ".join(f"`{c.name}`: {c.dataType.simpleString()}" for c in columns)
    schema = f"`{run}` {kind}, end bigint, calls bigint, errors bigint, records array<struct<{listed}, c: bigint, e: bigint>>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, end, list_ in zip(batch[run], batch["end"], batch["list"]):
                bad = np.array([bool(r["__failed"]) for r in list_], bool)
                before = np.cumsum(bad)
                records = [{**{o: list_[k][o] for o in order}, "c": int(k) + 1, "e": int(before[k])}
                           for k in first_calls(bad, threshold, min_calls)]
                rows.append((name, end, len(list_), int(bad.sum()), records))
            yield pd.DataFrame(rows, columns=[run, "end", "calls", "errors", "records"])

    out = ", ".join([f"`{run}` {kind}", *[f"`{c.name}` {c.dataType.simpleString()}" for c in columns], "errors bigint", "calls bigint"])
    fold = AlarmFold(run, order, threshold, min_calls)
    alarms = held.mapInPandas(cut, schema).groupBy(run).transformWithStateInPandas(fold, out, "Append", "None")
    return _fold_to_table(alarms, path, on_late).withColumn("error_rate", F.col("errors") / F.col("calls"))


def stream_dedupe(stream: DataFrame, path: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row per key among rows that arrive within the watermark of each other."""
    return run_to_table(stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys), path)


def stream_score(stream: DataFrame, path: str, score) -> DataFrame:
    """Any stateless batch scoring, applied to rows as they arrive."""
    return run_to_table(stream.transform(score), path)
