"""Order-dependent metrics over training steps, without one-task groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from plumbline import config as C
from plumbline.functions import names as N
from plumbline.operators.ordering import (
    add_rank, fill_forward, running_sums, with_preceding,
)

_FAN = 256


def _pairs(a: Column, b: Column, scale: Column) -> Column:
    """scale * a + b, element by element."""
    return F.zip_with(a, b, lambda x, y: scale * x + y)


def _carry_in(blocks: DataFrame, by: list[str], n_blocks: int, start: Column | None) -> DataFrame:
    """Value before each block, from per-block affine maps y -> a*y + b.

    Maps compose, so blocks are folded `_FAN` at a time and the folds are
    folded again: no level ever holds more than `_FAN` rows of one run.
    """
    maps = F.array_sort(F.collect_list(F.struct("block", "a", "b", "first")))
    groups = blocks.groupBy(*by, F.floor(F.col("block") / _FAN).alias("sup")).agg(maps.alias("maps"))
    width = F.size(F.col("maps")[0]["b"])
    seen = "array<struct<block:bigint,a:double,b:array<double>>>"
    init = F.struct(
        F.array().cast(seen).alias("seen"), F.lit(1.0).alias("a"),
        F.array_repeat(F.lit(0.0), width).cast("array<double>").alias("b"),
    )

    def step(acc: Column, m: Column) -> Column:
        here = F.struct(m["block"].alias("block"), acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            F.concat(acc["seen"], F.array(here)).alias("seen"),
            (acc["a"] * m["a"]).alias("a"), _pairs(acc["b"], m["b"], m["a"]).alias("b"),
        )

    folded = groups.withColumn("fold", F.aggregate("maps", init, step))
    if n_blocks <= _FAN:
        first = F.col("maps")[0]["first"]
        carries = folded.withColumn("carry", first if start is None else F.transform(first, lambda x: start))
    else:
        upper = folded.select(
            *by, F.col("sup").alias("block"), F.col("fold.a").alias("a"), F.col("fold.b").alias("b"),
            F.col("maps")[0]["first"].alias("first"),
        )
        above = _carry_in(upper, by, math.ceil(n_blocks / _FAN) + 1, start).withColumnRenamed("block", "sup")
        carries = folded.join(above, [*by, "sup"])
    entry = F.col("s")
    return carries.select(*by, "carry", F.explode("fold.seen").alias("s")).select(
        *by, entry["block"].alias("block"), _pairs(F.col("carry"), entry["b"], entry["a"]).alias("carry")
    )


def ema_scan(df: DataFrame, by: list[str], step: str, columns: list[str], alpha: float,
             start: float | None = None, prefix: str = "ema_") -> DataFrame:
    """Exponential moving averages of `columns` along whole-number steps.

    One row per `by` (not null) and `step`. A row with a null in `columns` is left
    out: it neither moves the averages nor has any. Without `start` the first
    value seeds the average. Steps are cut into short blocks: inside a block the recurrence is
    a window sum with weights that stay far from overflow, across blocks it is
    a composition of affine maps.
    """
    decay = 1.0 - alpha
    size = max(1, min(512, int(100 * math.log(10) / -math.log(decay)))) if decay > 0 else 1
    complete = F.col(step).isNotNull()
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    known = df.where(complete)
    if decay <= 0:
        return known.withColumns({f"{prefix}{c}": F.col(c) for c in columns})
    span = known.agg(F.min(step), F.max(step)).first()
    low, high = (span[0] or 0), (span[1] or 0)
    blocked = known.withColumn("block", F.floor((F.col(step) - F.lit(low)) / size))
    window = W.partitionBy(*by, "block").orderBy(step)
    rows = blocked.withColumn("__i", F.row_number().over(window))
    weight = F.pow(F.lit(decay), -F.col("__i").cast("double")) * alpha
    upto = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = [F.sum(F.col(c) * weight).over(upto) for c in columns]
    fade = F.pow(F.lit(decay), F.col("__i").cast("double"))
    rows = rows.withColumn("__w", F.array(*local)).withColumn("__fade", fade)
    rows = rows.withColumn("__local", F.transform("__w", lambda x: x * F.col("__fade"))).drop("__w")
    values = F.array(*[F.col(c).cast("double") for c in columns])
    maps = rows.groupBy(*by, "block").agg(
        F.min("__fade").alias("a"), F.max_by("__local", "__i").alias("b"), F.min_by(values, "__i").alias("first")
    )
    n_blocks = int((high - low) // size) + 1
    carry = _carry_in(maps, by, n_blocks, None if start is None else F.lit(start))
    joined = rows.join(carry, [*by, "block"])
    return joined.withColumns({
        f"{prefix}{c}": F.col("__local")[i] + F.col("__fade") * F.col("carry")[i] for i, c in enumerate(columns)
    }).drop("block", "__i", "__fade", "__local", "carry")


def ema_mean_std(audit: DataFrame, run: str = "run", step: str = "step",
                 scores: tuple[str, ...] = ("ahimsa", "dharma", "helpfulness", "combined"),
                 alpha: float = C.EMA_ALPHA) -> DataFrame:
    """EMA of the per-step mean and population deviation of each score."""
    aggs = []
    for s in scores:
        aggs += [F.avg(f"{s}_score").alias(s), F.stddev_pop(f"{s}_score").alias(f"{s}_std")]
    steps = audit.groupBy(run, step).agg(*aggs)
    columns = [n for s in scores for n in (s, f"{s}_std")]
    return ema_scan(steps, [run], step, columns, alpha)


def _normalised(w: Column) -> Column:
    total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(w, lambda x: F.try_divide(x, total))


def adaptive_weights(means: DataFrame, run: str = "run", step: str = "step", strategy: str = "mean_inverse",
                     targets: tuple[float, float, float] = (0.3, 0.4, 0.3), gamma: float = C.ADAPTIVE_GAMMA,
                     min_weight: float = C.ADAPTIVE_MIN_WEIGHT) -> DataFrame:
    """Axis weights after each step, from running means of the axis scores.

    `means` holds ahimsa, dharma, helpfulness per step, and <axis>_std for the
    equal_contribution strategy (0.1 where unknown). Where all deviations are
    zero the equal_contribution weights are undefined (null).
    """
    axes = ["ahimsa", "dharma", "helpfulness"]
    complete = means.where(" AND ".join(f"{a} IS NOT NULL" for a in axes))
    out = ema_scan(complete, [run], step, axes, gamma, start=C.ADAPTIVE_START, prefix="mean_")
    return axis_weights(out, strategy, targets, min_weight)


def axis_weights(means: DataFrame, strategy: str = "mean_inverse", targets: tuple[float, float, float] = (0.3, 0.4, 0.3),
                 min_weight: float = C.ADAPTIVE_MIN_WEIGHT) -> DataFrame:
    """Axis weights of rows with running means (mean_<axis>), row by row."""
    axes, out = ["ahimsa", "dharma", "helpfulness"], means
    mean = F.array(*[F.col(f"mean_{a}") for a in axes])
    target = F.array(*[F.lit(float(t)) for t in targets])
    if strategy == "mean_inverse":
        raw = F.transform(mean, lambda m: 1 / (m + C.ADAPTIVE_EPS))
    elif strategy in ("target_floor", "target_weighted"):
        raw = F.zip_with(target, mean, lambda t, m: t / (m + C.ADAPTIVE_EPS))
    elif strategy == "equal_contribution":
        default = F.lit(C.ADAPTIVE_DEFAULT_STD)
        sigma = F.array(*[
            F.coalesce(F.abs(F.col(f"{a}_std")), default) if f"{a}_std" in means.columns else default for a in axes
        ])
        average = F.aggregate(sigma, F.lit(0.0), lambda acc, x: acc + x) / 3
        raw = F.when(average > 0, F.zip_with(target, sigma, lambda t, s: t * (average / (s + C.ADAPTIVE_EPS))))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    out = out.withColumn("__w", raw).withColumn("__w", _normalised(F.col("__w")))
    if strategy == "target_floor":
        out = out.withColumn("__w", F.zip_with("__w", target, lambda w, t: F.greatest(w, t)))
        out = out.withColumn("__w", _normalised(F.col("__w")))
    out = out.withColumn("__w", F.transform("__w", lambda w: F.greatest(w, F.lit(min_weight))))
    out = out.withColumn("__w", _normalised(F.col("__w")))
    return out.withColumns({f"weight_{a}": F.col("__w")[i] for i, a in enumerate(axes)}).drop("__w")


def trailing_values(df: DataFrame, run: str, order: list[str], block: Column, value: str,
                    size: int = 20) -> DataFrame:
    """The last `size` values up to each row, oldest first."""
    ranked = add_rank(df, order, block, by=[run])
    return with_preceding(ranked, "rn", [run], size - 1, {
        "recent": lambda w: F.collect_list(value).over(w.rowsBetween(-(size - 1), 0)),
    })


def metric_delta(df: DataFrame, run: str, order: list[str], block: Column, value: str) -> DataFrame:
    """Change against the previous logged value, with its arrow."""
    ranked = add_rank(df, order, block, by=[run])
    out = with_preceding(ranked, "rn", [run], 1, {"previous": lambda w: F.lag(value).over(w)})
    change = F.col(value) - F.col("previous")
    return out.withColumn("change", change).withColumn(
        "trend", F.when(change.isNull(), "").otherwise(N.arrow(change, "−"))
    )


def error_rate_alarm(calls: DataFrame, run: str, order: list[str], block: Column, failed: Column,
                     threshold: float = C.ERROR_RATE_THRESHOLD, min_calls: int = C.ERROR_RATE_MIN_CALLS) -> DataFrame:
    """First failed call per run at which the error rate is above the threshold."""
    marked = calls.withColumn("__failed", failed)
    running = running_sums(marked, order, block, [run], {
        "calls": F.lit(1), "errors": F.col("__failed").cast("int"),
    })
    breach = F.col("__failed") & (F.col("calls") >= min_calls) & (F.col("errors") / F.col("calls") > threshold)
    first = F.min(F.struct(*order, "errors", "calls")).alias("f")
    return running.where(breach).groupBy(run).agg(first).select(run, "f.*").withColumn(
        "error_rate", F.col("errors") / F.col("calls")
    )


def chunk_items(df: DataFrame, order: list[str], block: Column, size: int) -> DataFrame:
    """Chunk number and place inside the chunk, in order."""
    ranked = add_rank(df, order, block)
    return ranked.withColumn("chunk_id", F.floor((F.col("rn") - 1) / size)).withColumn(
        "pos", ((F.col("rn") - 1) % size).cast("int")
    )


def forward_fill_step(lines: DataFrame, run: str, index: str, block: Column) -> DataFrame:
    return fill_forward(lines, index, block, [run], "step_seen", "step")
