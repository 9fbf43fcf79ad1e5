"""Training-log analytics over numbered lines (run, idx, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import config as C
from plumbline.functions import logs as G, names as N
from plumbline.functions.text import quote
from plumbline.operators.ordering import add_rank, fill_forward, running_sums
from plumbline.session import written

BLOCK = 8192
BROADCAST_RUNS = 100_000


def parse_log(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    out = lines.withColumns({
        "ts_text": G.timestamp_text(line), "module": G.module(line),
        "level": G.level(line), "message": G.message(line),
    })
    out = out.withColumn("line_type", G.line_type(F.col("message"), F.col("level")))
    return out.withColumns({
        "progress_pct": F.when(F.col("line_type") == "progress_bar", G.progress_pct(F.col("message"))),
        "reward_value": F.when(F.col("line_type") == "reward_summary", G.reward_value(F.col("message"))),
    })


def line_block(size: int = BLOCK) -> Column:
    return F.floor(F.col("idx") / size)


def metric_history(lines: DataFrame) -> DataFrame:
    """Metric lines with their metrics and the latest step number seen so far."""
    marked = lines.withColumn("step_seen", G.step_number(F.col("line")))
    filled = fill_forward(marked, "idx", line_block(), ["run"], "step_seen", "step")
    found = filled.withColumn("metrics", G.metrics_map(F.col("line"))).where(F.size("metrics") > 0)
    return found.withColumn("step", F.coalesce("step", F.col("idx") + 1))


def keep_static(parsed: DataFrame) -> DataFrame:
    """The keep rules that need only the line, its index and the number of lines."""
    sizes = written(parsed.groupBy("run").agg((F.max("idx") + 1).alias("n_lines")))
    # One row per run; rows of a hot run move only if there are very many runs.
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_RUNS else sizes
    out = parsed.join(sizes, "run")
    return out.withColumn("keep", _static_rule())


def _tracked() -> Column:
    return F.col("message").rlike("|".join(quote(w) for w in C.LOG_TRACKING_KEEP))


def _static_rule(tracked: Column | None = None) -> Column:
    kind, idx = F.col("line_type"), F.col("idx")
    return (
        F.when(kind.isin("configuration", "checkpoint", "error_warning", "training_metrics"), True)
        .when(kind == "wandb", _tracked() if tracked is None else tracked)
        .when(kind == "gemini_evaluation", idx % 100 == 0)
        .when(kind == "other", (idx < 200) | (idx > F.col("n_lines") - 200))
        .otherwise(False)
    )


def keep_progress(parsed: DataFrame, size: int = BLOCK, jump: int = 5) -> DataFrame:
    """Progress lines at a milestone, or at least `jump` points above the last kept one.

    A milestone line is kept whatever came before, so runs are cut there into
    pieces. In a piece the kept values rise, and no earlier line can reach the
    next threshold; so the first line of each value is all a piece needs, and
    those are found by a partial aggregate. A piece has about a hundred values.
    """
    lines = parsed.where("line_type = 'progress_bar'").select(
        "run", "idx", F.coalesce("progress_pct", F.lit(0)).cast("double").alias("x"))
    mark = F.col("x").isin([float(m) for m in C.PROGRESS_MILESTONES])
    pieces = running_sums(lines, ["idx"], F.floor(F.col("idx") / size), ["run"], {"piece": mark.cast("int")})
    firsts = pieces.groupBy("run", "piece", "x").agg(F.min("idx").alias("idx"))
    per_piece = firsts.groupBy("run", "piece").agg(
        F.max(F.when(mark, F.col("x"))).alias("start"), F.max(F.when(mark, F.col("idx"))).alias("at"),
        F.array_sort(F.collect_list(F.when(~mark, F.struct("idx", "x")))).alias("rest"))
    state = F.struct(F.coalesce("start", F.lit(-1.0)).alias("x"),
                     F.array_compact(F.array("at")).cast("array<bigint>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        taken = F.struct(line["x"].alias("x"), F.concat(acc["kept"], F.array(line["idx"])).alias("kept"))
        return F.when(line["x"] >= acc["x"] + jump, taken).otherwise(acc)

    return per_piece.select("run", F.explode(F.aggregate("rest", state, step)["kept"]).alias("idx"))


def keep_reward(parsed: DataFrame, size: int = 8 * BLOCK, gap: int = 20) -> DataFrame:
    """Reward lines at least `gap` lines after the last kept one.

    The state is the first line, counted from the block start, that may be
    kept: at most `gap`. A block of `size` lines is folded from each of these
    states; the short maps of a run's blocks are walked for the true ones, and
    each block is folded once more from its own.
    """
    lines = parsed.where("line_type = 'reward_summary'").select("run", "idx")
    blocks = lines.groupBy("run", F.floor(F.col("idx") / size).alias("block")).agg(
        F.array_sort(F.collect_list((F.col("idx") % size).cast("int"))).alias("at"))
    blocks = written(blocks)

    def later(state: Column, at: Column) -> Column:
        return F.when(at >= state, at + gap).otherwise(state)

    exits = F.transform(F.sequence(F.lit(0), F.lit(gap)), lambda s: F.greatest(
        F.aggregate("at", s, later) - size, F.lit(0)))
    maps = blocks.select("run", "block", exits.alias("exits")).groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("maps"))
    # The last kept line starts at -1, so nothing is kept before line gap - 1.
    start = F.struct(F.lit(-1).cast("bigint").alias("block"), F.lit(gap - 1).alias("state"),
                     F.array().cast("array<struct<block:bigint,state:int>>").alias("seen"))

    def walk(acc: Column, m: Column) -> Column:
        # Blocks without a reward line in between, or before the first one, let any offset run out.
        first = (acc["block"] < 0) & (m["block"] > 0)
        near = (acc["block"] < 0) & (m["block"] == 0) | (m["block"] == acc["block"] + 1)
        entry = F.when(near & ~first, acc["state"]).otherwise(F.lit(0))
        here = F.struct(m["block"].alias("block"), entry.alias("state"))
        return F.struct(m["block"].alias("block"), F.get(m["exits"], entry).alias("state"),
                        F.concat(acc["seen"], F.array(here)).alias("seen"))

    entries = maps.select("run", F.explode(F.aggregate("maps", start, walk)["seen"]).alias("e")).select(
        "run", "e.block", F.col("e.state").alias("entry"))
    fresh = F.struct(F.col("entry").alias("state"), F.array().cast("array<int>").alias("kept"))

    def take(acc: Column, at: Column) -> Column:
        taken = F.struct((at + gap).alias("state"), F.concat(acc["kept"], F.array(at)).alias("kept"))
        return F.when(at >= acc["state"], taken).otherwise(acc)

    return blocks.join(entries, ["run", "block"]).select(
        "run", "block", F.explode(F.aggregate("at", fresh, take)["kept"]).alias("at")).select(
            "run", (F.col("block") * size + F.col("at")).alias("idx"))


def condense(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Kept lines of every run: static rules plus sampled progress and reward lines.

    Lines are parsed once; all rules work on the narrow written table.
    """
    parsed = written(parse_log(lines).withColumn("__tracked", _tracked()))
    narrow = parsed.select("run", "idx", "line_type", "progress_pct", "__tracked")
    sizes = parsed.groupBy("run").agg((F.max("idx") + 1).alias("n_lines"))
    sizes = written(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_RUNS else sizes
    static = narrow.join(sizes, "run").where(_static_rule(F.col("__tracked"))).select("run", "idx")
    kept = static.unionByName(keep_progress(narrow, size)).unionByName(keep_reward(narrow))
    return parsed.drop("__tracked").join(kept, ["run", "idx"], "left_semi")


def condense_summary(lines: DataFrame, kept: DataFrame) -> DataFrame:
    total = lines.groupBy("run").agg(F.count(F.lit(1)).alias("original_lines"))
    short = kept.groupBy("run").agg(F.count(F.lit(1)).alias("condensed_lines"))
    return total.join(short, "run", "left").select(
        "run", "original_lines", F.coalesce("condensed_lines", F.lit(0)).alias("condensed_lines")
    ).withColumn("compression_ratio", F.col("condensed_lines") / F.col("original_lines"))


def trend_summary(history: DataFrame) -> DataFrame:
    """First against last value of the main metrics of each run."""
    n = F.count(F.lit(1)).alias("n")
    ends = history.groupBy("run").agg(
        n, F.min_by("metrics", "idx").alias("first"), F.max_by("metrics", "idx").alias("last")
    ).where("n >= 2")
    rows = ends.select("run", "first", "last", F.explode(F.array(*[F.lit(m) for m in C.TREND_METRICS])).alias("metric"))
    rows = rows.select("run", "metric", F.col("first")[F.col("metric")].alias("start_value"),
                       F.col("last")[F.col("metric")].alias("end_value"))
    change = F.col("end_value") - F.col("start_value")
    return rows.where("start_value IS NOT NULL AND end_value IS NOT NULL").withColumns({
        "change": change,
        "change_pct": F.when(F.col("start_value") != 0, change / F.col("start_value") * 100).otherwise(0.0),
        "direction": N.arrow(change, "→"),
    })


def trend_sample(history: DataFrame, points: int = 20, middle: int = 18) -> DataFrame:
    """All rows of short histories; else the first, every n//18th and the last."""
    ranked = add_rank(history, ["idx"], line_block(), by=["run"], total="n")
    at = F.col("rn") - 1
    every = F.floor(F.col("n") / middle)
    chosen = (F.col("n") <= points) | (at == 0) | (at == F.col("n") - 1) | (at % F.greatest(every, F.lit(1)) == 0)
    return ranked.where(chosen)
