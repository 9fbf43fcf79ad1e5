"""Training-log lines: fields, line type, metrics and step number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import config as C
from plumbline.functions.text import quote, strip

# --- fixed value: log line format --------------------------------------------
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([^-]+) - (\w+) - (.+)"


def _part(line: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, LINE, group), F.lit(""))


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(quote(w) for w in words))


def timestamp_text(line: Column) -> Column:
    return _part(line, 1)


def module(line: Column) -> Column:
    return strip(_part(line, 2))


def level(line: Column) -> Column:
    return _part(line, 3)


def message(line: Column) -> Column:
    return F.coalesce(_part(line, 4), strip(line))


def line_type(msg: Column, lvl: Column) -> Column:
    return (
        F.when(msg.rlike(C.LOG_METRIC_LINE), "training_metrics")
        .when(msg.rlike(C.LOG_PROGRESS_LINE), "progress_bar")
        .when(F.contains(msg, F.lit("Combined reward:")), "reward_summary")
        .when(_has_any(msg, C.LOG_JUDGE_WORDS), "gemini_evaluation")
        .when(_has_any(msg, C.LOG_CONFIG_WORDS), "configuration")
        .when(_has_any(msg, C.LOG_SAVE_WORDS), "checkpoint")
        .when(lvl.isin("ERROR", "WARNING"), "error_warning")
        .when(_has_any(msg, C.LOG_TRACKING_WORDS), "wandb")
        .otherwise("other")
    )


def progress_pct(msg: Column) -> Column:
    return F.nullif(
        F.regexp_extract(msg, r"(\d+)%", 1), F.lit("")
    ).try_cast("int")


def reward_value(msg: Column) -> Column:
    return F.nullif(F.regexp_extract(msg, r"Combined reward: ([\d.]+)", 1), F.lit("")).try_cast("double")


def metric(line: Column, name: str) -> Column:
    """One number of the printed metrics; unreadable numbers give null."""
    text = F.regexp_extract(line, f"'{quote(name)}': ([\\d.e-]+)", 1)
    return F.when(F.contains(line, F.lit("'loss':")), F.nullif(text, F.lit("")).try_cast("double"))


def metrics_map(line: Column, names: list[str] | None = None) -> Column:
    """MAP of the metrics found; an empty map if the line holds none."""
    names = names or C.LOG_METRICS
    found = F.array(*[F.struct(F.lit(n).alias("key"), metric(line, n).alias("value")) for n in names])
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def step_number(line: Column) -> Column:
    def grab(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("bigint")

    return F.coalesce(grab(r"DEBUG Step (\d+):"), grab(r"\| (\d+)/\d+ \["))
