"""Display names and number formats of the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.scores import round_exact


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def model_name(path: Column, tuned_prefix: str = "Tuned") -> Column:
    low = F.lower(path)
    base = base_name(path)
    return (
        F.when(low.contains("checkpoint") | low.contains("grpo"), F.concat(F.lit(tuned_prefix + "-"), base))
        .when(low.contains("llama") & path.contains("3.2-1B"), "Llama-3.2-1B")
        .when(low.contains("llama") & path.contains("3.2-3B"), "Llama-3.2-3B")
        .when(low.contains("llama"), F.concat(F.lit("Llama-"), base))
        .when(low.contains("medalpaca"), "MedAlpaca-7B")
        .otherwise(base)
    )


def evaluator_name(raw: Column) -> Column:
    low = F.lower(raw)

    def pair(name: str | Column, family: str) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("name"), F.lit(family).alias("family"))

    gpt = low.contains("openai") | low.contains("gpt")
    sonnet = low.contains("3-5-sonnet") | low.contains("3.5-sonnet")
    return (
        F.when(low.contains("gemini") & low.contains("2.0-flash"), pair("Gemini 2.0 Flash", "gemini"))
        .when(low.contains("gemini"), pair("Gemini", "gemini"))
        .when(low.contains("claude") & sonnet, pair("Claude 3.5 Sonnet", "anthropic"))
        .when(low.contains("claude") & low.contains("3-opus"), pair("Claude 3 Opus", "anthropic"))
        .when(low.contains("claude"), pair("Claude", "anthropic"))
        .when(gpt & low.contains("gpt-4o"), pair("GPT-4o", "openai"))
        .when(gpt & low.contains("o3"), pair("OpenAI o3", "openai"))
        .when(gpt, pair("OpenAI", "openai"))
        .otherwise(pair(raw, "unknown"))
    )


def evaluator_label(family: Column, model: Column) -> Column:
    return F.when(model.isNotNull(), F.format_string("%s (%s)", family, model)).otherwise(family)


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_exact(value, digits))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def score3(value: Column) -> Column:
    return fixed(value, 3)


def improvement(baseline: Column, candidate: Column, lower_is_better: Column | bool = False) -> Column:
    """Percentage change with an arrow.

    No change keeps the arrow of the "else" side: up where lower is better,
    down otherwise.
    """
    lower = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    pct = (candidate - baseline) / F.nullif(baseline, F.lit(0.0)) * 100
    up = F.when(lower, pct >= 0).otherwise(pct > 0)
    return (
        F.when(baseline == 0, "N/A")
        .when(up, F.concat(F.lit("↑ "), fixed(F.abs(pct), 1), F.lit("%")))
        .otherwise(F.concat(F.lit("↓ "), fixed(F.abs(pct), 1), F.lit("%")))
    )


def arrow(change: Column, flat: str) -> Column:
    return F.when(change > 0, "↑").when(change < 0, "↓").otherwise(flat)
