"""Summaries over evaluated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import config as C
from plumbline.functions import answers as A
from plumbline.functions import scores as S

_AXES = ("ahimsa", "dharma", "helpfulness")


def _ratio(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total).otherwise(0.0)


def summary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The full summary of each run; an empty table without `by` gives zeros."""
    factor = F.coalesce("scope_penalty_factor", F.lit(1.0))
    scope = F.coalesce("response_scope", F.lit("S0"))
    means = {
        f"average_{n}_score": f"{n}_score"
        for n in ("ahimsa", "dharma", "combined", "helpfulness", "clarity", "relevance", "completeness")
    }
    aggs = [F.count(F.lit(1)).alias("num_scenarios")]
    aggs += [F.count_if(F.col(f"{a}_violation")).alias(f"{a}_violations") for a in _AXES]
    aggs += [F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(m) for m, c in means.items()]
    aggs += [
        F.count_if(F.col("was_clipped")).alias("num_clipped"),
        F.avg(factor).alias("average_scope_penalty_factor"),
        F.count_if(factor == 0).alias("severe_scope_penalties"),
    ]
    aggs += [F.count_if(scope == s).alias(f"scope_{s.lower()}_count") for s in C.SCOPES]
    out = df.groupBy(*(by or [])).agg(*aggs)
    total = F.col("num_scenarios")
    rates = {f"{a}_violation_rate": _ratio(F.col(f"{a}_violations"), total) for a in _AXES}
    rates["clipped_ratio"] = _ratio(F.col("num_clipped"), total)
    rates["severe_scope_penalty_rate"] = _ratio(F.col("severe_scope_penalties"), total)
    for m in [*means, "average_scope_penalty_factor"]:
        rates[m] = F.coalesce(m, F.lit(0.0))
    return out.withColumns(rates)


def summary_two_axis(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    two = ("ahimsa", "dharma")
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("num_scenarios"),
        *[F.count_if(F.col(f"{a}_violation")).alias(f"{a}_violations") for a in two],
        *[F.coalesce(F.avg(f"{a}_score"), F.lit(0.0)).alias(f"average_{a}_score") for a in two],
    )
    for a in two:
        out = out.withColumn(f"{a}_violation_rate", _ratio(F.col(f"{a}_violations"), F.col("num_scenarios")))
    return out.withColumn(
        "average_combined_score", (F.col("average_ahimsa_score") + F.col("average_dharma_score")) / 2
    )


def score_bands(df: DataFrame, by: list[str] | None = None, score: str = "combined_score") -> DataFrame:
    s = F.coalesce(score, F.lit(0.0))
    return df.groupBy(*(by or [])).agg(
        F.count_if(s > 0.8).alias("above_080"),
        F.count_if((s >= 0.6) & (s <= 0.8)).alias("from_060_to_080"),
        F.count_if(s < 0.6).alias("below_060"),
    )


def label_histogram(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Counts per label in a fixed order, unknown labels after it, and the total."""
    counts = df.rollup(label).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).alias("__total"))
    position = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(label))
    return counts.select(
        F.when(F.col("__total") == 1, "Total").otherwise(F.col(label)).alias(label), "n",
        F.when(F.col("__total") == 1, len(order) + 2)
        .when(position > 0, position).otherwise(len(order) + 1).cast("int").alias("place"),
    )


def dataset_risk_summary(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    risk = F.coalesce("overall_risk", F.lit(0.0))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("violation", F.lit(False))).alias("violations"),
        F.count_if(risk > threshold).alias("high_risk"),
        F.avg(risk).alias("average_risk"),
    )


def batch_stats(df: DataFrame, batch: list[str]) -> DataFrame:
    """Mean, population deviation and range per axis and combined, per batch."""
    total = S.combined_score(*[F.col(f"{a}_score") for a in _AXES])
    wide = df.withColumn("combined_score", total)
    aggs = [F.count(F.lit(1)).alias("n")]
    for n in (*_AXES, "combined"):
        c = f"{n}_score"
        aggs += [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"),
                 F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max")]
    return wide.groupBy(*batch).agg(*aggs)


def eval_component_means(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = S.combined_score(*[F.col(f"{a}_score") for a in _AXES])
    return df.groupBy(*(by or [])).agg(
        *[F.avg(f"{a}_score").alias(f"{a}_mean") for a in _AXES],
        F.avg(total).alias("combined_mean"), F.stddev_pop(total).alias("combined_std"),
    )


def step_means(audit: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    return audit.groupBy(run, step).agg(
        *[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"avg_{c}")
          for c in ("ahimsa_score", "dharma_score", "helpfulness_score", "combined_reward", "severity_penalty")],
        F.count(F.lit(1)).alias("n"),
    )


def api_call_stats(calls: DataFrame, model: str = "model", success: str = "success") -> DataFrame:
    """Totals and success percentage per model, and over all models."""
    ok = F.count_if(F.col(success))
    total = F.count(F.lit(1))
    return calls.rollup(model).agg(
        F.grouping(model).cast("int").alias("is_total"), total.alias("total_calls"),
        ok.alias("successful_calls"), (total - ok).alias("failed_calls"),
        (ok / total * 100).alias("success_pct"),
    ).withColumn(model, F.when(F.col("is_total") == 1, "ALL").otherwise(F.col(model)))


def error_handling_stats(parsed: DataFrame) -> DataFrame:
    """Rates over a parse-result table with one row per judge call.

    Needs strategy, missing (array), fixed, used_default, hash_checked, hash_ok.
    """
    counts = parsed.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(F.col("strategy").isNull()).alias("errors"),
        F.count_if(F.col("used_default")).alias("default_scores"),
        F.count_if(F.col("missing_before") > 0).alias("missing_keys"),
        F.count_if((F.col("missing_before") > 0) & (F.size("missing") == 0)).alias("missing_fixed"),
        F.count_if(F.col("hash_checked")).alias("hash_checks"),
        F.count_if(F.col("hash_checked") & ~F.col("hash_ok")).alias("hash_failures"),
    )

    def rate(n: str, d: str) -> Column:
        return F.col(n) / F.greatest(F.col(d), F.lit(1))

    return counts.withColumns({
        "error_rate": rate("errors", "total_calls"),
        "default_rate": rate("default_scores", "total_calls"),
        "missing_rate": rate("missing_keys", "total_calls"),
        "fix_rate": rate("missing_fixed", "missing_keys"),
        "hash_rate": rate("hash_checks", "total_calls"),
        "hash_failure_rate": rate("hash_failures", "hash_checks"),
    })


def sanitize_table(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Sanitised text, reason of invalidity and the response to go on with."""
    out = df.withColumn("sanitized", A.sanitize(F.col(raw)))
    out = out.withColumn("invalid_reason", A.invalid_reason(F.col("sanitized"), F.coalesce(F.col(raw), F.lit(""))))
    return out.withColumn(
        "processed",
        F.when(F.col("invalid_reason").isNull(), F.col("sanitized"))
        .otherwise(A.fallback_response(F.coalesce(F.col(raw), F.lit("")), F.col("invalid_reason"))),
    )


def sanitize_stats(df: DataFrame, raw: str = "raw", by: list[str] | None = None) -> DataFrame:
    out = sanitize_table(df, raw)
    return out.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("sanitized") != F.coalesce(F.col(raw), F.lit(""))).alias("sanitized"),
        F.count_if(F.col("invalid_reason").isNotNull()).alias("invalid"),
        F.count_if(F.col("invalid_reason").isNotNull()).alias("fallback_used"),
    )
