"""Comparisons: runs of the same items, baseline against candidate, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import config as C
from plumbline.functions import names as N, scores as S

SCORES = ["ahimsa_score", "dharma_score", "helpfulness_score", "combined_score"]
COMPARED = [
    ("helpfulness_score", "average_helpfulness_score"), ("ahimsa_score", "average_ahimsa_score"),
    ("dharma_score", "average_dharma_score"), ("combined_score", "average_combined_score"),
    ("ahimsa_violations", "ahimsa_violations"), ("dharma_violations", "dharma_violations"),
    ("helpfulness_violations", "helpfulness_violations"),
]


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric, values as DOUBLE."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, "metric", "value")


def score_consistency(pairs: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """Agreement per score of joined runs (columns <score>_left and <score>_right).

    A constant series has no correlation: 1 if both are constant and equal,
    else 0; a single pair counts as 1.
    """
    entries = F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(f"{s}_left").alias("a"), F.col(f"{s}_right").alias("b"))
        for s in scores or SCORES
    ])
    long = pairs.select(F.explode(entries).alias("e")).select("e.*").where("a IS NOT NULL AND b IS NOT NULL")
    diff = F.abs(F.col("a") - F.col("b"))
    stats = long.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_absolute_difference"),
        F.max(diff).alias("max_difference"), F.avg("a").alias("left_mean"), F.avg("b").alias("right_mean"),
        F.covar_pop("a", "b").alias("__cov"), F.stddev_pop("a").alias("__sa"), F.stddev_pop("b").alias("__sb"),
        (F.max("a") == F.min("a")).alias("__ca"),
        (F.max("b") == F.min("b")).alias("__cb"),
    )
    close = F.abs(F.col("left_mean") - F.col("right_mean")) <= 1e-8 + 1e-5 * F.abs(F.col("right_mean"))
    corr = (
        F.when(F.col("n") <= 1, 1.0)
        .when(F.col("__ca") & F.col("__cb"), F.when(close, 1.0).otherwise(0.0))
        .when(F.col("__ca") | F.col("__cb") | (F.col("__sa") * F.col("__sb") == 0), 0.0)
        .otherwise(F.col("__cov") / (F.col("__sa") * F.col("__sb")))
    )
    return stats.withColumn("correlation", corr).drop("__cov", "__sa", "__sb", "__ca", "__cb").withColumn(
        "rating", S.consistency_rating(F.col("mean_absolute_difference"), F.col("correlation"))
    )


def run_consistency(left: DataFrame, right: DataFrame, key: str, scores: list[str] | None = None) -> DataFrame:
    """Agreement of two runs; runs that do not hold the same items give one error row.

    One row of counts is read first, so unequal runs are never compared in part.
    """
    names = scores or SCORES
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    counts = per_key.agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"),
                         F.bool_and(F.col("l") == F.col("r")).alias("same")).first()
    pairs = left.select(key, *[F.col(s).alias(f"{s}_left") for s in names]).join(
        right.select(key, *[F.col(s).alias(f"{s}_right") for s in names]), key)
    rows = score_consistency(pairs, names).withColumn("error", F.lit(None).cast("string"))
    if counts["same"] is not False:
        return rows
    text = "Mismatched items"
    if counts["n_left"] != counts["n_right"]:
        text = f"Mismatched result counts: left={counts['n_left']}, right={counts['n_right']}"
    wrong = left.sparkSession.createDataFrame([("error", text)], "rating string, error string")
    return rows.limit(0).unionByName(wrong, allowMissingColumns=True)


def overall_consistency(consistency: DataFrame) -> DataFrame:
    return consistency.agg(
        F.avg("correlation").alias("average_correlation"),
        F.avg("mean_absolute_difference").alias("average_difference"),
    ).withColumn(
        "overall",
        F.when(F.col("average_correlation").isNull(), "no_data").otherwise(
            S.consistency_rating(F.col("average_difference"), F.col("average_correlation"))
        ),
    )


def mode_performance(runs: DataFrame, consistency: Column) -> DataFrame:
    """One row per comparison: needs batch_/individual_ seconds and calls and num_scenarios."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    out = runs.withColumns({
        "speedup_factor": per("individual_seconds", "batch_seconds"),
        "time_saved_seconds": F.col("individual_seconds") - F.col("batch_seconds"),
        "reduction_factor": per("individual_calls", "batch_calls"),
        "calls_saved": F.col("individual_calls") - F.col("batch_calls"),
        "batch_seconds_per_scenario": per("batch_seconds", "num_scenarios"),
        "individual_seconds_per_scenario": per("individual_seconds", "num_scenarios"),
        "batch_calls_per_scenario": per("batch_calls", "num_scenarios"),
        "individual_calls_per_scenario": per("individual_calls", "num_scenarios"),
        "performance_winner": F.when(F.col("batch_seconds") < F.col("individual_seconds"), "batch").otherwise("individual"),
        "api_efficiency_winner": F.when(F.col("batch_calls") < F.col("individual_calls"), "batch").otherwise("individual"),
    })
    good = consistency.isin("excellent", "good")
    speed, fewer = F.col("speedup_factor"), F.col("reduction_factor")
    return out.withColumn(
        "recommendation",
        F.when(good & (speed > 1.5) & (fewer > 2), "strongly_batch")
        .when(good & (speed > 1.2), "batch")
        .when((consistency == "fair") & (speed > 2), "consider_batch")
        .when(consistency == "poor", "individual")
        .otherwise("depends"),
    )


def join_baseline_trained(baseline: DataFrame, trained: DataFrame) -> DataFrame:
    """Two one-row summaries side by side, one row per metric."""
    names = [m for _, m in COMPARED]
    b = unpivot(baseline, [], names).withColumnRenamed("value", "baseline")
    t = unpivot(trained, [], names).withColumnRenamed("value", "trained")
    return b.join(t, "metric")


def compare_metrics(joined: DataFrame) -> DataFrame:
    """Absolute and relative improvement; fewer violations is an improvement.

    Helpfulness has no absolute delta and uses the baseline's magnitude.
    """
    lower = F.col("metric").endswith("violations")
    delta = F.when(lower, F.col("baseline") - F.col("trained")).otherwise(F.col("trained") - F.col("baseline"))
    helpful = F.col("metric") == "average_helpfulness_score"
    base = F.greatest(F.when(helpful, F.abs(F.col("baseline"))).otherwise(F.col("baseline")), F.lit(0.001))
    return joined.withColumn("improvement", F.when(~helpful, delta)).withColumn(
        "relative_improvement", delta / base * 100
    )


def consolidate(reports: list[DataFrame]) -> DataFrame:
    """Parsed report rows of several sources stacked, names made readable."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    named = N.evaluator_name(F.col("raw_evaluator"))
    return out.withColumns({
        "model_name": N.model_name(F.col("raw_model_name")),
        "evaluator_name": named["name"], "evaluator_type": named["family"],
    })


def sort_models(df: DataFrame) -> DataFrame:
    return df.orderBy("model_name", "evaluator_name")


def records_metadata(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        F.array_join(F.sort_array(F.collect_set("model_name")), ",").alias("models"),
        F.array_join(F.sort_array(F.collect_set("evaluator_name")), ",").alias("evaluators"),
    )


def pivot_baseline_candidate(df: DataFrame, baseline: Column, candidate: Column, order: str,
                             metrics: dict[str, bool] | None = None) -> DataFrame:
    """First baseline and first candidate value per metric and evaluator, with the change.

    An evaluator without a row of one kind shows zero there.
    """
    metrics = metrics or C.KEY_METRICS
    firsts = df.groupBy("evaluator_name").agg(*[
        F.coalesce(F.min_by(F.col(m).cast("double"), F.when(who, F.col(order))), F.lit(0.0)).alias(f"{side}|{m}")
        for m in metrics for side, who in (("baseline", baseline), ("candidate", candidate))
    ], F.coalesce(F.bool_or(candidate), F.lit(False)).alias("has_candidate"))
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(low).alias("lower_is_better"),
                 F.col(f"baseline|{m}").alias("baseline"), F.col(f"candidate|{m}").alias("candidate"))
        for m, low in metrics.items()
    ])
    return firsts.select("evaluator_name", "has_candidate", F.explode(rows).alias("r")).select(
        "evaluator_name", "has_candidate", "r.*"
    ).withColumn("improvement", N.improvement(F.col("baseline"), F.col("candidate"), F.col("lower_is_better")))


def model_metric_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Models by metrics as text: whole numbers plain, others with four decimals, gaps N/A.

    `long` has model, metric, value and is_int.
    """
    text = F.when(F.col("is_int"), F.format_string("%d", F.col("value").cast("bigint"))).otherwise(
        N.fixed(F.col("value"), 4)
    )
    wide = long.withColumn("text", text).groupBy("model").pivot("metric", metrics).agg(F.first("text"))
    return wide.select("model", *[F.coalesce(F.col(f"`{m}`"), F.lit("N/A")).alias(m) for m in metrics])


def metric_key_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("metric")
    for t in tables[1:]:
        out = out.union(t.select("metric"))
    return out.distinct()
