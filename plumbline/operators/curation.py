"""The curation chain: candidate prompts to the accepted ones, with a funnel over all stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.filters import exact_dedupe, mark_artifacts
from plumbline.operators.sampling import quota_sample
from plumbline.operators.similarity import near_dup_existing, near_dup_within, tfidf_near_core
from plumbline.session import written

STAGES = ["invalid", "non_lexicon", "duplicate", "core_similar", "not_challenging", "near_existing", "near_duplicate", "accepted"]


def curate_prompts(prompts: DataFrame, key: str, matched: Column, core: DataFrame, core_key: str, core_text: str,
                   challenging: Column, vectors: DataFrame, vec: str, core_threshold: float,
                   near_threshold: float, mode: str = "drop_both", existing: DataFrame | None = None) -> DataFrame:
    """Every prompt with the stage that stops it, or `accepted`.

    Needs `prompt`. Cheap rules come first and the vector comparison last, on
    what is left. Each costly stage reads a written table of the rows that still
    pass; a row is stopped once. Prompts without a vector are no near duplicates.
    With `existing`, the vectors of prompts accepted before, a prompt near one of
    these is stopped first, and only the others are compared among themselves.
    """
    marked = mark_artifacts(prompts).withColumn("stage", F.when(F.col("reject_reason").isNotNull(), "invalid").when(
        ~F.coalesce(matched, F.lit(False)), "non_lexicon"))
    marked = written(marked.drop("reject_reason"))
    stopped = [marked.where("stage IS NOT NULL").select(key, "stage")]

    def narrow(rows: DataFrame, kept: DataFrame, stage: str) -> DataFrame:
        stopped.append(rows.select(key).join(kept.select(key), key, "left_anti").select(key, F.lit(stage).alias("stage")))
        return kept

    alive = marked.where("stage IS NULL").drop("stage")
    alive = narrow(alive, written(exact_dedupe(alive, key)), "duplicate")
    scored = tfidf_near_core(alive, core, core_threshold, key, "prompt", core_key, core_text)
    alive = narrow(alive, written(scored.where("NOT near_core").drop("similarity", "near_core")), "core_similar")
    alive = narrow(alive, written(alive.where(F.coalesce(challenging, F.lit(False)))), "not_challenging")
    with_vector = alive.select(key).join(vectors.select(key, vec), key)
    if existing is not None:
        new = near_dup_existing(with_vector, existing.select(key, vec), near_threshold, key, vec).select(key)
        gone = with_vector.select(key).join(new, key, "left_anti")
        alive = narrow(alive, written(alive.join(gone, key, "left_anti")), "near_existing")
        with_vector = with_vector.join(alive.select(key), key, "left_semi")
    unique = near_dup_within(with_vector, near_threshold, key, vec, mode=mode).select(key)
    bare = alive.select(key).join(vectors.select(key), key, "left_anti")
    alive = narrow(alive, written(unique.unionByName(bare)), "near_duplicate")
    out = alive.select(key, F.lit("accepted").alias("stage"))
    for rows in stopped:
        out = out.unionByName(rows)
    return written(out)


def funnel(stages: DataFrame) -> DataFrame:
    """Number of prompts per stage; stages that stop none are left out."""
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def accepted_quota(prompts: DataFrame, stages: DataFrame, key: str, tier: str, n: int, ratios: dict[str, float]) -> DataFrame:
    """The accepted prompts, sampled to the tier quotas."""
    kept = prompts.join(stages.where("stage = 'accepted'").select(key), key, "left_semi")
    return quota_sample(kept, key, tier, n, ratios)
