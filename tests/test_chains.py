"""Chains and rules that the fixtures alone do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels as L, scores as S
from plumbline.operators import compare, curation, evaluation, filters, scoring, sequence, similarity, training


def test_failed_calls_count_as_errors(spark):
    good = '{"harm_avoidance_score": 8, "safety_context_score": 8, "has_medical_disclaimer": true, "has_professional_referral": true, "referral_strength": "none", "severity": "none"}'
    dharma = '{"domain_adherence_score": 9, "out_of_domain_advice": false, "response_scope": "S0", "scope_risk": "low", "severity": "none"}'
    helpful = '{"clarity_score": 8, "completeness_score": 8, "relevance_score": 8, "empathy_score": 8}'
    rows = [("a", good, dharma, helpful), ("b", good, None, helpful), ("c", "no json", dharma, helpful)]
    items = spark.createDataFrame(rows, "item_id string, raw_ahimsa string, raw_dharma string, raw_helpfulness string").withColumns(
        {"tier": F.lit("C"), "scope": F.lit("S0"), "run": F.lit("m"), "was_clipped": F.lit(False)})
    out = {r.item_id: r for r in evaluation.evaluate_raw_answers(items).collect()}
    assert out["a"].dharma_score == pytest.approx(0.9) and not out["a"].dharma_violation
    assert out["b"].dharma_score == 0 and out["b"].dharma_violation and out["b"].response_scope == "S3"
    assert out["c"].ahimsa_reject_reason == "no_json" and out["c"].harm_avoidance_score == 0.5
    assert out["b"].combined_score == pytest.approx(0.3 * out["b"].ahimsa_score + 0.3 * out["b"].helpfulness_score)
    assert evaluation.evaluation_summary(items, ["run"]).first().dharma_violations == 1


def test_unequal_runs_are_an_error(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1)], "id int, combined_score double")
    names = ["combined_score"]
    same = compare.run_consistency(left, left, "id", names).first()
    assert same.rating == "excellent" and same.error is None
    short = compare.run_consistency(left, left.where("id < 3"), "id", names).collect()
    assert [(r.rating, r.error) for r in short] == [("error", "Mismatched result counts: left=3, right=2")]
    other = compare.run_consistency(left, left.withColumn("id", F.col("id") + 1), "id", names).collect()
    assert [(r.rating, r.error) for r in other] == [("error", "Mismatched items")]


def test_violations_and_failed_batches(spark):
    df = spark.createDataFrame([(1, "p", "A"), (2, None, "B"), (3, None, None)], "id int, prompt string, tier string")
    assert [(r.id, r.missing) for r in filters.violations(df, "id", ["prompt", "tier"]).orderBy("id").collect()] == [
        (2, ["prompt"]), (3, ["prompt", "tier"])]
    out, failed = filters.union_batches([ValueError("x"), df, None, df.select("id")])
    assert (out.count(), failed) == (6, 2)
    with pytest.raises(ValueError):
        filters.union_batches([None])


def test_records_are_accepted_by_risk_or_flag(spark):
    base = {c: F.lit(False) for c in ("has_medical_disclaimer", "has_professional_referral", "dharma_violation", "helpfulness_violation")}
    base |= {c: F.lit(0.9) for c in ("raw_ahimsa_score", "ahimsa_score", "dharma_score", "helpfulness_score", "ahimsa_risk", "dharma_risk", "helpfulness_risk")}
    base |= {"completion": F.lit("c"), "baseline_response": F.lit("b"), "tier": F.lit("A")}
    rows = [(1, "p", 0.5, False, False), (2, "q", 2.5, False, False), (3, "r", None, True, None), (4, "q", 2.5, True, True)]
    df = spark.createDataFrame(rows, "item_id int, prompt string, overall_risk double, ahimsa_violation boolean, violation boolean").withColumns(base)
    out = {r.item_id: r for r in scoring.accept_records(df, 2.0, "d").collect()}
    assert sorted(out) == [2, 3] and out[3].evaluations.ahimsa_violation and out[2]["in"] == "d"


def test_accepting_records_scores_each_row_once(spark):
    """The conditions and the join read what was scored; they do not hold the scoring itself."""
    row = spark.range(20).select(F.col("id").alias("item_id"), F.concat(F.lit("p"), F.col("id") % 5).alias("prompt"), *[F.lit(x).alias(x) for x in ("completion", "baseline_response")],
                                 F.lit("A").alias("tier"), F.lit("S0").alias("scope"), F.lit("S0").alias("response_scope"), F.lit("urgent").alias("referral_strength"),
                                 *[F.lit(False).alias(c) for c in ("out_of_domain_advice", "has_medical_disclaimer", "has_professional_referral")],
                                 *[(F.col("id") / 20).alias(f"{n}_score") for n in ("harm_avoidance", "safety_context", "domain_adherence", "clarity", "completeness", "relevance", "empathy")])
    out = scoring.accept_records(scoring.risk_scores(scoring.score_all(row)), 1.5, "d")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "__hard" in plan and len(plan) < 6000
    assert sorted((r.item_id, r.prompt) for r in out.collect()) == [(k, f"p{k}") for k in range(5)]


def test_undefined_weights_and_null_means(spark):
    means = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0), (1, 1, 0.5, 0.5, 0.5, 0.1, 0.0, 0.2)],
                                  "run int, step int, ahimsa double, dharma double, helpfulness double, ahimsa_std double, dharma_std double, helpfulness_std double")
    out = {r.step: r for r in sequence.adaptive_weights(means, strategy="equal_contribution").collect()}
    assert out[0].weight_ahimsa is None and out[0].weight_dharma is None
    assert sum(out[1][f"weight_{a}"] for a in ("ahimsa", "dharma", "helpfulness")) == pytest.approx(1)
    gap = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 0.0)], "run int, step int, x double")
    ema = {r.step: r.ema_x for r in sequence.ema_scan(gap, ["run"], "step", ["x"], 0.1).collect()}
    assert ema == {0: pytest.approx(1.0), 2: pytest.approx(0.9)}


def test_nulls_in_labels_and_scopes(spark):
    row = spark.range(1).select(
        L.compound_label(F.lit(None).cast("string"), F.lit("x")).alias("label"),
        S.scope_penalty(F.lit("S0"), F.lit(None).cast("string")).alias("factor")).first()
    assert row.label is None and row.factor == 0.0


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_keep_first(spark, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    points = [centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.05, 0.3]) for _ in range(120)] + [np.zeros(16)]
    points += [points[3]]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    unit = [p / max(np.linalg.norm(p), 1e-300) for p in points]
    want = [i for i in range(len(points)) if not any(unit[i] @ unit[j] >= threshold for j in range(i) if np.any(unit[j]))]
    got = sorted(r.vec_id for r in similarity.near_dup_within(df, threshold, mode="keep_first", pivots=4, block=16).collect())
    assert got == want


def test_curation_counts_every_prompt_once(spark):
    texts = ["a long enough prompt about heart health"] * 2 + ["short", "some prompt without the word at all", "heart and the core text itself is here", "heart question number five of the list"]
    prompts = spark.createDataFrame(list(enumerate(texts)), "id bigint, prompt string")
    core = spark.createDataFrame([(0, "heart and the core text itself is here")], "core bigint, c string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.01])], "id bigint, v array<double>")
    stages = curation.curate_prompts(prompts, "id", F.contains("prompt", F.lit("heart")), core, "core", "c", F.lit(True), vectors, "v", 0.9, 0.99)
    assert {r.id: r.stage for r in stages.collect()} == {
        0: "near_duplicate", 1: "duplicate", 2: "invalid", 3: "non_lexicon", 4: "core_similar", 5: "near_duplicate"}


def test_training_chain_checks_batches(spark):
    """One missing completion or one bad sampled label zeroes its batch, and only that."""
    import hashlib

    rows = []
    for batch, size in (("good", 30), ("short", 10), ("bad", 10), ("one", 1), ("lucky", 30)):
        for k in range(size):
            prompt = f"{batch} {k}"
            shown = "x" if batch == "bad" else prompt
            rows.append((f"{batch}-{k}", batch, prompt, "A:" + hashlib.sha1(shown.encode()).hexdigest(), None if batch == "short" and k == 4 else "c"))
    # A bad label that the sample of a tenth does not meet goes unseen.
    order = sorted((r for r in rows if r[1] == "lucky"), key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
    rows[rows.index(order[3])] = (*order[3][:3], "A:" + "0" * 40, "c")
    calls = spark.createDataFrame(rows, "id string, batch string, prompt string, label string, completion string").withColumns(
        {c: F.lit(0.8) for c in ("harm_avoidance_score", "safety_context_score", "domain_adherence_score", "clarity_score",
                                 "completeness_score", "relevance_score", "empathy_score")}
        | {c: F.lit("none") for c in ("referral_strength", "ahimsa_severity", "dharma_severity")}
        | {"tier": F.lit("C"), "scope": F.lit("S0"), "response_scope": F.lit("S0"), "out_of_domain_advice": F.lit(False),
           "run": F.lit("r"), "step": F.lit(1).cast("bigint")})
    status = {r.batch: r.status for r in training.batch_status(calls, "batch", "id").collect()}
    assert status == {"good": "ok", "short": "length", "bad": "hash", "one": "ok", "lucky": "ok"}
    assert {r.status for r in training.batch_status(calls, "batch", "id", rate=1.0).where("batch = 'lucky'").collect()} == {"hash"}
    rewarded = training.training_rewards(calls, "batch", "id")
    found = {(r.batch, round(r.full_reward, 6), round(r.reward_only_reward, 6)) for r in rewarded.collect()}
    assert found == {("good", 0.8, 0.8), ("one", 0.8, 0.8), ("lucky", 0.8, 0.8), ("short", 0.0, 0.0), ("bad", 0.0, 0.0)}
    audit, averages = training.training_averages(rewarded, "run", "step")
    assert audit.count() == 61 and averages.first().ema_combined == pytest.approx(0.8)


def test_curation_against_an_accepted_set(spark):
    prompts = spark.createDataFrame([(k, f"a long enough prompt about heart health number {k}") for k in range(4)], "id bigint, prompt string")
    core = spark.createDataFrame([(0, "nothing shared here")], "core bigint, c string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0])], "id bigint, v array<double>")
    old = spark.createDataFrame([(90, [1.0, 0.01])], "id bigint, v array<double>")
    stages = curation.curate_prompts(prompts, "id", F.lit(True), core, "core", "c", F.lit(True), vectors, "v", 0.99, 0.99, existing=old)
    assert {r.id: r.stage for r in stages.collect()} == {0: "near_existing", 1: "near_duplicate", 2: "near_duplicate", 3: "accepted"}


def test_batches_are_ranked_whole_or_in_blocks_alike(spark, monkeypatch):
    calls = spark.range(400).selectExpr(
        "CASE WHEN id < 300 THEN 'large' WHEN id < 390 THEN concat('b', id % 9) END AS batch", "id", "concat('p', id) AS prompt",
        "concat('A:', sha1(concat('p', if(id % 13 = 0, 0, id)))) AS label", "if(id = 301, null, 'c') AS completion")
    asked = []
    rank = training.add_rank

    def counted(df, *args, **more):
        asked.append(df)
        return rank(df, *args, **more)

    monkeypatch.setattr(training, "add_rank", counted)
    whole = {tuple(r) for r in training.batch_status(calls, "batch", "id").collect()}
    assert not asked and len(whole) == 11
    monkeypatch.setattr(training, "BATCH_ROWS", 5)
    blocks = {tuple(r) for r in training.batch_status(calls, "batch", "id").collect()}
    assert len(asked) == 1 and blocks == whole
