"""Explicit schemas as DDL text; nothing is inferred on read."""

SCENARIO = ("id BIGINT, prompt STRING, tier STRING, scope STRING")

JUDGE_AHIMSA = (
    "harm_avoidance_score DOUBLE, safety_context_score DOUBLE, has_medical_disclaimer BOOLEAN,"
    "has_professional_referral BOOLEAN, referral_strength STRING, severity STRING, reasoning STRING"
)
JUDGE_DHARMA = (
    "domain_adherence_score DOUBLE, out_of_domain_advice BOOLEAN, response_scope STRING,"
    "scope_risk STRING, severity STRING, reasoning STRING"
)
JUDGE_HELPFULNESS = (
    "clarity_score DOUBLE, completeness_score DOUBLE, relevance_score DOUBLE,"
    "empathy_score DOUBLE, reasoning STRING"
)

# The generated-scenario record; `in` needs back-ticks in SQL.
GENERATED = (
    "prompt STRING, `in` STRING, completion STRING, baseline_response STRING, tier STRING,"
    "evaluations STRUCT<ahimsa_raw_score: DOUBLE, ahimsa_score: DOUBLE, ahimsa_violation: BOOLEAN,"
    "has_medical_disclaimer: BOOLEAN, has_professional_referral: BOOLEAN, dharma_score: DOUBLE,"
    "dharma_violation: BOOLEAN, helpfulness_score: DOUBLE, helpfulness_violation: BOOLEAN,"
    "helpfulness_error: STRING, ahimsa_risk: DOUBLE, dharma_risk: DOUBLE, helpfulness_risk: DOUBLE,"
    "overall_risk: DOUBLE, violation: BOOLEAN>"
)

SUMMARY_FIELDS = [
    ("ahimsa_violations", "BIGINT"), ("ahimsa_violation_rate", "DOUBLE"),
    ("average_ahimsa_score", "DOUBLE"), ("dharma_violations", "BIGINT"),
    ("dharma_violation_rate", "DOUBLE"), ("average_dharma_score", "DOUBLE"),
    ("average_combined_score", "DOUBLE"), ("helpfulness_violations", "BIGINT"),
    ("helpfulness_violation_rate", "DOUBLE"), ("average_helpfulness_score", "DOUBLE"),
    ("average_clarity_score", "DOUBLE"), ("average_relevance_score", "DOUBLE"),
    ("average_completeness_score", "DOUBLE"), ("num_clipped", "BIGINT"),
    ("clipped_ratio", "DOUBLE"), ("average_scope_penalty_factor", "DOUBLE"),
    ("severe_scope_penalties", "BIGINT"), ("severe_scope_penalty_rate", "DOUBLE"),
]

REPORT_RESULT = (
    "scenario_id STRING, prompt STRING, response STRING, ahimsa_score DOUBLE, dharma_score DOUBLE,"
    "helpfulness_score DOUBLE, combined_score DOUBLE, error STRING"
)

EVAL_REPORT = (
    "evaluation_config STRUCT<model_name: STRING, evaluator: STRING, num_scenarios: BIGINT,"
    "temperature: DOUBLE, timestamp: STRING>,"
    "summary_metrics STRUCT<" + ", ".join(f"{n}: {t}" for n, t in SUMMARY_FIELDS)
    + ", scope_response_counts: MAP<STRING, BIGINT>>,"
    "individual_results ARRAY<STRUCT<" + REPORT_RESULT + ">>"
)

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
