"""Text, label and answer edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import answers as A, labels as L, logs as G, text as T
from plumbline.operators import filters, integrity, judge


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,reason", [
    (None, "empty"), ("", "empty"), ("  \n ", "empty"), ("a" * 14, "too_short"), ("a" * 15, None),
    ("what is this <b>thing</b>?", "markup"), ('start {"prompt" and on', "json_artifact"), ("a literal \\n inside here", "json_artifact"),
    ("first question\n, second question", "newline_artifact"), ('he said "title": something', "json_key"), ("don’t stop taking it now", None),
])
def test_reject_reason(spark, text, reason):
    df = spark.createDataFrame([(text,)], "prompt string")
    assert filters.mark_artifacts(df).first().reject_reason == reason


@pytest.mark.parametrize("text,clean", [
    ("How do I treat a burn? (Tier B)", "How do I treat a burn?"), ("Chest pain now (S0/Tier A)", "Chest pain now"),
    ("Is it fine? This is Tier C, S1", "Is it fine?"), ("Is it fine? Tier A", "Is it fine?"), ("Don’t know", "Don't know"),
])
def test_clean_annotations(spark, text, clean):
    assert one(spark, text, T.clean_annotations) == clean


def test_lexicon_is_prefix_of_word(spark):
    terms = ["bp", "Blood Pressure", "diabet"]
    for text, hit in [("my bpm is high", True), ("blood pressure", False), ("prediabetes", False), ("DIABETES!", True), ("", False), (None, False)]:
        assert one(spark, text, lambda c: T.lexicon_match(c, terms)) is hit


@pytest.mark.parametrize("label,part,digest", [("A:abc", "A", "abc"), ("A:b:c", "A", "b:c"), ("plain", None, None), ("S0", None, None), ("", None, None), (":x", "", "x")])
def test_split_label(spark, label, part, digest):
    got = one(spark, label, L.split_label)
    assert (got.label, got.digest) == (part, digest) if part is not None else got is None


def test_labels(spark):
    assert one(spark, "A", L.extract_label) == "A" and one(spark, "S0", L.extract_label) == "C" and one(spark, None, L.extract_label) == "C"
    digest = hashlib.sha1("héllo".encode()).hexdigest()
    assert one(spark, "héllo", L.prompt_hash) == digest and one(spark, None, L.prompt_hash) == "0" * 40
    df = spark.createDataFrame([("héllo", f"B:{digest}"), ("other", f"B:{digest}"), ("x", "B")], "prompt string, tier string")
    assert [r.hash_ok for r in integrity.verify(df).collect()] == [True, False, True]
    with pytest.raises(Exception, match="hash mismatch"):
        integrity.verified_label(df, "tier", "t", strict=True).collect()


def test_hashing_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, "p", "A", "S1"), (2, "q", "B", None), (3, None, "C", "S0")], "id int, prompt string, tier string, scope string")
    once = integrity.add_prompt_hash(df).drop("hash_status", "scope_hashed")
    again = integrity.add_prompt_hash(once)
    assert again.where("hash_status = 'hashed'").count() == 0
    assert sorted(map(tuple, again.select(*once.columns).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


@pytest.mark.parametrize("raw,strategy,fields", [
    ('```json\n{"a": 1}\n```', "json_fence", {"a": "1"}),
    ('text ```\n{"a": 1, "b": yes}\n``` more', "any_fence", {"a": "1", "b": "true"}),
    ('so {"a": "x",} end', "object", {"a": "x"}),
    ('{"a": 0.5, "r": "cut he', "object", {"a": "0.5", "r": "cut he"}),
    ('{"a": 0.5, "b":', "salvage", {"a": "0.5"}),
    ('{"a": 1} and {"b": "No"}', "salvage", {"a": "1", "b": "false"}),
    ('{"a": 1 "a": 2, "n": -3', "salvage", {"a": "1"}),
    ('{"a":b": 4 "c": "x"', "salvage", {"c": "x", ":b": "4"}),
    ('[1, 2]', "array", None), ("nothing", None, None), ("", None, None), (None, None, None),
])
def test_extract_object(spark, raw, strategy, fields):
    got = one(spark, raw, A.extract_object)
    assert (got.strategy, got.fields) == (strategy, fields) if strategy else got is None


@pytest.mark.parametrize("raw,n", [('[{"a": 1}]', 1), ('```json\n[{"a": 1}, {"a": 2},]\n```', 2), ('x [{"a": yes}] y', 1), ("none", None)])
def test_extract_array_keeps_one_item_lists(spark, raw, n):
    assert one(spark, raw, lambda c: F.size(A.extract_array(c))) == n


def test_typed_answer_rules(spark):
    raw = '{"harm_avoidance": 7, "safety_context_score": -2, "has_medical_disclaimer": "YES", "professional_referral": "0", "referral_strength": "wild", "severity": "bad"}'
    df = spark.createDataFrame([(raw,), ('{"harm_avoidance_score": "much", "safety_context_score": 1}',)], "raw string")
    a, b = judge.parse_answers(df, "ahimsa").collect()
    assert (a.harm_avoidance_score, a.safety_context_score, a.has_medical_disclaimer, a.has_professional_referral) == (0.7, 0.0, True, False)
    assert (a.referral_strength, a.severity, a.reject_reason, a.missing) == ("none", "none", None, [])
    assert b.used_default and b.harm_avoidance_score == 0.5 and b.reject_reason == "missing_keys"
    d = judge.parse_answers(spark.createDataFrame([("no json",)], "raw string"), "dharma").first()
    assert (d.response_scope, d.scope_risk, d.severity, d.out_of_domain_advice) == ("S3", "high", "major", True)


def test_sanitize(spark):
    table = r"\begin{tabular}{ll} x \hline kept \end{tabular}"
    assert one(spark, table, A.sanitize) == "kept"
    assert one(spark, "a\n\tb  {c} \\alpha{z} {\"k\": 1}", A.sanitize) == 'a b (c) {"k": 1)'
    assert one(spark, "x" * 30 + "\u0001\u007f", A.sanitize) == "x" * 30


def test_count_keywords_does_not_overlap(spark):
    assert one(spark, "aaaa Aa", lambda c: T.count_keywords(c, ["aa"])) == "aaaa aa".count("aa")


def test_clip_flag(spark):
    for tokens, want in [([5, 6, 7], True), ([5, 6, 2], False), ([5, 2, 0], False), ([5, 6], False), ([0, 0, 0], False)]:
        assert one(spark, tokens, lambda c: T.is_clipped(c, 3, eos=2, pad=0), "array<int>") is want


def test_log_line_classes(spark):
    for line, kind in [
        ("2024-01-01 00:00:00,123 - m - INFO - {'loss': 0.1}", "training_metrics"), (" 5%|#| 5/100 [", "progress_bar"),
        ("Combined reward: 0.5", "reward_summary"), ("Gemini Dharma Scope Penalty: x", "gemini_evaluation"), ("Loading model", "configuration"),
        ("Saving now", "checkpoint"), ("2024-01-01 00:00:00,123 - m - ERROR - broken", "error_warning"), ("wandb: hi", "wandb"), ("hm", "other"),
    ]:
        assert one(spark, line, lambda c: G.line_type(G.message(c), G.level(c))) == kind
    assert one(spark, "{'loss': 1e-3, 'kl': 1.2.3}", G.metrics_map) == {"loss": 0.001}


def test_exact_dedupe_is_idempotent_and_keeps_first(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}" if i % 2 else "hot") for i in range(100)], "id int, prompt string")
    once = filters.exact_dedupe(df, "id")
    assert {r.prompt: r.id for r in once.collect()} == {"hot": 0, "p1": 1, "p0": 3, "p2": 5}
    assert filters.exact_dedupe(once, "id").count() == 4


def test_judge_batch_failures(spark):
    items = spark.createDataFrame([(i,) for i in range(23)], "i int").coalesce(1)

    def scorer(pdf):
        if 5 in set(pdf["i"]):
            raise ValueError("call failed")
        return pdf.assign(score=1.0)[["score"]].head(4)

    rows = judge.judge_batch(items, scorer, "score double", {"score": 0.0}, size=5).collect()
    assert len(rows) == 23
    state = {r.i: (r.score, r.scorer_error) for r in rows}
    assert state[0] == (1.0, None) and state[4] == (0.0, "missing") and state[7] == (0.0, "ValueError") and state[22] == (1.0, None)
