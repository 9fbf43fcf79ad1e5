"""Queries over the text predicates, cleaning, lexicon and label functions."""

from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import labels as L, names as N, text as T
from plumbline.operators import filters, lexicon
from plumbline.plans import tables as D
from plumbline.plans.registry import query, rounded
from plumbline.sources import readers

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REASON = f"""CASE WHEN p IS NULL OR p = '' THEN 'empty'
 WHEN contains(p, '{{"') OR contains(p, '"}}') OR contains(p, '\\n') OR contains(p, '\\r') THEN 'json_artifact'
 WHEN contains(p, chr(10) || ',') OR contains(p, '"' || chr(10)) THEN 'newline_artifact'
 WHEN length(p) < 15 THEN 'too_short' WHEN contains(p, '<') AND contains(p, '>') THEN 'markup'
 WHEN contains(p, '"title":') OR contains(p, '"prompt":') OR contains(p, '"completion":') THEN 'json_key' END"""
# whole texts of documents, pages and events with their properties
_ALL_TEXT = f"""texts AS (SELECT 'd' || doc_id AS id, text AS prompt FROM documents
 UNION ALL SELECT 'p' || page_id, html FROM pages
 UNION ALL SELECT 'e' || event_id, CASE WHEN event_type = 'click' THEN event_type ELSE event_type || ' with ' || props END FROM events)"""


def all_text(spark, d):
    def named(table, key, prefix, text):
        return D.load(spark, d, table).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), text.alias("prompt"))

    words = F.concat(F.col("event_type"), F.lit(" with "), F.col("props"))
    return named("documents", "doc_id", "d", F.col("text")).unionByName(
        named("pages", "page_id", "p", F.col("html"))
    ).unionByName(named("events", "event_id", "e", F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(words)))


@query("filter_prompt_artifacts", f"WITH {_ALL_TEXT} SELECT id, {_REASON} AS reject_reason FROM (SELECT id, trim(prompt, {_SPACE}) AS p FROM texts)")
def filter_prompt_artifacts(spark, d):
    return filters.mark_artifacts(all_text(spark, d)).select("id", "reject_reason")


@query("validate_required", "WITH " + D.TIERS + """ SELECT count(*) AS n_rows, CAST(count_if(prompt IS NULL OR tier IS NULL) AS BIGINT) AS n_invalid,
 count(*) > 0 AND count_if(prompt IS NULL OR tier IS NULL) = 0 AS is_valid FROM tiers""")
def validate_required(spark, d):
    return filters.validate_required(D.tiers(spark, d), ["prompt", "tier"])


@query("validate_violations", "WITH " + D.TIERS + """ SELECT doc_id, array_to_string(list_filter([CASE WHEN prompt IS NULL THEN 'prompt' END, CASE WHEN tier IS NULL THEN 'tier' END], lambda x: x IS NOT NULL), ',') AS missing
 FROM tiers WHERE prompt IS NULL OR tier IS NULL""")
def validate_violations(spark, d):
    return filters.violations(D.tiers(spark, d), "doc_id", ["prompt", "tier"]).select("doc_id", F.array_join("missing", ",").alias("missing"))


_SUFFIXED = """suffixed AS (SELECT doc_id, text || (['', ' (Tier B)', ' (Tier A, Scope S0)', ' This is Tier C, S1', ' Tier A/B', ' Scope: S2', ' (S0)', ' don’t'])[CAST(doc_id % 8 + 1 AS INT)] AS prompt FROM documents)"""


def suffixed(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", " (Tier B)", " (Tier A, Scope S0)", " This is Tier C, S1", " Tier A/B", " Scope: S2", " (S0)", " don’t")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return D.load(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("prompt"))


def _clean_sql():
    expr = "prompt"
    for p in T.ANNOTATIONS:
        literal = p.replace("'", "''")
        expr = f"trim(regexp_replace({expr}, '{literal}', '', 'gi'), {_SPACE})"
    return f"replace({expr}, '’', '''')"


@query("clean_annotations", f"WITH {_SUFFIXED}, c AS (SELECT doc_id, {_clean_sql()} AS prompt FROM suffixed) SELECT doc_id, md5(prompt) AS digest, regexp_matches(prompt, '\\bTier\\b', 'i') AS still_mentions_tier FROM c")
def clean_annotations(spark, d):
    return filters.clean_prompts(suffixed(spark, d)).select("doc_id", F.md5("prompt").alias("digest"), "still_mentions_tier")


@query("clean_tier_suffix", f"WITH {_SUFFIXED} SELECT doc_id, md5(replace(trim(regexp_replace(prompt, '\\s*\\(Tier\\s*[A-Ca-c]\\)\\s*$', '', 'i'), {_SPACE}), '’', '''')) AS digest FROM suffixed")
def clean_tier_suffix(spark, d):
    return suffixed(spark, d).select("doc_id", F.md5(T.clean_tier_suffix(F.col("prompt"))).alias("digest"))


# words of the corpus stand in for domain terms
TERMS = ["thouinor", "ndwhst", "eux", "blood pressure", "ononedth", "onesen", "whou", "ça", "édition", "lyoren"]


@query("lexicon_match", """SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:thouinor|ndwhst|eux|ononedth|onesen|whou|ça|édition|lyoren)') AS matched FROM documents""")
def lexicon_match(spark, d):
    return D.load(spark, d, "documents").select("doc_id", T.lexicon_match(F.col("text"), TERMS).alias("matched"))


@query("lexicon_match_table", """SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:thouinor|ndwhst|eux|ononedth|onesen|whou|ça|édition|lyoren)') AS matched FROM documents""")
def lexicon_match_table(spark, d):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term STRING")
    out = lexicon.lexicon_match_table(D.load(spark, d, "documents"), "doc_id", "text", terms)
    return out.select("doc_id", F.col("lexicon_match").alias("matched"))


@query("lexicon_score", """SELECT doc_id, (CASE WHEN doc_id % 7 > 0 THEN least((doc_id % 7) / 4.0, 1) WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END)::DOUBLE AS score FROM documents""")
def lexicon_score(spark, d):
    found = F.array_repeat(F.lit("entity"), (F.col("doc_id") % 7).cast("int"))
    return D.load(spark, d, "documents").select("doc_id", T.lexicon_score(found, F.contains(F.lower("text"), F.lit("the"))).alias("score"))


_GATE = "WITH m AS (SELECT doc_id, source, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:thouinor|ndwhst)') AS hit FROM documents)"


@query("lexicon_gate", _GATE + """ SELECT doc_id, 'open' AS mode FROM (SELECT *, bool_or(hit) OVER (PARTITION BY source) AS any_hit FROM m) WHERE hit OR NOT any_hit
 UNION ALL SELECT doc_id, 'enforced' FROM m WHERE hit""")
def lexicon_gate(spark, d):
    docs = D.load(spark, d, "documents")
    hit = T.lexicon_match(F.col("text"), ["thouinor", "ndwhst"])
    loose = filters.lexicon_gate(docs, hit, "source", enforce=False).select("doc_id", F.lit("open").alias("mode"))
    return loose.unionByName(filters.lexicon_gate(docs, hit, "source", enforce=True).select("doc_id", F.lit("enforced").alias("mode")))


_WORDS = ["the", "and", "ent", "éo"]


@query("contains_keywords", "SELECT doc_id, contains(lower(text), 'thouinor') OR contains(lower(text), 'ndwhst') AS any_case, contains(text, 'Thouinor') OR contains(text, 'Ndwhst') AS exact_case FROM documents")
def contains_keywords(spark, d):
    t = F.col("text")
    return D.load(spark, d, "documents").select("doc_id", T.contains_keywords(t, ["Thouinor", "NDWHST"]).alias("any_case"), T.contains_keywords(t, ["Thouinor", "Ndwhst"], True).alias("exact_case"))


@query("contains_pattern", r"SELECT doc_id, regexp_matches(text, '[A-Za-z]+@[a-z]+\.(com|org|net)') AS found FROM documents")
def contains_pattern(spark, d):
    return D.load(spark, d, "documents").select("doc_id", T.matches(F.col("text"), r"[A-Za-z]+@[a-z]+\.(com|org|net)").alias("found"))


@query("count_keywords", "SELECT doc_id, CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in _WORDS) + " AS BIGINT) AS hits FROM documents")
def count_keywords(spark, d):
    return D.load(spark, d, "documents").select("doc_id", T.count_keywords(F.col("text"), _WORDS).alias("hits"))


# English answers derived from the conversations: the assistant text with a phrase chosen by turn
_PHRASES = [
    "I am not a doctor.", "According to experts, according to data.", "research suggest rest",
    "It may help many people.", "stop taking the medicine now", "a guaranteed cure", "I understand how you feel",
    "please consult your physician", "take care of yourself, that must be hard", "no claim", "double dose of money",
]
_ANSWERS = "answers AS (SELECT conv_id, turn, text || ' ' || ([" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + "])[CAST((conv_id * 7 + turn) % 11 + 1 AS INT)] AS answer FROM conversations)"


def answers(spark, d):
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), ((F.col("conv_id") * 7 + F.col("turn")) % 11 + 1).cast("int"))
    return D.load(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", phrase).alias("answer"))


def _any(patterns):
    return "(" + " OR ".join("regexp_matches(answer, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


@query("has_disclaimer", f"WITH {_ANSWERS} SELECT conv_id, turn, {_any(C.DISCLAIMER_PATTERNS)} AS found FROM answers")
def has_disclaimer(spark, d):
    return answers(spark, d).select("conv_id", "turn", T.has_disclaimer(F.col("answer")).alias("found"))


@query("has_citation", f"WITH {_ANSWERS} SELECT conv_id, turn, {_any(C.CITATION_PATTERNS)} AS found FROM answers")
def has_citation(spark, d):
    return answers(spark, d).select("conv_id", "turn", T.has_citation(F.col("answer")).alias("found"))


@query("expresses_uncertainty", f"WITH {_ANSWERS} SELECT conv_id, turn, {_any(C.UNCERTAINTY_PATTERNS)} AS found FROM answers")
def expresses_uncertainty(spark, d):
    return answers(spark, d).select("conv_id", "turn", T.expresses_uncertainty(F.col("answer")).alias("found"))


@query("detect_harmful_advice", f"WITH {_ANSWERS}, r AS (SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(answer, '{p.replace(chr(39), chr(39) * 2)}') THEN '{r}'" for p, r in C.HARMFUL_PATTERNS) + " END AS reason FROM answers) SELECT conv_id, turn, reason, reason IS NOT NULL AS harmful FROM r")
def detect_harmful_advice(spark, d):
    out = answers(spark, d).withColumn("reason", T.harmful_reason(F.col("answer")))
    return out.select("conv_id", "turn", "reason", F.col("reason").isNotNull().alias("harmful"))


@query("compassionate_language", f"WITH {_ANSWERS}, c AS (SELECT conv_id, turn, " + " + ".join(_any([p]) + "::INT" for p in C.COMPASSION_PATTERNS) + " AS n FROM answers) SELECT conv_id, turn, CAST(n AS INT) AS n, n > 0 AS compassionate FROM c")
def compassionate_language(spark, d):
    out = answers(spark, d).withColumn("n", T.compassion_count(F.col("answer")))
    return out.select("conv_id", "turn", "n", (F.col("n") > 0).alias("compassionate"))


@query("clip_flag", """SELECT vec_id, len(toks) = 64 AND last_tok IS NOT NULL AND last_tok <> 2 AS clipped FROM (SELECT vec_id, toks,
 list_filter(toks, lambda t: t <> 0)[-1] AS last_tok FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 40) % 4 AS INT)) AS toks FROM embeddings))""")
def clip_flag(spark, d):
    toks = F.transform("embedding", lambda x: (F.floor(F.abs(x) * 40) % 4).cast("int"))
    return D.load(spark, d, "embeddings").select("vec_id", T.is_clipped(toks, 64, eos=2, pad=0).alias("clipped"))


@query("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return D.load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_MODELS = ["meta-llama/Llama-3.2-1B-Instruct", "out/llama-3.2-3B", "x/Llama-2-7b", "runs/GRPO_7/final", "out/checkpoint-900", "medalpaca/medalpaca-7b", "org/other-model"]
_JUDGES = ["gemini (gemini-2.0-flash)", "gemini", "anthropic (claude-3-5-sonnet)", "claude-3-opus", "claude", "openai (gpt-4o)", "openai o3-mini", "gpt-4", "human"]


def _listed(values, expr):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({expr} % {len(values)} + 1 AS INT)]"


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


_MODEL_SQL = """CASE WHEN contains(lower(m), 'checkpoint') OR contains(lower(m), 'grpo') THEN 'Tuned-' || split_part(m, '/', -1)
 WHEN contains(lower(m), 'llama') AND contains(m, '3.2-1B') THEN 'Llama-3.2-1B' WHEN contains(lower(m), 'llama') AND contains(m, '3.2-3B') THEN 'Llama-3.2-3B'
 WHEN contains(lower(m), 'llama') THEN 'Llama-' || split_part(m, '/', -1) WHEN contains(lower(m), 'medalpaca') THEN 'MedAlpaca-7B' ELSE split_part(m, '/', -1) END"""
_JUDGE_SQL = """CASE j WHEN 'gemini (gemini-2.0-flash)' THEN 'Gemini 2.0 Flash/gemini' WHEN 'gemini' THEN 'Gemini/gemini'
 WHEN 'anthropic (claude-3-5-sonnet)' THEN 'Claude 3.5 Sonnet/anthropic' WHEN 'claude-3-opus' THEN 'Claude 3 Opus/anthropic' WHEN 'claude' THEN 'Claude/anthropic'
 WHEN 'openai (gpt-4o)' THEN 'GPT-4o/openai' WHEN 'openai o3-mini' THEN 'OpenAI o3/openai' WHEN 'gpt-4' THEN 'OpenAI/openai' ELSE 'human/unknown' END"""


@query("model_name_norm", f"SELECT o_orderkey, {_MODEL_SQL} AS model_name FROM (SELECT o_orderkey, {_listed(_MODELS, 'o_custkey')} AS m FROM orders)")
def model_name_norm(spark, d):
    return D.load(spark, d, "orders").select("o_orderkey", N.model_name(_pick(_MODELS, "o_custkey")).alias("model_name"))


@query("evaluator_name_norm", f"SELECT o_orderkey, split_part(x, '/', 1) AS evaluator_name, split_part(x, '/', 2) AS family FROM (SELECT o_orderkey, {_JUDGE_SQL} AS x FROM (SELECT o_orderkey, {_listed(_JUDGES, 'o_custkey')} AS j FROM orders))")
def evaluator_name_norm(spark, d):
    named = D.load(spark, d, "orders").withColumn("e", N.evaluator_name(_pick(_JUDGES, "o_custkey")))
    return named.select("o_orderkey", F.col("e.name").alias("evaluator_name"), F.col("e.family").alias("family"))


@query("evaluator_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'openai' ELSE 'openai (' || o_orderpriority || ')' END AS label FROM orders")
def evaluator_label(spark, d):
    model = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return D.load(spark, d, "orders").select("o_orderkey", N.evaluator_label(F.lit("openai"), model).alias("label"))


@query("format_pct_score", "SELECT event_id, printf('%.1f%%', (floor(value) / 512) * 100) AS pct, printf('%.3f', floor(value) / 8) AS score FROM events")
def format_pct_score(spark, d):
    v = F.floor("value")
    return D.events(spark, d).select("event_id", N.percent(v / 512).alias("pct"), N.score3(v / 8).alias("score"))


@query("response_scope_count_default", "SELECT coalesce(CASE WHEN l_partkey % 5 < 4 THEN 'S' || (l_partkey % 5) END, 'S0') AS response_scope, count(*) AS n FROM lineitem GROUP BY 1")
def response_scope_count_default(spark, d):
    known = F.when(F.col("l_partkey") % 5 < 4, F.concat(F.lit("S"), F.col("l_partkey") % 5))
    return D.load(spark, d, "lineitem").groupBy(F.coalesce(known, F.lit("S0")).alias("response_scope")).agg(F.count(F.lit(1)).alias("n"))


_RAW_TIER = "(['a', ' B ', 'C', 'D', '', 'tier A'])[CAST(l_orderkey % 6 + 1 AS INT)]"


@query("parse_tier", f"SELECT upper(trim({_RAW_TIER})) IN ('A', 'B', 'C') AS valid, CASE WHEN upper(trim({_RAW_TIER})) IN ('A', 'B', 'C') THEN upper(trim({_RAW_TIER})) ELSE 'C' END AS tier, count(*) AS n FROM lineitem GROUP BY ALL")
def parse_tier(spark, d):
    raw = _pick(["a", " B ", "C", "D", "", "tier A"], "l_orderkey")
    t = D.load(spark, d, "lineitem").select(L.parse_tier(raw).alias("tier"), F.upper(F.trim(raw)).isin(C.TIERS).alias("valid"))
    return t.groupBy("valid", "tier").agg(F.count(F.lit(1)).alias("n"))


_SCOPE_RAW = ['{"scope": "S2"}', '{"scope": "s1"}', '{"scope": "S9"}', "The class is S3.", "either s2 or S1", "none", '{"other": 1}']


@query("parse_scope", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 7 WHEN 0 THEN 'S2' WHEN 1 THEN 'S1' WHEN 3 THEN 'S3' WHEN 4 THEN 'S1' END AS scope FROM lineitem")
def parse_scope(spark, d):
    raw = _pick(_SCOPE_RAW, "l_partkey")
    return D.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.parse_scope(raw).alias("scope"))


@query("symptom_override", "WITH " + D.JUDGED + " SELECT item_id, CASE WHEN scope <> 'S0' AND l_orderkey % 3 = 0 THEN 'S0' ELSE scope END AS scope FROM judged")
def symptom_override(spark, d):
    answer = _pick([" yes, it is", "No", None], "l_orderkey")
    return D.judged(spark, d).select("item_id", L.symptom_override(F.col("scope"), answer).alias("scope"))


# each turn with the next one, as a message list
_CHATS = """chats AS (SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN [{'role': a.role, 'content': a.text}]
 ELSE [{'role': a.role, 'content': a.text}, {'role': b.role, 'content': b.text}] END AS messages
 FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def chats(spark, d):
    def message():
        return F.struct("role", F.col("text").alias("content"))

    talk = D.load(spark, d, "conversations")
    here = talk.select("conv_id", "turn", message().alias("a"))
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), message().alias("b"))
    both = F.when(F.col("b").isNull(), F.array("a")).otherwise(F.array("a", "b"))
    return here.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", both.alias("messages"))


@query("chat_user_text", f"WITH {_CHATS} SELECT conv_id, turn, coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '') AS user_text FROM chats")
def chat_user_text(spark, d):
    return chats(spark, d).select("conv_id", "turn", L.user_text(F.col("messages")).alias("user_text"))


@query("chat_completion_text", f"WITH {_CHATS} SELECT conv_id, turn, coalesce(messages[1].content, '') AS completion FROM chats")
def chat_completion_text(spark, d):
    return chats(spark, d).select("conv_id", "turn", L.completion_text(F.col("messages")).alias("completion"))


@query("chat_format", "SELECT conv_id, turn, 2 AS n_messages, 'system' AS first_role, 'user' AS second_role, text AS second_content FROM conversations")
def chat_format(spark, d):
    out = D.load(spark, d, "conversations").withColumn("m", L.chat_format(F.col("text"), "You are careful."))
    return out.select("conv_id", "turn", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["role"].alias("second_role"), F.col("m")[1]["content"].alias("second_content"))


@query("scan_prompt_column", "SELECT md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def scan_prompt_column(spark, d):
    return readers.scan_prompt_column(D.documents(spark, d)).select(F.md5("prompt").alias("digest"))


@query("add_scope_column", "SELECT doc_id, 'S' || (n_chars % 4) AS scope FROM documents")
def add_scope_column(spark, d):
    return D.documents(spark, d).withColumn("scope", F.concat(F.lit("S"), F.col("n_chars") % 4)).select("doc_id", "scope")
