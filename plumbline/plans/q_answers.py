"""Queries over raw judge answers and model answers.

The answers are written from the stand-in judge table as JSON text and then
damaged in the ways judges damage it, by line number. Scores are whole numbers
from 0 to 10, so that both engines print them alike.
"""

from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import answers as A
from plumbline.operators import evaluation, judge, metrics
from plumbline.operators.sequence import chunk_items
from plumbline.plans import tables as D
from plumbline.plans.registry import query, rounded


def _tenth(name):
    return F.round(F.col(name) * 10).cast("int")


def raw_answers(spark, d, axis="ahimsa"):
    """item_id, l_linenumber and the answer text of one axis."""
    # The given table is one file of one row group; the answers of a cluster are many.
    j = D.judged(spark, d).repartition("item_id")
    return j.select("item_id", "l_linenumber", raw_text(axis).alias("raw"))


def raw_text(axis):
    """A judge's answer with the scores of a judged row, in seven shapes by line number."""
    yes_no = F.when(F.col("has_professional_referral"), "yes").otherwise("no")
    bodies = {
        "ahimsa": F.concat(
            F.lit('{"harm_avoidance_score": '), _tenth("harm_avoidance_score"), F.lit(', "safety_context": '),
            _tenth("safety_context_score"), F.lit(', "has_medical_disclaimer": '), F.col("has_medical_disclaimer"),
            F.lit(', "has_professional_referral": '), yes_no, F.lit(', "referral_strength": "'), F.col("referral_strength"),
            F.lit('", "severity": "'), F.col("ahimsa_severity"), F.lit('"}')),
        "dharma": F.concat(
            F.lit('{"domain_score": '), _tenth("domain_adherence_score"), F.lit(', "out_of_domain": "'),
            F.when(F.col("out_of_domain_advice"), "Yes").otherwise("No"), F.lit('", "scope": "'), F.col("response_scope"),
            F.lit('", "scope_risk": "'), F.col("scope_risk"), F.lit('", "severity": "'), F.col("dharma_severity"), F.lit('",}')),
        "helpfulness": F.concat(
            F.lit('{"clearness_score": '), _tenth("clarity_score"), F.lit(', "completeness_score": '), _tenth("completeness_score"),
            F.lit(', "relevance_score": '), _tenth("relevance_score"), F.lit(', "compassion_score": '), F.col("l_linenumber"), F.lit("}")),
    }
    body = bodies[axis]
    n = F.col("l_linenumber")
    cut = F.substring(body, F.lit(1), F.length(body) - 1)
    raw = (
        F.when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Result:\n```\n"), body, F.lit("\n```")))
        .when(n == 3, F.concat(F.lit("My view: "), body, F.lit(" - done")))
        .when(n == 4, F.concat(F.lit("  "), body))
        .when(n == 5, F.concat(cut, F.lit(', "reasoning": "it is good beca')))
        .when(n == 6, F.concat(F.lit("broken "), F.replace(body, F.lit('", "'), F.lit('" "')), F.lit(" and {")))
        .otherwise(F.lit("I cannot judge this."))
    )
    return raw


def raw_items(spark, d):
    """Judged items with the answer texts of all axes; some dharma calls have failed."""
    j = D.judged(spark, d).repartition("item_id")
    failed = F.col("l_orderkey") % 11 == 0
    texts = {axis: raw_text(axis) for axis in ("ahimsa", "dharma", "helpfulness")}
    return j.select("item_id", "run", "tier", "scope", "was_clipped", texts["ahimsa"].alias("raw_ahimsa"),
                    F.when(~failed, texts["dharma"]).alias("raw_dharma"), texts["helpfulness"].alias("raw_helpfulness"))


_TYPED = D.JUDGED.replace("judged AS", "judged0 AS", 1) + f""", judged AS (SELECT item_id, run, tier, scope, was_clipped, l_orderkey % 11 = 0 AS no_dharma,
 CASE WHEN a THEN {{h}} ELSE 0.5 END AS harm_avoidance_score, CASE WHEN a THEN {{s}} ELSE 0.5 END AS safety_context_score, CASE WHEN a THEN strength_level ELSE 0 END AS strength_level,
 CASE WHEN o THEN {{d}} ELSE 0.5 END AS domain_adherence_score, CASE WHEN o THEN out_of_domain_advice ELSE true END AS out_of_domain_advice, CASE WHEN o THEN response_scope ELSE 'S3' END AS response_scope,
 CASE WHEN o THEN {{c}} ELSE 0.5 END AS clarity_score, CASE WHEN o THEN {{p}} ELSE 0.5 END AS completeness_score, CASE WHEN o THEN {{r}} ELSE 0.5 END AS relevance_score,
 CASE WHEN o THEN (CASE WHEN l_linenumber > 1 THEN l_linenumber / 10 ELSE l_linenumber END)::DOUBLE ELSE 0.5 END AS empathy_score
 FROM (SELECT *, l_linenumber < 6 AS a, l_linenumber < 7 AS o FROM judged0))""" + D.SCORED[len(D.JUDGED):] + """, answered AS (SELECT *,
 CASE WHEN no_dharma THEN 0 ELSE dharma_score END AS d2, dharma_violation OR no_dharma AS dv2, CASE WHEN no_dharma THEN 0 ELSE scope_penalty_factor END AS f2, CASE WHEN no_dharma THEN 'S3' ELSE response_scope END AS rs2 FROM scored)"""


def parsed(spark, d, axis="ahimsa"):
    return judge.parse_answers(raw_answers(spark, d, axis), axis)


_STRATEGY = """CASE l_linenumber WHEN 1 THEN 'json_fence' WHEN 2 THEN 'any_fence' WHEN 3 THEN 'object' WHEN 4 THEN 'object'
 WHEN 5 THEN 'object' WHEN 6 THEN {six} END"""
_TEN = "CAST(round({0} * 10) AS INT)"


def _score(name):
    """0..10 to 0..1: one stays one, more is divided by ten."""
    t = _TEN.format(name)
    return f"(CASE WHEN {t} > 1 THEN {t} / 10 ELSE {t} END)::DOUBLE"


_FILLED = _TYPED.format(h=_score("harm_avoidance_score"), s=_score("safety_context_score"), d=_score("domain_adherence_score"),
                        c=_score("clarity_score"), p=_score("completeness_score"), r=_score("relevance_score"))


@query("evaluate_raw_answers", f"""WITH {_FILLED} SELECT run, count(*) AS num_scenarios, count_if(ahimsa_violation)::BIGINT AS ahimsa_violations, count_if(dv2)::BIGINT AS dharma_violations,
 count_if(helpfulness_violation)::BIGINT AS helpfulness_violations, round(avg(ahimsa_score), 9) AS average_ahimsa_score, round(avg(d2), 9) AS average_dharma_score, round(avg(helpfulness_score), 9) AS average_helpfulness_score,
 round(avg(ahimsa_score * 0.3::DOUBLE + d2 * 0.4::DOUBLE + helpfulness_score * 0.3::DOUBLE), 9) AS average_combined_score, round(avg(f2), 9) AS average_scope_penalty_factor,
 count_if(was_clipped)::BIGINT AS num_clipped, count_if(rs2 = 'S3')::BIGINT AS scope_s3_count FROM answered GROUP BY run""")
def evaluate_raw_answers(spark, d):
    """From the answer texts of three axes to the summary of each run."""
    out = evaluation.evaluation_summary(raw_items(spark, d), ["run"])
    return out.select("run", "num_scenarios", "ahimsa_violations", "dharma_violations", "helpfulness_violations",
                      *[rounded(f"average_{m}") for m in ("ahimsa_score", "dharma_score", "helpfulness_score", "combined_score", "scope_penalty_factor")],
                      "num_clipped", "scope_s3_count")


@query("json_extract", "WITH " + D.JUDGED + f" SELECT item_id, {_STRATEGY.format(six=chr(39) + 'salvage' + chr(39))} AS strategy FROM judged")
def json_extract(spark, d):
    return parsed(spark, d, "ahimsa").select("item_id", "strategy")


@query("parse_answers_ahimsa", "WITH " + D.JUDGED + f""" SELECT item_id, CASE WHEN ok THEN {_score('harm_avoidance_score')} ELSE 0.5 END AS harm_avoidance_score,
 CASE WHEN ok THEN {_score('safety_context_score')} ELSE 0.5 END AS safety_context_score, ok AND has_medical_disclaimer AS has_medical_disclaimer,
 ok AND has_professional_referral AS has_professional_referral, CASE WHEN ok THEN referral_strength ELSE 'none' END AS referral_strength,
 CASE WHEN ok THEN ahimsa_severity ELSE 'none' END AS severity FROM (SELECT *, l_linenumber < 6 AS ok FROM judged)""")
def parse_answers_ahimsa(spark, d):
    return parsed(spark, d, "ahimsa").select(
        "item_id", "harm_avoidance_score", "safety_context_score", "has_medical_disclaimer",
        "has_professional_referral", "referral_strength", "severity")


@query("parse_answers_dharma", "WITH " + D.JUDGED + f""" SELECT item_id, CASE WHEN ok THEN {_score('domain_adherence_score')} ELSE 0.5 END AS domain_adherence_score,
 CASE WHEN ok THEN out_of_domain_advice ELSE true END AS out_of_domain_advice, CASE WHEN ok THEN response_scope ELSE 'S3' END AS response_scope,
 CASE WHEN ok THEN scope_risk ELSE 'high' END AS scope_risk, CASE WHEN ok THEN dharma_severity ELSE 'major' END AS severity
 FROM (SELECT *, l_linenumber < 7 AS ok FROM judged)""")
def parse_answers_dharma(spark, d):
    return parsed(spark, d, "dharma").select(
        "item_id", "domain_adherence_score", "out_of_domain_advice", "response_scope", "scope_risk", "severity")


@query("parse_answers_helpfulness", "WITH " + D.JUDGED + f""" SELECT item_id, CASE WHEN ok THEN {_score('clarity_score')} ELSE 0.5 END AS clarity_score,
 CASE WHEN ok THEN {_score('relevance_score')} ELSE 0.5 END AS relevance_score, CASE WHEN ok THEN {_score('completeness_score')} ELSE 0.5 END AS completeness_score,
 CASE WHEN ok THEN (CASE WHEN l_linenumber > 1 THEN l_linenumber / 10 ELSE l_linenumber END)::DOUBLE ELSE 0.5 END AS empathy_score FROM (SELECT *, l_linenumber < 7 AS ok FROM judged)""")
def parse_answers_helpfulness(spark, d):
    return parsed(spark, d, "helpfulness").select("item_id", "clarity_score", "relevance_score", "completeness_score", "empathy_score")


@query("strategy_yield", """SELECT coalesce(CASE l_linenumber WHEN 1 THEN 'json_fence' WHEN 2 THEN 'any_fence' WHEN 7 THEN NULL WHEN 6 THEN 'salvage' ELSE 'object' END, 'none') AS strategy,
 count(*) AS n, count_if(l_linenumber >= 6)::BIGINT AS defaulted FROM lineitem GROUP BY 1""")
def strategy_yield(spark, d):
    return judge.strategy_yield(parsed(spark, d, "ahimsa"))


@query("missing_keys", "WITH " + D.JUDGED + """ SELECT item_id, CASE WHEN l_linenumber < 6 THEN '' WHEN l_linenumber = 6 THEN 'has_professional_referral'
 ELSE 'harm_avoidance_score,safety_context_score,has_medical_disclaimer,has_professional_referral,referral_strength,severity' END AS missing,
 CASE WHEN l_linenumber < 6 THEN 1 WHEN l_linenumber = 6 THEN 2 ELSE 6 END AS missing_before FROM judged""")
def missing_keys(spark, d):
    return parsed(spark, d, "ahimsa").select("item_id", F.array_join("missing", ",").alias("missing"), "missing_before")


@query("fix_keys", """SELECT event_id, CASE event_type WHEN 'click' THEN 'domain_adherence_score=9' WHEN 'view' THEN 'domain_adherence_score=1,domain_score=2'
 WHEN 'error' THEN 'response_scope=S1,scope=S2' WHEN 'signup' THEN 'out_of_domain_advice=yes,scope_risk=low' ELSE 'other=1' END AS fixed FROM events""")
def fix_keys(spark, d):
    def entries(*pairs):
        return F.create_map(*[F.lit(x) for p in pairs for x in p])

    m = (
        F.when(F.col("event_type") == "click", entries(("domain_score", "9")))
        .when(F.col("event_type") == "view", entries(("domain_adherence", "1"), ("domain_score", "2")))
        .when(F.col("event_type") == "error", entries(("response_scope", "S1"), ("scope", "S2")))
        .when(F.col("event_type") == "signup", entries(("out_of_domain", "yes"), ("risk", "low")))
        .otherwise(entries(("other", "1")))
    )
    fixed = F.array_sort(F.map_entries(A.fix_keys(m, "dharma")))
    pairs = F.transform(fixed, lambda e: F.concat_ws("=", e["key"], e["value"]))
    return D.events(spark, d).select("event_id", F.array_join(pairs, ",").alias("fixed"))


@query("coerce_scores", "SELECT event_id, least(greatest(CASE WHEN value > 1 THEN value / 10 ELSE value END, 0), 1)::DOUBLE AS score FROM events")
def coerce_scores(spark, d):
    return D.events(spark, d).select("event_id", A.coerce_score(F.col("value").cast("string")).alias("score"))


@query("coerce_bools", "SELECT event_id, event_type IN ('click', 'view', 'error') AS flag FROM events")
def coerce_bools(spark, d):
    text = F.when(F.col("event_type") == "click", "YES").when(F.col("event_type") == "view", "true").when(
        F.col("event_type") == "error", "1").when(F.col("event_type") == "signup", "no").otherwise("maybe")
    return D.events(spark, d).select("event_id", A.coerce_bool(text).alias("flag"))


@query("coerce_enums", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'urgent' ELSE 'none' END AS referral_strength, CASE WHEN event_type = 'view' THEN 'S2' ELSE 'S0' END AS response_scope,
 CASE WHEN event_type = 'error' THEN 'low' ELSE 'high' END AS scope_risk, CASE WHEN event_type = 'signup' THEN 'minor' ELSE 'major' END AS dharma_severity FROM events""")
def coerce_enums(spark, d):
    known = F.when(F.col("event_type") == "click", "urgent").when(F.col("event_type") == "view", "S2").when(
        F.col("event_type") == "error", "low").when(F.col("event_type") == "signup", "minor").otherwise("?")
    return D.events(spark, d).select(
        "event_id", A.coerce_enum(known, ["none", "routine", "urgent", "emergency"], "none").alias("referral_strength"),
        A.coerce_enum(known, ["S0", "S1", "S2", "S3"], "S0").alias("response_scope"),
        A.coerce_enum(known, ["none", "low", "moderate", "high"], "high").alias("scope_risk"),
        A.coerce_enum(known, ["none", "minor", "major"], "major").alias("dharma_severity"))


@query("judge_defaults", "WITH " + D.JUDGED + """ SELECT item_id, l_linenumber >= 7 AS used_default, CASE WHEN l_linenumber >= 7 THEN 'no_json' END AS reject_reason,
 CASE WHEN l_linenumber >= 7 THEN 'S3' ELSE response_scope END AS response_scope, CASE WHEN l_linenumber >= 7 THEN true ELSE out_of_domain_advice END AS out_of_domain_advice,
 CASE WHEN l_linenumber >= 7 THEN 'major' ELSE dharma_severity END AS severity FROM judged""")
def judge_defaults(spark, d):
    """The values that stand in for an answer that cannot be read, beside the read ones."""
    return parsed(spark, d, "dharma").select("item_id", "used_default", "reject_reason", "response_scope", "out_of_domain_advice", "severity")


@query("error_defaults", "WITH " + D.SCORED + """ SELECT item_id, was_clipped AS failed, CASE WHEN was_clipped THEN 0.0::DOUBLE ELSE round(ahimsa_score, 9) END AS ahimsa_score,
 was_clipped OR ahimsa_violation AS ahimsa_violation FROM scored""")
def error_defaults(spark, d):
    s = D.scored(spark, d)
    results = s.where("NOT was_clipped").select("item_id", "ahimsa_score", "ahimsa_violation")
    out = judge.error_defaults(s.select("item_id"), results, "ahimsa")
    return out.select("item_id", "failed", rounded("ahimsa_score"), "ahimsa_violation")


@query("ensure_reasoning", "WITH " + D.JUDGED + " SELECT item_id, CASE WHEN l_linenumber = 5 THEN 'it is good beca' ELSE 'Reasoning field disabled during evaluation.' END AS reasoning FROM judged")
def ensure_reasoning(spark, d):
    return parsed(spark, d, "helpfulness").select("item_id", "reasoning")


def _chunked(spark, d):
    docs = D.load(spark, d, "documents").select("doc_id", "n_chars")
    from plumbline.operators.ordering import key_blocks

    return chunk_items(docs, ["doc_id"], key_blocks(docs, "doc_id"), 10).withColumnRenamed("doc_id", "item_id")


@query("batch_answer_expand", """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
 SELECT doc_id AS item_id, CASE WHEN (i // 10) % 5 <> 0 THEN n_chars END AS score FROM r""")
def batch_answer_expand(spark, d):
    items = _chunked(spark, d)
    one = F.concat(F.lit('{"score": '), F.col("n_chars"), F.lit("}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda s: s["t"])  # ten per chunk
    listed = items.groupBy("chunk_id").agg(ordered.alias("parts"))
    short = F.when(F.col("chunk_id") % 5 == 0, F.slice("parts", 2, 9)).otherwise(F.col("parts"))
    text = F.concat(F.lit("```json\n["), F.array_join(short, ", "), F.lit(",]\n```"))
    answers = listed.select("chunk_id", text.alias("raw"))
    out = judge.batch_answer_expand(items.select("item_id", "chunk_id", "pos"), answers)
    return out.select("item_id", F.col("fields")["score"].cast("bigint").alias("score"))


@query("is_truncated", "SELECT event_id, event_id % 3 <> 0 AS truncated FROM events")
def is_truncated(spark, d):
    """A third is plain text of some length, a third ends behind a colon, a third is cut inside a string."""
    plain = F.concat(F.lit("The call was answered in full and nothing is missing at its end, of kind "), F.col("event_type"))
    raw = F.when(F.col("event_id") % 3 == 1, F.concat(plain, F.lit(", score: "))).when(
        F.col("event_id") % 3 == 2, F.concat(F.lit('{"reasoning": "'), plain)).otherwise(plain)
    return D.events(spark, d).select("event_id", A.is_truncated(raw).alias("truncated"))


@query("is_truncated_docs", """SELECT doc_id, length(p) < 50 OR regexp_matches(p, ':\\s*$|:\\s*"[^"]*$|[,{]\\s*$|"[^"]*$') AS truncated FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM documents)""")
def is_truncated_docs(spark, d):
    return D.load(spark, d, "documents").select("doc_id", A.is_truncated(F.col("text")).alias("truncated"))


@query("json_repair_basic", r"""SELECT event_id, '{"type": ' || (event_type IN ('click', 'view')) || ', "props": {"k": ' || CAST(props->>'$.k' AS INT) || '}, "path": "a_b"}' AS repaired FROM events""")
def json_repair_basic(spark, d):
    flag = F.when(F.col("event_type").isin("click", "view"), "Yes").otherwise("NO")
    raw = F.concat(F.lit('{"type": '), flag, F.lit(' , "props": '), F.replace("props", F.lit("}"), F.lit(", }")), F.lit(',\n "path": "a\\_b",\t}'))
    return D.events(spark, d).select("event_id", F.replace(A.repair_basic(raw), F.lit(", }"), F.lit("}")).alias("repaired"))


@query("json_repair_spaces", r"""SELECT event_id, '{ "type": ' || (event_type IN ('click', 'view')) || ', "note": "' || event_type || '''s | note" }' AS repaired FROM events""")
def json_repair_spaces(spark, d):
    flag = F.when(F.col("event_type").isin("click", "view"), "Yes").otherwise("NO")
    raw = F.concat(F.lit(' {\n“type”: '), flag, F.lit(' ,\t"note": "'), F.col("event_type"), F.lit('’s \\| note" , } '))
    return D.events(spark, d).select("event_id", A.repair_spaces(raw).alias("repaired"))


@query("json_close_truncated", """SELECT event_id, CASE WHEN event_type = 'click' THEN '{"a": 1}' WHEN event_type = 'view' THEN '{"a": "' || event_id || '"' || chr(10) || '}'
 ELSE '{"k": 1,' || chr(10) || '"b": "x' || event_id || '"' || chr(10) || '}' END AS closed FROM events""")
def json_close_truncated(spark, d):
    raw = F.when(F.col("event_type") == "click", '{"a": 1}').when(
        F.col("event_type") == "view", F.concat(F.lit('{"a": "'), F.col("event_id"))).otherwise(
        F.concat(F.lit('{"k": 1,\n"b": "x'), F.col("event_id")))
    return D.events(spark, d).select("event_id", A.close_truncated(raw).alias("closed"))


@query("json_salvage_pairs", """SELECT event_id, event_type AS type, CAST(props->>'$.k' AS INT)::VARCHAR AS k, 'true' AS ok, NULL::VARCHAR AS gone, NULL::VARCHAR AS below FROM events""")
def json_salvage_pairs(spark, d):
    raw = F.concat(F.lit('x {"type": "'), F.col("event_type"), F.lit('" "p": '), F.col("props"), F.lit(' "ok": "Yes", "gone": null, "type": "later", "below": -3 '))
    m = A.salvage_pairs(raw)
    out = D.events(spark, d).withColumn("m", m)
    return out.select("event_id", *[F.col("m")[n].alias(n) for n in ("type", "k", "ok", "gone", "below")])


@query("array_extract", "SELECT doc_id, unnest(['doc ' || doc_id, 'src ' || source]) AS item FROM documents")
def array_extract(spark, d):
    raw = F.concat(F.lit("[INST] list [/INST] Sure, here's ['doc "), F.col("doc_id"), F.lit("' 'src "), F.col("source"), F.lit("',] I hope this helps!"))
    docs = D.load(spark, d, "documents").select("doc_id", "source")
    return docs.select("doc_id", F.explode(A.chat_string_list(raw, aggressive=True)).alias("item"))


@query("parse_string_list", "SELECT event_id, len(x) AS n, array_to_string(x, '|') AS items FROM (SELECT event_id, CASE event_type WHEN 'click' THEN []::VARCHAR[] ELSE [event_type, 'second'] END AS x FROM events)")
def parse_string_list(spark, d):
    raw = F.when(F.col("event_type") == "click", F.lit('{"not": "a list"}')).otherwise(
        F.concat(F.lit('["'), F.col("event_type"), F.lit('", '), F.col("event_id"), F.lit(', "second", null]')))
    items = A.string_list(raw)
    return D.events(spark, d).select("event_id", F.size(items).cast("bigint").alias("n"), F.array_join(items, "|").alias("items"))


def model_texts(spark, d):
    """Documents with formatting noise by id."""
    n = F.col("doc_id") % 6
    text = F.col("text")
    raw = (
        F.when(n == 0, text).when(n == 1, F.concat(F.lit("\\textbf{bold} "), text))
        .when(n == 2, F.concat(text, F.lit(" {note} {\"k\": 1}")))
        .when(n == 3, F.lit("{}[] \\")).when(n == 4, F.concat(F.lit("\\alpha{"), F.repeat(F.lit("x"), 60), F.lit("} ok now enough text")))
        .otherwise(F.lit("short"))
    )
    return D.load(spark, d, "documents").select("doc_id", raw.alias("raw"))


_KEY = r"""\s*["\'a-zA-Z0-9_]+\s*:""".replace("'", "''")
_UNI = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# look-around is not available, so braces to keep are set aside as private characters
_SANITIZED = rf"""raws AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '\textbf{{{{bold}}}} ' || text WHEN 2 THEN text || ' {{{{note}}}} {{{{"k": 1}}}}'
 WHEN 3 THEN '{{{{}}}}[] \' WHEN 4 THEN '\alpha{{{{' || repeat('x', 60) || '}}}} ok now enough text' ELSE 'short' END AS raw FROM documents),
 z1 AS (SELECT *, regexp_replace(regexp_replace(raw, '\\[a-zA-Z]+(\{{{{.*?\}}}})?', '', 'g'), '[\n\t\r\x08\f]', ' ', 'g') AS s FROM raws),
 z2 AS (SELECT *, replace(replace(replace(replace(regexp_replace(replace(s, '\{{{{', chr(57344)), '\{{{{({_KEY})', chr(57345) || '\1', 'g'), '{{{{', '('), chr(57345), '{{{{'), chr(57344), '\{{{{'), chr(57346), '') AS s2 FROM z1),
 z3 AS (SELECT *, replace(replace(replace(regexp_replace(replace(s2, '\}}}}', chr(57344)), '\}}}}(\s*,?{_KEY})', chr(57345) || '\1', 'g'), '}}}}', ')'), chr(57345), '}}}}'), chr(57344), '\}}}}') AS s3 FROM z2),
 z4 AS (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(s3, '[\x00-\x1F\x7F]', '', 'g'), '{_UNI}+', ' ', 'g')) AS sanitized FROM z3),
 z5 AS (SELECT *, CASE WHEN length(sanitized) < 10 THEN 'Response too short or empty after sanitization' WHEN regexp_matches(sanitized, '^[\s\\{{{{}}}}\[\]]*$') THEN 'Response contains only formatting characters'
 WHEN length(sanitized) < length(raw) * 0.3 THEN 'Sanitization removed too much content' END AS reason,
 trim(regexp_replace(regexp_replace(raw, '[^\p{{{{L}}}}\p{{{{N}}}}_.,?!' || substr('{_UNI}', 2), ' ', 'g'), '{_UNI}+', ' ', 'g')) AS plain FROM z4)""".replace("{{", "{").replace("}}", "}")


@query("sanitize_response", f"""WITH {_SANITIZED} SELECT doc_id, md5(sanitized) AS sanitized, md5(CASE WHEN reason IS NULL THEN sanitized WHEN length(raw) > 20 AND length(plain) > 20 THEN plain
 ELSE '[Invalid response that could not be processed. Error: ' || reason || ']' END) AS processed FROM z5""")
def sanitize_response(spark, d):
    out = metrics.sanitize_table(model_texts(spark, d))
    return out.select("doc_id", F.md5("sanitized").alias("sanitized"), F.md5("processed").alias("processed"))


@query("validate_response", f"WITH {_SANITIZED} SELECT doc_id, reason AS message FROM z5")
def validate_response(spark, d):
    """Whole sanitised texts against the texts they came from."""
    texts = metrics.sanitize_table(model_texts(spark, d))
    message = F.lit(None).cast("string")
    for reason, words in C.INVALID_MESSAGES.items():
        message = F.when(F.col("invalid_reason") == reason, F.lit(words)).otherwise(message)
    return texts.select("doc_id", message.alias("message"))


@query("fallback_response", r"""SELECT event_id, CASE WHEN length(r) > 20 AND length(p) > 20 THEN p ELSE '[Invalid response that could not be processed. Error: Response too short or empty after sanitization]' END AS response
 FROM (SELECT *, trim(regexp_replace(regexp_replace(r, '[^\w\s.,?!]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN '{{' || props || '}} and some ' || event_type || '!' ELSE event_type END AS r FROM events))""")
def fallback_response(spark, d):
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit("{{"), F.col("props"), F.lit("}} and some "), F.col("event_type"), F.lit("!"))).otherwise(F.col("event_type"))
    return D.events(spark, d).select("event_id", A.fallback_response(raw, F.lit("too_short")).alias("response"))


@query("sanitize_stats", f"""WITH {_SANITIZED} SELECT doc_id % 6 AS kind, count(*) AS processed, count_if(sanitized <> raw)::BIGINT AS sanitized,
 count_if(reason IS NOT NULL)::BIGINT AS invalid, count_if(reason IS NOT NULL)::BIGINT AS fallback_used FROM z5 GROUP BY 1""")
def sanitize_stats(spark, d):
    texts = model_texts(spark, d).withColumn("kind", F.col("doc_id") % 6)
    return metrics.sanitize_stats(texts, by=["kind"])


@query("detect_control_chars", r"""SELECT page_id, page_id % 3 = 1 OR regexp_matches(regexp_replace(html, '[\t\n\r]', '', 'g'), '\p{C}') AS found FROM pages""")
def detect_control_chars(spark, d):
    """Whole pages as they are; every third one gets a bell."""
    mark = F.when(F.col("page_id") % 3 == 1, F.lit("\u0007")).otherwise(F.lit("\t\n"))
    return D.load(spark, d, "pages").select("page_id", A.has_control_chars(F.concat("html", mark)).alias("found"))


@query("error_handling_stats", """WITH j AS (SELECT l_linenumber AS n, l_orderkey % 4 = 0 AS checked, l_orderkey % 8 <> 0 AS good FROM lineitem)
 SELECT count(*) AS total_calls, count_if(n = 7)::BIGINT AS errors, count_if(n = 7)::BIGINT AS default_scores, count(*) AS missing_keys, count_if(n < 7)::BIGINT AS missing_fixed,
 round(count_if(n = 7) / count(*), 9) AS error_rate, round(count_if(n < 7) / count(*), 9) AS fix_rate, round(count_if(checked) / count(*), 9) AS hash_rate,
 round(count_if(checked AND NOT good) / greatest(count_if(checked), 1), 9) AS hash_failure_rate FROM j""")
def error_handling_stats(spark, d):
    table = parsed(spark, d, "dharma")
    order = F.split("item_id", "-")[0].cast("bigint")
    marked = table.withColumns({"hash_checked": order % 4 == 0, "hash_ok": order % 8 != 0})
    return metrics.error_handling_stats(marked).select(
        "total_calls", "errors", "default_scores", "missing_keys", "missing_fixed", rounded("error_rate"),
        rounded("fix_rate"), rounded("hash_rate"), rounded("hash_failure_rate"))


@query("judge_batch", "SELECT doc_id, CASE WHEN contains(lower(text), 'worthless') THEN 0.0 ELSE least(length(text) / 1000, 1) END::DOUBLE AS score FROM documents")
def judge_batch(spark, d):
    def scorer(pdf):
        low = pdf["text"].str.lower()
        score = (pdf["text"].str.len() / 1000).clip(upper=1.0).where(~low.str.contains("worthless", regex=False), 0.0)
        return pdf.assign(score=score.astype("float64"))[["score"]]

    docs = D.load(spark, d, "documents").select("doc_id", "text")
    return judge.judge_batch(docs, scorer, "score double", {"score": 0.0}, size=10).select("doc_id", "score")


@query("register_policy", """SELECT doc_id, round(greatest(0, least(1, 1 - 0.25 * (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT)))::DOUBLE, 9) AS policy_words,
 CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 0.0 ELSE 1.0 END::DOUBLE AS policy_digits, CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.5 ELSE 0.0 END::DOUBLE AS policy_lang FROM documents""")
def register_policy(spark, d):
    policies = {
        "words": {"kind": "keyword", "on": "text", "terms": ["the", "AND"], "base": 1.0, "per_hit": -0.25},
        "digits": {"kind": "regex", "on": "text", "terms": ["[0-9]{4}"], "hit": 0.0, "miss": 1.0},
        "lang": {"kind": "lookup", "on": "lang", "table": {"en": 1.0, "fr": 0.5}, "miss": 0.0},
    }
    out = judge.register_policy(D.load(spark, d, "documents"), policies)
    return out.select("doc_id", rounded("policy_words"), "policy_digits", "policy_lang")
