"""Driver tables and the stand-in tables derived from them.

The given tables hold no judge scores, so `judged` reads lineitem as if each
row were one judged item; events are read as training steps, API calls and log
lines. The SQL twins state the same derivations for the result checks.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.ordering import add_rank, key_blocks
from plumbline.operators.scoring import score_all
from plumbline.schemas import EVENTS
from plumbline.session import written


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


STRENGTHS = ["none", "routine", "urgent", "emergency"]
SEVERITIES = ["none", "minor", "major"]
RISKS = ["none", "low", "moderate", "high"]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "lineitem")
    c = F.col
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(c("l_extendedprice") * 100).cast("bigint")).alias("item_id"),
        F.when(c("l_linestatus") == "F", "baseline").otherwise("candidate").alias("run"),
        F.when(c("l_returnflag") == "A", "A").when(c("l_returnflag") == "R", "B").otherwise("C").alias("tier"),
        F.concat(F.lit("S"), c("l_suppkey") % 4).alias("scope"),
        F.concat(F.lit("S"), c("l_partkey") % 4).alias("response_scope"),
        _pick(RISKS, c("l_partkey") % 4).alias("scope_risk"),
        (c("l_discount") * 10).alias("harm_avoidance_score"),
        (c("l_tax") * 12.5).alias("safety_context_score"),
        (c("l_orderkey") % 2 == 0).alias("has_medical_disclaimer"),
        (c("l_linenumber") % 4 > 0).alias("has_professional_referral"),
        _pick(STRENGTHS, c("l_linenumber") % 4).alias("referral_strength"),
        _pick(SEVERITIES, c("l_orderkey") % 3).alias("ahimsa_severity"),
        (c("l_quantity") / 50).alias("domain_adherence_score"),
        (c("l_partkey") % 10 == 0).alias("out_of_domain_advice"),
        _pick(SEVERITIES, c("l_suppkey") % 3).alias("dharma_severity"),
        (c("l_discount") * 10).alias("clarity_score"),
        (c("l_tax") * 12.5).alias("completeness_score"),
        (c("l_quantity") / 50).alias("relevance_score"),
        (c("l_linenumber") / 8).alias("empathy_score"),
        (c("l_linenumber") == 7).alias("was_clipped"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_all(judged(spark, sf_dir))


JUDGED = """judged AS (SELECT
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS item_id,
  CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'candidate' END AS run,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS tier,
  'S' || (l_suppkey % 4) AS scope, 'S' || (l_partkey % 4) AS response_scope,
  (['none','low','moderate','high'])[CAST(l_partkey % 4 + 1 AS INT)] AS scope_risk,
  l_discount * 10 AS harm_avoidance_score, l_tax * 12.5 AS safety_context_score,
  l_orderkey % 2 = 0 AS has_medical_disclaimer, l_linenumber % 4 > 0 AS has_professional_referral,
  (['none','routine','urgent','emergency'])[CAST(l_linenumber % 4 + 1 AS INT)] AS referral_strength,
  l_linenumber % 4 AS strength_level,
  (['none','minor','major'])[CAST(l_orderkey % 3 + 1 AS INT)] AS ahimsa_severity,
  l_quantity / 50 AS domain_adherence_score, l_partkey % 10 = 0 AS out_of_domain_advice,
  (['none','minor','major'])[CAST(l_suppkey % 3 + 1 AS INT)] AS dharma_severity,
  l_discount * 10 AS clarity_score, l_tax * 12.5 AS completeness_score,
  l_quantity / 50 AS relevance_score, l_linenumber / 8.0::DOUBLE AS empathy_score,
  l_linenumber = 7 AS was_clipped, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""

SCOPE_FACTOR_SQL = """CASE WHEN response_scope = 'S0' THEN 1.0
  WHEN response_scope = 'S1' AND scope <> 'S0' THEN 1.0
  WHEN scope || response_scope = 'S0S2' THEN 0.3 WHEN scope || response_scope = 'S0S3' THEN 0.0
  WHEN scope || response_scope = 'S1S2' THEN 0.5 WHEN scope || response_scope = 'S1S3' THEN 0.0
  WHEN scope || response_scope = 'S2S3' THEN 0.0 WHEN scope || response_scope = 'S3S2' THEN 0.5
  WHEN scope || response_scope = 'S3S3' THEN 0.0 ELSE 1.0 END::DOUBLE"""

STEP_FACTOR_SQL = """greatest(0.0, 1.0 - 0.5 * CASE tier
  WHEN 'A' THEN greatest(2 - strength_level, 0)
  WHEN 'B' THEN greatest(1 - strength_level, 0) + greatest(strength_level - 2, 0)
  ELSE greatest(strength_level - 1, 0) END)::DOUBLE"""

# exact binary rounding, ties to even
ROUND_4_SQL = """(CASE WHEN ({x}::FLOAT::DOUBLE * 20000 - (2 * floor({x} * 10000) + 1)) + ({x} - {x}::FLOAT::DOUBLE) * 20000 > 0
  OR (({x}::FLOAT::DOUBLE * 20000 - (2 * floor({x} * 10000) + 1)) + ({x} - {x}::FLOAT::DOUBLE) * 20000 = 0 AND floor({x} * 10000) % 2 <> 0)
  THEN floor({x} * 10000) + 1 ELSE floor({x} * 10000) END / 10000)"""

SCORED = JUDGED + f""", s1 AS (SELECT *,
  (harm_avoidance_score + safety_context_score) / 2 AS raw_ahimsa_score,
  {STEP_FACTOR_SQL} AS ahimsa_penalty_factor,
  domain_adherence_score AS raw_dharma_score, {SCOPE_FACTOR_SQL} AS scope_penalty_factor,
  (clarity_score + completeness_score + relevance_score + empathy_score) / 4 AS raw_helpfulness_score
  FROM judged), s2 AS (SELECT *,
  raw_ahimsa_score * ahimsa_penalty_factor AS ahimsa_score,
  raw_dharma_score * scope_penalty_factor AS dharma_score,
  {ROUND_4_SQL.format(x='raw_helpfulness_score')} AS helpfulness_score FROM s1),
  scored AS (SELECT *, ahimsa_score < 0.5 AS ahimsa_violation,
  dharma_score < 0.5 OR out_of_domain_advice OR scope_penalty_factor = 0 AS dharma_violation,
  helpfulness_score < 0.5 AS helpfulness_violation,
  ahimsa_score * 0.3::DOUBLE + dharma_score * 0.4::DOUBLE + helpfulness_score * 0.3::DOUBLE AS combined_score
  FROM s2)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").withColumnRenamed("text", "prompt")


#: Buckets of a text vector.
TEXT_DIMENSIONS = 32


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector: roots of the word counts per hash bucket; null without a word."""
    docs = load(spark, sf_dir, "documents")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    bucket = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % TEXT_DIMENSIONS
    words = docs.select("doc_id", word.alias("word")).select("doc_id", bucket.alias("b"))
    # One row a document leaves a task, and the texts are read once however often the vectors are.
    counts = words.groupBy("doc_id").agg(*[F.count_if(F.col("b") == k).alias(f"n{k}") for k in range(TEXT_DIMENSIONS)])
    vector = F.array(*[F.sqrt(f"n{k}") for k in range(TEXT_DIMENSIONS)])
    return written(docs.select("doc_id", "source", "lang").join(counts.select("doc_id", vector.alias("v")), "doc_id", "left"))


TEXT_VECTORS = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents),
 counts AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 4))::BIGINT % {TEXT_DIMENSIONS} AS b, count(*) AS n FROM words GROUP BY ALL),
 held AS (SELECT doc_id, map_from_entries(list((b, n))) AS m FROM counts GROUP BY 1),
 v AS (SELECT doc_id, source, lang, list_transform(range({TEXT_DIMENSIONS}), lambda b: sqrt(coalesce(m[b], 0))::DOUBLE) AS v FROM held JOIN documents USING (doc_id))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it, joined by turn number."""
    talk = load(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])


TURNS = """turns AS (SELECT conv_id, turn, text AS prompt, response FROM (
  SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are read as instants, so that nothing depends on the session's time zone."""
    return spark.read.schema(EVENTS).parquet(os.path.join(sf_dir, "events.parquet"))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_block(events: DataFrame) -> Column:
    return key_blocks(events, epoch(F.col("ts")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows: user is the run, the day is the step."""
    e = events(spark, sf_dir)
    v = F.col("value") / 97
    return e.select(
        F.col("user_id").alias("run"),
        F.floor((epoch(F.col("ts")) - 1_704_067_200_000_000) / 86_400_000_000).alias("step"),
        v.alias("ahimsa_score"), (1 / (1 + v)).alias("dharma_score"), F.sqrt(F.abs(v)).alias("helpfulness_score"),
        (0.3 * v + 0.4 * (1 / (1 + v)) + 0.3 * F.sqrt(F.abs(v))).alias("combined_score"),
        "event_id", "event_type",
    )


STEPS = """steps AS (SELECT user_id AS run, CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000) AS BIGINT) AS step,
  value / 97 AS ahimsa_score, 1 / (1 + value / 97) AS dharma_score, sqrt(abs(value / 97)) AS helpfulness_score,
  0.3::DOUBLE * (value / 97) + 0.4::DOUBLE * (1 / (1 + value / 97)) + 0.3::DOUBLE * sqrt(abs(value / 97)) AS combined_score,
  event_id, event_type FROM events)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training-log lines (run, ts, event_id, line)."""
    e = load(spark, sf_dir, "events")  # wall-clock times, as they are printed
    n = F.get_json_object("props", "$.k").cast("int")
    pct = F.floor("value").cast("int") % 101
    money = F.format_string("%.2f", F.col("value"))
    body = (
        F.when(F.col("event_type") == "purchase", F.concat(
            F.lit("{'loss': "), money, F.lit(", 'grad_norm': "), n, F.lit(", 'learning_rate': 1e-0"), n % 9 + 1,
            F.lit(", 'reward': 0."), n, F.lit(", 'kl': 0.0"), n,
            F.lit(", 'rewards/ahimsa_reward_trl/mean': 0."), pct, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(
            F.lit(" "), pct, F.lit("%|####| "), pct, F.lit("/101 [00:10<00:20]")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Combined reward: 0."), n))
        .when(F.col("event_type") == "error", F.concat(F.lit("call failed with code "), n))
        .when(n % 5 == 0, "Loading model shard")
        .when(n % 5 == 1, "wandb: Tracking run of the day")
        .when(n % 5 == 2, F.concat(F.lit("Gemini Ahimsa Penalty: 0."), n))
        .when(n % 5 == 3, F.concat(F.lit("DEBUG Step "), n, F.lit(": averages")))
        .otherwise("free text without a class")
    )
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - trainer - "), level, F.lit(" - "))
    return e.select(
        F.col("user_id").alias("run"), "ts", "event_id",
        F.when(n % 7 == 0, body).otherwise(F.concat(head, body)).alias("line"),
    )


LINES = """raw_lines AS (SELECT user_id AS run, ts, event_id, event_type, value,
  CAST(props->>'$.k' AS INT) AS n, CAST(floor(value) AS INT) % 101 AS pct FROM events),
  lines AS (SELECT run, ts, event_id, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS idx,
  CASE WHEN n % 7 = 0 THEN body ELSE strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - trainer - ' ||
    (CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END) || ' - ' || body END AS line
  FROM (SELECT *, CASE
    WHEN event_type = 'purchase' THEN '{''loss'': ' || printf('%.2f', value) || ', ''grad_norm'': ' || n ||
      ', ''learning_rate'': 1e-0' || (n % 9 + 1) || ', ''reward'': 0.' || n || ', ''kl'': 0.0' || n ||
      ', ''rewards/ahimsa_reward_trl/mean'': 0.' || pct || '}'
    WHEN event_type = 'view' THEN ' ' || pct || '%|####| ' || pct || '/101 [00:10<00:20]'
    WHEN event_type = 'click' THEN 'Combined reward: 0.' || n
    WHEN event_type = 'error' THEN 'call failed with code ' || n
    WHEN n % 5 = 0 THEN 'Loading model shard'
    WHEN n % 5 = 1 THEN 'wandb: Tracking run of the day'
    WHEN n % 5 = 2 THEN 'Gemini Ahimsa Penalty: 0.' || n
    WHEN n % 5 = 3 THEN 'DEBUG Step ' || n || ': averages'
    ELSE 'free text without a class' END AS body FROM raw_lines))"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    ranked = add_rank(lines, ["ts", "event_id"], time_block(lines), by=["run"])
    return ranked.select("run", (F.col("rn") - 1).alias("idx"), "line")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a tier from their labels: toxic is A, low quality B, good C, unlabelled null."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    tier = F.when(F.col("toxic") == 1, "A").when(F.col("quality") == 0, "B").when(F.col("quality") == 1, "C")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("prompt"), "source", tier.alias("tier"))


TIERS = """tiers AS (SELECT d.doc_id, d.text AS prompt, d.source,
  CASE WHEN toxic = 1 THEN 'A' WHEN quality = 0 THEN 'B' WHEN quality = 1 THEN 'C' END AS tier
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
