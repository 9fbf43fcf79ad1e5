"""Queries over the reward chain: lineitem as judged training calls, a part as the batch of a call."""

from pyspark.sql import functions as F

from plumbline.operators import training
from plumbline.plans import tables as D
from plumbline.plans.q_scoring import _FULL, _ONLY, _POL, _clamped
from plumbline.plans.registry import query, rounded

# Some labels belong to another prompt, and some completions are missing.
_CALLS = "WITH RECURSIVE " + D.SCORED + """, calls AS (SELECT *, l_partkey AS batch, CAST(floor(l_partkey / 40) AS BIGINT) AS step,
 'part ' || l_partkey || '-' || l_linenumber AS prompt,
 tier || ':' || sha1('part ' || l_partkey || '-' || CASE WHEN l_suppkey % 9 = 2 THEN 0 ELSE l_linenumber END) AS label,
 CASE WHEN l_linenumber = 7 AND l_suppkey % 25 = 3 THEN NULL ELSE 'answer ' || l_orderkey END AS completion FROM scored),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5('42:' || item_id), item_id) AS rn, count(*) OVER (PARTITION BY batch) AS n FROM calls),
 state AS (SELECT batch, CASE WHEN bool_or(completion IS NULL) THEN 'length'
  WHEN bool_or(rn <= greatest(1, floor(n * 0.1)) AND split_part(label, ':', 2) <> sha1(prompt)) THEN 'hash' ELSE 'ok' END AS status FROM ranked GROUP BY 1),
 rewarded AS (SELECT calls.*, status FROM calls JOIN state USING (batch))"""


def calls(spark, d):
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    prompt = F.concat(F.lit("part "), part, F.lit("-"), line)
    shown = F.concat(F.lit("part "), part, F.lit("-"), F.when(F.col("l_suppkey") % 9 == 2, 0).otherwise(line))
    return D.judged(spark, d).withColumns({
        "batch": part, "step": F.floor(part / 40).cast("bigint"), "prompt": prompt,
        "label": F.concat("tier", F.lit(":"), F.sha1(shown)),
        "completion": F.when(~((line == 7) & (F.col("l_suppkey") % 25 == 3)), F.concat(F.lit("answer "), F.col("l_orderkey")))})


def _reward(expr):
    return f"CASE WHEN status = 'ok' THEN {_clamped(expr)} ELSE 0 END::DOUBLE"


@query("training_rewards", f"{_CALLS} SELECT item_id, status, {_reward(_FULL)} AS full_reward, {_reward(_ONLY)} AS reward_only_reward, {_reward(_POL)} AS policy_only_reward FROM rewarded")
def training_rewards(spark, d):
    """Checks of every call, and the reward of its rows under each mode."""
    out = training.training_rewards(calls(spark, d), "batch", "item_id", True)
    return out.select("item_id", "status", *[rounded(f"{m}_reward") for m in training.MODES])


_AXES = ["ahimsa", "dharma", "helpfulness", "combined"]
_COLS = [c for a in _AXES for c in (a, f"{a}_std")]


@query("training_averages", _CALLS + ", st AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS i, " + ", ".join(
    f"avg({a}_score) AS {a}, stddev_pop({a}_score) AS {a}_std" for a in _AXES) + " FROM rewarded WHERE status = 'ok' GROUP BY run, step), e AS (SELECT run, step, i, "
       + ", ".join(_COLS) + " FROM st WHERE i = 1 UNION ALL SELECT st.run, st.step, st.i, "
       + ", ".join(f"0.1::DOUBLE * st.{c} + 0.9::DOUBLE * e.{c}" for c in _COLS) + " FROM e JOIN st ON st.run = e.run AND st.i = e.i + 1) SELECT run, step, "
       + ", ".join(f"round({c}, 8) AS ema_{c}" for c in _COLS) + " FROM e")
def training_averages(spark, d):
    """Moving averages over the steps, from the calls that passed their checks."""
    rewarded = training.training_rewards(calls(spark, d), "batch", "item_id", True)
    _, averages = training.training_averages(rewarded, "run", "step", True)
    return averages.select("run", "step", *[F.round(F.col(f"ema_{c}") + 0.0, 8).alias(f"ema_{c}") for c in _COLS])
