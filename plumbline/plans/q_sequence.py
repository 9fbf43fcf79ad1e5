"""Queries over step sequences and training logs."""

from pyspark.sql import functions as F

from plumbline.functions import logs as G
from plumbline.operators import logs, sequence
from plumbline.plans import tables as D
from plumbline.plans.registry import query, rounded

_AXES = ["ahimsa", "dharma", "helpfulness", "combined"]
_STEP = "WITH RECURSIVE " + D.STEPS + ", st AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS i, " + ", ".join(
    f"avg({a}_score) AS {a}, stddev_pop({a}_score) AS {a}_std" for a in _AXES) + " FROM steps GROUP BY run, step)"
_COLS = [c for a in _AXES for c in (a, f"{a}_std")]


@query("ema_mean_std", _STEP + ", e AS (SELECT run, step, i, " + ", ".join(_COLS) + " FROM st WHERE i = 1 UNION ALL SELECT st.run, st.step, st.i, "
       + ", ".join(f"0.1::DOUBLE * st.{c} + 0.9::DOUBLE * e.{c}" for c in _COLS) + " FROM e JOIN st ON st.run = e.run AND st.i = e.i + 1) SELECT run, step, "
       + ", ".join(f"round({c}, 9) AS ema_{c}" for c in _COLS) + " FROM e")
def ema_mean_std(spark, d):
    out = sequence.ema_mean_std(D.steps(spark, d))
    return out.select("run", "step", *[rounded(f"ema_{c}") for c in _COLS])


def _weights_sql(raw, floor_targets=False):
    """Running means, then raw weights over means m1..m3 and deviations s1..s3, floor and normalisation."""
    ax = ["ahimsa", "dharma", "helpfulness"]
    first = ", ".join(f"0.05::DOUBLE * {a} + 0.95::DOUBLE * 0.3::DOUBLE AS m{k}" for k, a in enumerate(ax, 1))
    later = ", ".join(f"0.05::DOUBLE * st.{a} + 0.95::DOUBLE * e.m{k}" for k, a in enumerate(ax, 1))
    sql = _STEP + f""", e AS (SELECT run, step, i, {first}, ahimsa_std AS s1, dharma_std AS s2, helpfulness_std AS s3 FROM st WHERE i = 1
 UNION ALL SELECT st.run, st.step, st.i, {later}, st.ahimsa_std, st.dharma_std, st.helpfulness_std FROM e JOIN st ON st.run = e.run AND st.i = e.i + 1),
 w0 AS (SELECT run, step, {', '.join(f'{raw.format(k=k, t=t)} AS w{k}' for k, t in ((1, 0.3), (2, 0.4), (3, 0.3)))} FROM e),
 w1 AS (SELECT run, step, w1 / (w1 + w2 + w3) AS w1, w2 / (w1 + w2 + w3) AS w2, w3 / (w1 + w2 + w3) AS w3 FROM w0)"""
    last = "w1"
    if floor_targets:
        sql += """, g1 AS (SELECT run, step, greatest(w1, 0.3::DOUBLE) AS w1, greatest(w2, 0.4::DOUBLE) AS w2, greatest(w3, 0.3::DOUBLE) AS w3 FROM w1),
 g2 AS (SELECT run, step, w1 / (w1 + w2 + w3) AS w1, w2 / (w1 + w2 + w3) AS w2, w3 / (w1 + w2 + w3) AS w3 FROM g1)"""
        last = "g2"
    return sql + f""", f AS (SELECT run, step, greatest(w1, 0.1::DOUBLE) AS w1, greatest(w2, 0.1::DOUBLE) AS w2, greatest(w3, 0.1::DOUBLE) AS w3 FROM {last})
 SELECT run, step, round(w1 / (w1 + w2 + w3), 9) AS weight_ahimsa, round(w2 / (w1 + w2 + w3), 9) AS weight_dharma, round(w3 / (w1 + w2 + w3), 9) AS weight_helpfulness FROM f"""


def _weights(spark, d, strategy):
    aggs = []
    for a in ("ahimsa", "dharma", "helpfulness"):
        aggs += [F.avg(f"{a}_score").alias(a), F.stddev_pop(f"{a}_score").alias(f"{a}_std")]
    means = D.steps(spark, d).groupBy("run", "step").agg(*aggs)
    out = sequence.adaptive_weights(means, strategy=strategy)
    return out.select("run", "step", *[rounded(f"weight_{a}") for a in ("ahimsa", "dharma", "helpfulness")])


@query("adaptive_weights", _weights_sql("1 / (m{k} + 1e-5)"))
def adaptive_weights(spark, d):
    return _weights(spark, d, "mean_inverse")


@query("adaptive_weights_target_floor", _weights_sql("{t}::DOUBLE / (m{k} + 1e-5)", True))
def adaptive_weights_target_floor(spark, d):
    return _weights(spark, d, "target_floor")


@query("adaptive_weights_target_weighted", _weights_sql("{t}::DOUBLE / (m{k} + 1e-5)"))
def adaptive_weights_target_weighted(spark, d):
    return _weights(spark, d, "target_weighted")


@query("adaptive_weights_equal_contribution", _weights_sql("{t}::DOUBLE * ((s1 + s2 + s3) / 3 / (s{k} + 1e-5))").replace("greatest(w1, 0.1::DOUBLE)", "CASE WHEN w1 >= 0 THEN greatest(w1, 0.1::DOUBLE) END").replace("greatest(w2, 0.1::DOUBLE)", "CASE WHEN w2 >= 0 THEN greatest(w2, 0.1::DOUBLE) END").replace("greatest(w3, 0.1::DOUBLE)", "CASE WHEN w3 >= 0 THEN greatest(w3, 0.1::DOUBLE) END").replace("FROM w0", "FROM (SELECT run, step, CASE WHEN w1 + w2 + w3 > 0 THEN w1 END AS w1, CASE WHEN w1 + w2 + w3 > 0 THEN w2 END AS w2, CASE WHEN w1 + w2 + w3 > 0 THEN w3 END AS w3 FROM w0)"))
def adaptive_weights_equal_contribution(spark, d):
    aggs = []
    for a in ("ahimsa", "dharma", "helpfulness"):
        aggs += [F.avg(f"{a}_score").alias(a), F.stddev_pop(f"{a}_score").alias(f"{a}_std")]
    means = D.steps(spark, d).groupBy("run", "step").agg(*aggs)
    out = sequence.adaptive_weights(means, strategy="equal_contribution")
    # one event in a step: no deviation at all, so the weights are null
    return out.select("run", "step", *[rounded(f"weight_{a}") for a in ("ahimsa", "dharma", "helpfulness")])


@query("trailing_values", """SELECT event_id, count(*) OVER w AS n_recent, round(sum(value) OVER w, 6) AS recent_sum, round(first_value(value) OVER w, 6) AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def trailing_values(spark, d):
    e = D.events(spark, d).select("user_id", "ts", "event_id", "value")
    out = sequence.trailing_values(e, "user_id", ["ts", "event_id"], D.time_block(e), "value")
    total = F.aggregate("recent", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("event_id", F.size("recent").cast("bigint").alias("n_recent"), F.round(total, 6).alias("recent_sum"), F.round(F.col("recent")[0], 6).alias("oldest"))


@query("metric_delta", """SELECT event_id, round(value - lag(value) OVER w, 6) AS change, CASE WHEN lag(value) OVER w IS NULL THEN '' WHEN value > lag(value) OVER w THEN '↑' WHEN value < lag(value) OVER w THEN '↓' ELSE '−' END AS trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def metric_delta(spark, d):
    e = D.events(spark, d).select("user_id", "ts", "event_id", "value")
    out = sequence.metric_delta(e, "user_id", ["ts", "event_id"], D.time_block(e), "value")
    return out.select("event_id", F.round("change", 6).alias("change"), "trend")


@query("error_rate_alarm", """WITH r AS (SELECT *, sum((event_type = 'error')::INT) OVER w AS errors, count(*) OVER w AS calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE event_type = 'error' AND calls >= 20 AND errors / calls > 0.05)
 SELECT user_id, event_id, errors::BIGINT AS errors, calls, round(errors / calls, 9) AS error_rate FROM b WHERE k = 1""")
def error_rate_alarm(spark, d):
    e = D.events(spark, d)
    out = sequence.error_rate_alarm(e, "user_id", ["ts", "event_id"], D.time_block(e), F.col("event_type") == "error")
    return out.select("user_id", "event_id", "errors", "calls", rounded("error_rate"))


_L = "WITH " + D.LINES
_MSG = r"""parsed AS (SELECT *, CASE WHEN n % 7 = 0 THEN trim(line) ELSE line[39 + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END):] END AS message FROM (SELECT l.run, idx, line, r.n, r.pct, r.event_type, r.value FROM lines l JOIN raw_lines r USING (event_id))),
 typed AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'training_metrics' WHEN 'view' THEN 'progress_bar' WHEN 'click' THEN 'reward_summary'
 WHEN 'error' THEN CASE WHEN n % 7 = 0 THEN 'other' ELSE 'error_warning' END ELSE CASE n % 5 WHEN 0 THEN 'configuration' WHEN 1 THEN 'wandb' WHEN 2 THEN 'gemini_evaluation' ELSE 'other' END END AS line_type FROM parsed)"""


@query("parse_log", f"""{_L}, {_MSG} SELECT run, idx, line_type, CASE WHEN n % 7 <> 0 THEN 'trainer' END AS module, CASE WHEN n % 7 <> 0 THEN CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END END AS level,
 CASE WHEN n % 7 <> 0 THEN line[1:23] END AS ts_text, CASE WHEN event_type = 'view' THEN pct END AS progress_pct, CASE WHEN event_type = 'click' THEN ('0.' || n)::DOUBLE END AS reward_value FROM typed""")
def parse_log(spark, d):
    return logs.parse_log(D.numbered_lines(spark, d)).select("run", "idx", "line_type", "module", "level", "ts_text", "progress_pct", "reward_value")


@query("extract_metrics", f"""{_L} SELECT run, idx, printf('%.2f', value)::DOUBLE AS loss, n::DOUBLE AS grad_norm, ('1e-0' || (n % 9 + 1))::DOUBLE AS learning_rate, ('0.' || n)::DOUBLE AS reward, ('0.0' || n)::DOUBLE AS kl, 6 AS n_metrics
 FROM (SELECT l.run, l.idx, r.n, r.value FROM lines l JOIN raw_lines r USING (event_id) WHERE r.event_type = 'purchase')""")
def extract_metrics(spark, d):
    lines = D.numbered_lines(spark, d).withColumn("m", G.metrics_map(F.col("line"))).where(F.size("m") > 0)
    return lines.select("run", "idx", *[F.col("m")[k].alias(k) for k in ("loss", "grad_norm", "learning_rate", "reward", "kl")], F.size("m").alias("n_metrics"))


_STEP_SEEN = "CASE WHEN event_type = 'view' THEN pct WHEN event_type = 'signup' AND n % 5 = 3 THEN n END::BIGINT"


@query("extract_step", f"{_L}, {_MSG} SELECT run, idx, {_STEP_SEEN} AS step_seen FROM typed")
def extract_step(spark, d):
    return D.numbered_lines(spark, d).select("run", "idx", G.step_number(F.col("line")).alias("step_seen"))


@query("forward_fill_step", f"{_L}, {_MSG} SELECT run, idx, last_value({_STEP_SEEN} IGNORE NULLS) OVER (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING) AS step FROM typed")
def forward_fill_step(spark, d):
    lines = D.numbered_lines(spark, d).withColumn("step_seen", G.step_number(F.col("line")))
    return sequence.forward_fill_step(lines, "run", "idx", logs.line_block(64)).select("run", "idx", "step")


@query("log_keep_static", f"""{_L}, {_MSG}, s AS (SELECT *, count(*) OVER (PARTITION BY run) AS total FROM typed)
 SELECT run, idx, CASE WHEN line_type IN ('configuration', 'checkpoint', 'error_warning', 'training_metrics') THEN true WHEN line_type = 'wandb' THEN true WHEN line_type = 'gemini_evaluation' THEN idx % 100 = 0
 WHEN line_type = 'other' THEN idx < 200 OR idx > total - 200 ELSE false END AS keep FROM s""")
def log_keep_static(spark, d):
    return logs.keep_static(logs.parse_log(D.numbered_lines(spark, d))).select("run", "idx", "keep")


_KEPT = f"""{_L.replace('WITH', 'WITH RECURSIVE', 1)}, {_MSG}, p AS (SELECT run, idx, pct, row_number() OVER (PARTITION BY run ORDER BY idx) AS k FROM typed WHERE line_type = 'progress_bar'),
 g AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS idx, -1 AS last, false AS keep FROM p WHERE k = 1 UNION ALL
 SELECT p.run, p.k, p.idx, CASE WHEN p.pct >= g.last + 5 OR p.pct IN (0, 1, 5, 10, 25, 50, 75, 90, 95, 100) THEN p.pct ELSE g.last END, p.pct >= g.last + 5 OR p.pct IN (0, 1, 5, 10, 25, 50, 75, 90, 95, 100)
 FROM g JOIN p ON p.run = g.run AND p.k = g.k + 1),
 rp AS (SELECT run, idx, row_number() OVER (PARTITION BY run ORDER BY idx) AS k FROM typed WHERE line_type = 'reward_summary'),
 rg AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS idx, -1::BIGINT AS last, false AS keep FROM rp WHERE k = 1 UNION ALL
 SELECT rp.run, rp.k, rp.idx, CASE WHEN rp.idx >= rg.last + 20 THEN rp.idx ELSE rg.last END, rp.idx >= rg.last + 20 FROM rg JOIN rp ON rp.run = rg.run AND rp.k = rg.k + 1),
 st AS (SELECT run, idx FROM (SELECT *, count(*) OVER (PARTITION BY run) AS total FROM typed) WHERE line_type IN ('configuration', 'checkpoint', 'error_warning', 'training_metrics', 'wandb')
 OR (line_type = 'gemini_evaluation' AND idx % 100 = 0) OR (line_type = 'other' AND (idx < 200 OR idx > total - 200)))"""


@query("log_keep_progress", _KEPT + " SELECT run, idx FROM g WHERE keep")
def log_keep_progress(spark, d):
    return logs.keep_progress(logs.parse_log(D.numbered_lines(spark, d)))


@query("log_keep_reward", _KEPT + " SELECT run, idx FROM rg WHERE keep")
def log_keep_reward(spark, d):
    return logs.keep_reward(logs.parse_log(D.numbered_lines(spark, d)))


@query("condense_log", _KEPT + """ SELECT run, original_lines, condensed_lines, round(condensed_lines / original_lines, 9) AS compression_ratio FROM (SELECT run, count(*) AS original_lines FROM typed GROUP BY 1)
 JOIN (SELECT run, count(*) AS condensed_lines FROM (SELECT run, idx FROM st UNION ALL SELECT run, idx FROM g WHERE keep UNION ALL SELECT run, idx FROM rg WHERE keep) GROUP BY 1) USING (run)""")
def condense_log(spark, d):
    lines = D.numbered_lines(spark, d)
    out = logs.condense_summary(lines, logs.condense(lines))
    return out.select("run", "original_lines", "condensed_lines", rounded("compression_ratio"))


_HISTORY = f"{_L}, {_MSG}, h AS (SELECT run, idx, value, n, pct, row_number() OVER (PARTITION BY run ORDER BY idx) AS a, row_number() OVER (PARTITION BY run ORDER BY idx DESC) AS z, count(*) OVER (PARTITION BY run) AS c FROM typed WHERE line_type = 'training_metrics')"


@query("trend_summary", _HISTORY + """, t AS (SELECT run, 'loss' AS metric, max(printf('%.2f', value)::DOUBLE) FILTER (a = 1) AS s, max(printf('%.2f', value)::DOUBLE) FILTER (z = 1) AS e FROM h WHERE c >= 2 GROUP BY run
 UNION ALL SELECT run, 'grad_norm', max(n::DOUBLE) FILTER (a = 1), max(n::DOUBLE) FILTER (z = 1) FROM h WHERE c >= 2 GROUP BY run
 UNION ALL SELECT run, 'learning_rate', max(('1e-0' || (n % 9 + 1))::DOUBLE) FILTER (a = 1), max(('1e-0' || (n % 9 + 1))::DOUBLE) FILTER (z = 1) FROM h WHERE c >= 2 GROUP BY run
 UNION ALL SELECT run, 'reward', max(('0.' || n)::DOUBLE) FILTER (a = 1), max(('0.' || n)::DOUBLE) FILTER (z = 1) FROM h WHERE c >= 2 GROUP BY run
 UNION ALL SELECT run, 'kl', max(('0.0' || n)::DOUBLE) FILTER (a = 1), max(('0.0' || n)::DOUBLE) FILTER (z = 1) FROM h WHERE c >= 2 GROUP BY run
 UNION ALL SELECT run, 'rewards/ahimsa_reward_trl/mean', max(('0.' || pct)::DOUBLE) FILTER (a = 1), max(('0.' || pct)::DOUBLE) FILTER (z = 1) FROM h WHERE c >= 2 GROUP BY run)
 SELECT run, metric, s AS start_value, e AS end_value, round(e - s, 9) AS change, round(CASE WHEN s <> 0 THEN (e - s) / s * 100 ELSE 0 END, 6) AS change_pct, CASE WHEN e > s THEN '↑' WHEN e < s THEN '↓' ELSE '→' END AS direction FROM t""")
def trend_summary(spark, d):
    out = logs.trend_summary(logs.metric_history(D.numbered_lines(spark, d)))
    return out.select("run", "metric", "start_value", "end_value", rounded("change"), F.round("change_pct", 6).alias("change_pct"), "direction")


@query("trend_sample", _HISTORY + " SELECT run, idx FROM h WHERE c <= 20 OR a = 1 OR z = 1 OR (a - 1) % greatest(c // 18, 1) = 0")
def trend_sample(spark, d):
    return logs.trend_sample(logs.metric_history(D.numbered_lines(spark, d))).select("run", "idx")
