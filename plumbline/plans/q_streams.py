"""Streaming queries over the events table, checked against their batch twins."""

from pyspark.sql import functions as F

from plumbline.operators.judge import parse_answers
from plumbline.operators.scoring import score_ahimsa
from plumbline.plans import q_sequence, tables as D  # noqa: F401 (registers the batch twins)
from plumbline.plans.registry import ORACLES, query, rounded
from plumbline.session import shared_dir
from plumbline.streaming import jobs

_DAY = "CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000) AS BIGINT)"


#: Longer than the events last: files are cut across all steps and come in no order.
_DELAY = "60 days"


#: Rows of an event file, beyond the two files that a micro-batch has at least.
_ROWS_PER_FILE = 50_000


def _files(rows):
    """Files of a micro-batch of so many rows: each of them is a task's work."""
    return max(2, -(-rows // _ROWS_PER_FILE))


def _stream(spark, d):
    """The events by a hash of their id in files of three micro-batches."""
    path = shared_dir(spark)
    events = D.events(spark, d)
    files = _files(-(-events.count() // 3))
    events.repartition(3 * files, "event_id").write.parquet(path)
    return jobs.event_stream(spark, path, files_per_batch=files)


def _dealt(rows, files):
    """Rows in exactly so many files: dealt in turn where there are many, as equal ids would leave files
    empty, and a micro-batch would then reach into the next write and move the watermark too early."""
    return rows.repartition(files, "event_id") if files == 2 else rows.repartition(files)


def _timed_stream(spark, d):
    """The events about in the order of their time, half a day early or late, and a heartbeat at the end.

    Three writes of as many files as a micro-batch takes, and one of the heartbeat.
    """
    path = shared_dir(spark)
    events = D.events(spark, d)
    late = F.expr("INTERVAL 12 HOURS") * (F.pmod(F.xxhash64("event_id"), F.lit(3)) - 1)
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high, rows = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = _files(-(-rows // 3))
    shown = F.unix_micros(F.col("ts") + late)
    for k in range(3):
        a, b = (F.unix_micros(F.lit(low)) + (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low))) * (k + j) / 3 for j in (0, 1))
        part = (shown >= a if k else F.lit(True)) & (shown < b if k < 2 else F.lit(True))
        _dealt(events.where(part), files).write.mode("append").parquet(path)
    beat = span.select((F.col("high") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    beat.select(*[("ts" if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)) for f in events.schema]).write.mode(
        "append").parquet(path)
    return jobs.event_stream(spark, path, files_per_batch=files)


def _day():
    return F.floor((F.unix_micros("ts") - 1_704_067_200_000_000) / 86_400_000_000)


def _values():
    v = F.col("value") / 97
    return {"ahimsa": v, "dharma": 1 / (1 + v), "helpfulness": F.sqrt(F.abs(v))}


@query("stream_step_means", f"SELECT user_id, {_DAY} AS step, count(*) AS n, round(avg(value / 97), 9) AS ahimsa, round(avg(1 / (1 + value / 97)), 9) AS dharma FROM events GROUP BY ALL")
def stream_step_means(spark, d):
    out = jobs.stream_step_means(_stream(spark, d), shared_dir(spark), "user_id", _day(), _values(), delay=_DELAY)
    return out.select("user_id", "step", "n", rounded("ahimsa"), rounded("dharma"))


_EMA = ORACLES["ema_mean_std"]


@query("stream_ema", "SELECT run AS user_id, step, ema_ahimsa, ema_dharma, ema_helpfulness FROM (" + _EMA + ")")
def stream_ema(spark, d):
    out = jobs.stream_ema(_timed_stream(spark, d), shared_dir(spark), "user_id", _day(), _values(), delay="2 days")
    return out.select("user_id", "step", *[rounded(f"ema_{a}") for a in _values()])


@query("stream_adaptive_weights", "SELECT run AS user_id, step, weight_ahimsa, weight_dharma, weight_helpfulness FROM (" + ORACLES["adaptive_weights"] + ")")
def stream_adaptive_weights(spark, d):
    out = jobs.stream_adaptive_weights(_timed_stream(spark, d), shared_dir(spark), "user_id", _day(), _values(), delay="2 days")
    return out.select("user_id", "step", *[rounded(f"weight_{a}") for a in _values()])


@query("stream_error_alarm", "SELECT user_id, event_id, errors, calls FROM (" + ORACLES["error_rate_alarm"] + ")")
def stream_error_alarm(spark, d):
    out = jobs.stream_error_alarm(
        _timed_stream(spark, d), shared_dir(spark), "user_id", ["ts", "event_id"], F.col("event_type") == "error",
        delay="2 days", piece="1 day")
    return out.select("user_id", "event_id", "errors", "calls")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Evaluate-once over the whole stream: the watermark delay spans it."""
    out = jobs.stream_dedupe(_stream(spark, d), shared_dir(spark), ["user_id", "event_type"], delay=_DELAY)
    return out.select("user_id", "event_type")


@query("stream_score", """SELECT event_id, round((least(floor(value) % 11, 10) / 10 + 0.5) / 2, 9) AS raw_ahimsa_score FROM (SELECT event_id, value FROM events WHERE floor(value) % 11 > 1)
 UNION ALL SELECT event_id, round((floor(value) % 11 + 0.5) / 2, 9) FROM events WHERE floor(value) % 11 <= 1""")
def stream_score(spark, d):
    """Judge answers parsed and scored as they arrive."""
    raw = F.concat(
        F.lit('```json\n{"harm_avoidance": '), F.floor("value") % 11, F.lit(', "safety_context_score": 0.5, "has_medical_disclaimer": yes, '),
        F.lit('"has_professional_referral": "no", "referral_strength": "urgent", "severity": "minor",}\n```'))

    def score(df):
        typed = parse_answers(df.withColumn("raw", raw).withColumn("tier", F.lit("B")), "ahimsa")
        return typed.transform(score_ahimsa).select("event_id", rounded("raw_ahimsa_score"))

    return jobs.stream_score(_stream(spark, d), shared_dir(spark), score)
