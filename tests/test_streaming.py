"""Streams over several micro-batches against their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering, sequence
from plumbline.schemas import EVENTS
from plumbline.session import shared_dir
from plumbline.streaming import jobs
from plumbline.streaming.folds import first_calls

DELAY = "60 days"


def day(days=1):
    return F.floor((F.unix_micros("ts") - 1_704_067_200_000_000) / (days * 86_400_000_000))


@pytest.fixture(scope="module", params=["days", "parity"])
def parts(spark, sf, request):
    """The events in three files: ten days each, the last first, or cut across all steps."""
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    path = shared_dir(spark)
    for i in (2, 0, 1):
        piece = (day() >= i * 10) & (day() < i * 10 + 10) if request.param == "days" else F.col("event_id") % 3 == i
        events.where(piece).coalesce(1).write.mode("append").parquet(path)
    return events, path


def stream(spark, path):
    return jobs.event_stream(spark, path, files_per_batch=1)


def axis_means(df):
    v = F.col("value") / 97
    return {"ahimsa": v, "dharma": 1 / (1 + v), "helpfulness": F.sqrt(F.abs(v))}


def batch_means(events, days=1):
    values = axis_means(events)
    return events.groupBy(F.col("user_id").alias("run"), day(days).alias("step")).agg(*[F.avg(v).alias(n) for n, v in values.items()])


def as_map(df, run, cols):
    return {(r[run], r["step"]): np.array([r[c] for c in cols]) for r in df.collect()}


def check(got, want):
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


@pytest.mark.parametrize("days", [1, 7])
def test_step_means(spark, parts, days):
    events, path = parts
    work = shared_dir(spark)
    out = jobs.stream_step_means(stream(spark, path), work, "user_id", day(days), axis_means(events), DELAY)
    check(as_map(out, "user_id", ["ahimsa", "dharma"]), as_map(batch_means(events, days), "run", ["ahimsa", "dharma"]))
    assert out.agg(F.sum("n")).first()[0] == events.count()
    assert spark.read.parquet(f"{work}/out").select("version").distinct().count() >= 3


BEAT = "2024-03-01"


def add_files(events, path, parts):
    """One file after the other; a part None is a heartbeat."""
    for part in parts:
        if part is None:
            row = events.limit(1).select(*[(F.lit(BEAT).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
                                           for f in events.schema])
        else:
            row = events.where(part).coalesce(1)
        row.write.mode("append").parquet(path)


def disordered(k, parts=3):
    """Thirds of the month, with a day's disorder at their edges."""
    place = day() + F.pmod(F.col("event_id"), F.lit(2))
    return (place >= 31 * k // parts) & (place < 31 * (k + 1) // parts)


@pytest.fixture(scope="module")
def timed(spark, sf):
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    path = shared_dir(spark)
    add_files(events, path, [*[disordered(k) for k in range(3)], None])
    return events, path


@pytest.mark.parametrize("days, piece", [(1, "1 day"), (7, "1 day")])
def test_closed_steps_leave_once_with_their_averages(spark, timed, days, piece):
    events, path = timed
    work, late = shared_dir(spark), []
    out = jobs.stream_ema(stream(spark, path), work, "user_id", day(days), axis_means(events), delay="2 days", piece=piece,
                          quiet=f"{days} days", on_late=late.append)
    twin = sequence.ema_scan(batch_means(events, days), ["run"], "step", ["ahimsa", "dharma"], 0.1)
    check(as_map(out, "user_id", ["ema_ahimsa", "ema_dharma"]), as_map(twin, "run", ["ema_ahimsa", "ema_dharma"]))
    held = spark.read.parquet(f"{work}/out")
    assert late == [0] and held.agg(F.sum("n")).first()[0] == events.count()
    assert held.groupBy("user_id", "step").count().where("count > 1").isEmpty()


def test_averages_go_on_after_a_restart_and_open_steps_wait(spark, timed):
    events, _ = timed
    path, work = shared_dir(spark), shared_dir(spark)
    twin = as_map(sequence.ema_scan(batch_means(events), ["run"], "step", ["ahimsa"], 0.1), "run", ["ema_ahimsa"])
    seen = []
    for part in ([disordered(0)], [disordered(1)], [disordered(2), None]):
        add_files(events, path, part)
        out = jobs.stream_ema(stream(spark, path), work, "user_id", day(), axis_means(events), delay="2 days")
        now = as_map(out, "user_id", ["ema_ahimsa"])
        assert now.keys() <= twin.keys() and all(np.allclose(now[k], twin[k]) for k in now)
        seen.append(len(now))
    assert 0 < seen[0] < seen[1] < seen[2] == len(twin)


def test_late_parts_of_closed_steps_move_nothing(spark, timed):
    """Steps that do not rise with time leave as late rows; rows behind the watermark are counted."""
    events, _ = timed
    path, work, late = shared_dir(spark), shared_dir(spark), []
    twisted = events.withColumn("value", F.when(day() == 20, F.lit(1000.0)).otherwise(F.col("value")))
    add_files(twisted, path, [day() < 15, (day() >= 15) & (day() < 30), (day() == 2) & (F.col("event_id") % 2 == 0), None])
    step = F.when(day() == 20, F.lit(3).cast("bigint")).otherwise(day())
    out = jobs.stream_ema(stream(spark, path), work, "user_id", step, axis_means(events), delay="1 day", on_late=late.append)
    held = spark.read.parquet(f"{work}/out")
    kept = events.where((day() < 30) & (day() != 20))
    twin = sequence.ema_scan(batch_means(kept), ["run"], "step", ["ahimsa"], 0.1)
    check(as_map(out, "user_id", ["ema_ahimsa"]), as_map(twin, "run", ["ema_ahimsa"]))
    assert held.where("late").select("step").distinct().collect() == [(3,)] and late[0] > 0


@pytest.mark.parametrize("strategy", ["mean_inverse", "target_floor"])
def test_adaptive_weights_over_batches(spark, timed, strategy):
    events, path = timed
    out = jobs.stream_adaptive_weights(
        stream(spark, path), shared_dir(spark), "user_id", day(), axis_means(events), strategy, "2 days")
    twin = sequence.adaptive_weights(batch_means(events), strategy=strategy)
    cols = [f"weight_{a}" for a in axis_means(events)]
    check(as_map(out, "user_id", cols), as_map(twin, "run", cols))


def failed_call():
    return (F.col("event_type") == "error") & (F.col("value") > 60)


KEY = ["user_id", "event_id", "errors", "calls"]


def alarms(events):
    micros = F.unix_micros("ts")
    twin = sequence.error_rate_alarm(events, "user_id", ["ts", "event_id"], ordering.key_blocks(events, micros), failed_call())
    return sorted(map(tuple, twin.select(KEY).collect()))


@pytest.mark.parametrize("piece", ["1 day", "1 hour"])
def test_alarms_leave_the_stream(spark, timed, piece):
    events, path = timed
    work = shared_dir(spark)
    out = jobs.stream_error_alarm(stream(spark, path), work, "user_id", ["ts", "event_id"], failed_call(), delay="2 days", piece=piece)
    got = sorted(map(tuple, out.select(KEY).collect()))
    assert got == alarms(events) and got
    assert spark.read.parquet(f"{work}/out").count() == len(got)


def test_alarms_after_a_restart_come_once(spark, timed):
    events, _ = timed
    path, work, seen = shared_dir(spark), shared_dir(spark), []
    for part in ([disordered(0)], [disordered(1)], [disordered(2), None]):
        add_files(events, path, part)
        out = jobs.stream_error_alarm(stream(spark, path), work, "user_id", ["ts", "event_id"], failed_call(), delay="2 days", piece="6 hours")
        seen.append(sorted(map(tuple, out.select(KEY).collect())))
    assert set(seen[0]) < set(seen[2]) and seen[2] == alarms(events)


def test_first_calls_hold_every_possible_first_breach():
    rng = np.random.default_rng(5)
    for _ in range(300):
        failed = rng.random(rng.integers(0, 60)) < rng.random()
        kept = first_calls(failed, 0.05, 20)
        calls = int(rng.integers(0, 40))
        errors = int(rng.integers(0, calls + 1)) if rng.random() < 0.5 else min(calls, int(rng.integers(0, 3)))
        c, e = np.arange(1, len(failed) + 1), np.cumsum(failed)
        breach = failed & (calls + c >= 20) & ((errors + e) / (calls + c) > 0.05)
        if breach.any():
            assert int(breach.argmax()) in kept


def test_dedupe_and_restart(spark, parts):
    events, path = parts
    work = shared_dir(spark)
    for _ in range(2):  # the second run finds nothing new
        out = jobs.stream_dedupe(stream(spark, path), work, ["user_id", "event_type"], "60 days")
        assert out.count() == events.select("user_id", "event_type").distinct().count()
