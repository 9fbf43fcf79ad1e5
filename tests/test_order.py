"""Ranks, scans and samples: same results as plain windows, also for one hot group."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from plumbline.operators import logs, ordering, sampling, sequence


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a null group, and repeated order values."""
    n = F.col("id")
    group = F.when(n % 3 == 0, "hot").when(n % 50 == 1, None).otherwise(F.concat(F.lit("g"), n % 7))
    return spark.range(6000).select(n.alias("k"), group.alias("g"), (F.xxhash64(n) % 500).cast("double").alias("v"),
                                    F.when(n % 11 == 0, n).alias("maybe"))


def test_add_rank_and_total(skewed):
    block = ordering.key_blocks(skewed, "v", cuts=8, rows=100)
    w = W.partitionBy("g").orderBy("v", "k")
    got = ordering.add_rank(skewed, ["v", "k"], block, by=["g"], total="n")
    want = skewed.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))
    cols = ["k", "g", "rn", "n"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.select(block.alias("b")).distinct().count() > 20


def test_running_sums_fill_and_lookback(skewed):
    rows = skewed.where("g IS NOT NULL")
    block = F.floor(F.col("k") / 64)
    w = W.partitionBy("g").orderBy("k")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    sums = ordering.running_sums(rows, ["k"], block, ["g"], {"s": F.col("v")})
    filled = ordering.fill_forward(sums, "k", block, ["g"], "maybe", "last_known")
    ranked = ordering.add_rank(filled, ["k"], block, by=["g"])
    got = ordering.with_preceding(ranked, "rn", ["g"], 3, {"prev3": lambda x: F.lag("v", 3).over(x)}, size=16)
    want = rows.withColumns({"s": F.sum("v").over(upto), "last_known": F.last("maybe", True).over(upto),
                             "rn": F.row_number().over(w), "prev3": F.lag("v", 3).over(w)})
    cols = ["k", "s", "last_known", "rn", "prev3"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


@pytest.mark.parametrize("alpha,start", [(0.1, None), (0.05, 0.3), (0.9, None), (1.0, None)])
def test_ema_scan_over_several_levels(spark, alpha, start):
    """200,000 steps of one run and gaps in another need more than one level of blocks."""
    n = 200_000
    rng = np.random.default_rng(1)
    x = rng.normal(size=n)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x[:3000])], "run int, step bigint, x double")
    hot = spark.range(n).select(F.lit(2).alias("run"), F.col("id").alias("step"), F.sin(F.col("id") * 0.37).alias("x"))
    sparse = spark.range(50).select(F.lit(3).alias("run"), (F.col("id") * F.col("id") * 77).alias("step"), F.cos("id").alias("x"))
    out = sequence.ema_scan(df.unionByName(hot).unionByName(sparse), ["run"], "step", ["x"], alpha, start=start)
    got = out.toPandas().sort_values(["run", "step"])
    for run, part in got.groupby("run"):
        y, want = start, []
        for v in part["x"]:
            y = v if y is None else alpha * v + (1 - alpha) * y
            want.append(y)
        assert np.allclose(part["ema_x"], want, atol=1e-9), run
    assert len(got) == n + 3000 + 50


def test_adaptive_weights_sum_to_one_and_keep_floor(spark):
    means = spark.range(40).select(F.lit(1).alias("run"), F.col("id").alias("step"), F.lit(0.9).alias("ahimsa"),
                                   F.lit(0.01).alias("dharma"), F.lit(0.5).alias("helpfulness"))
    for strategy in ("mean_inverse", "target_floor", "target_weighted", "equal_contribution"):
        rows = sequence.adaptive_weights(means, strategy=strategy).collect()
        for r in rows:
            w = [r.weight_ahimsa, r.weight_dharma, r.weight_helpfulness]
            assert sum(w) == pytest.approx(1) and min(w) > 0.08
    with pytest.raises(ValueError):
        sequence.adaptive_weights(means, strategy="other")


def test_take_ranked_is_exact(skewed):
    digest = ordering.hash_order(F.col("k"))
    order = W.partitionBy("g").orderBy(digest, "k")
    wanted = {"hot": 777, "g1": 5, "g2": 100_000, "g3": 0}
    got = ordering.take_ranked(skewed, digest, "k", wanted, by="g")
    want = skewed.withColumn("rn", F.row_number().over(order)).where("(g='hot' AND rn<=777) OR (g='g1' AND rn<=5) OR g='g2'")
    assert {r.k for r in got.collect()} == {r.k for r in want.collect()}
    assert ordering.take_ranked(skewed, digest, "k", 1234).count() == 1234


@pytest.mark.parametrize("n", [10, 99, 400, 5000, 9000])
def test_quota_sample_properties(skewed, n):
    tiered = skewed.withColumn("tier", F.when(F.col("k") % 50 == 0, "A").when(F.col("k") % 3 == 0, "B").when(F.col("k") % 7 == 0, "D").otherwise("C"))
    ratios = {"A": 0.33, "B": 0.34, "C": 0.33}
    targets = sampling.quota_targets(n, ratios)
    assert sum(targets.values()) == n
    got = sampling.quota_sample(tiered, "k", "tier", n, ratios)
    rows = got.collect()
    assert len(rows) == len({r.k for r in rows}) == min(n, 6000)
    counts = {t: sum(r.tier == t for r in rows) for t in "ABCD"}
    have = {r.tier: r.c for r in tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("c")).collect()}
    for t in "ABC":
        assert counts[t] >= min(targets[t], have[t])
    assert {r.k for r in rows} == {r.k for r in sampling.quota_sample(tiered, "k", "tier", n, ratios).collect()}


@pytest.mark.parametrize("n", [1, 7, 10, 1000])
def test_split_is_disjoint_and_complete(spark, n):
    out = sampling.split_dataset(spark.range(n), "id")
    counts = {r.split: r.c for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert out.select("id").distinct().count() == n == sum(counts.values())
    assert counts.get("train", 0) == int(n * 0.8) and counts.get("validation", 0) == int(n * 0.1)
    with pytest.raises(ValueError):
        sampling.split_dataset(spark.range(3), "id", (0.5, 0.1, 0.1))


def test_error_alarm_first_breach(spark):
    rows = [(1, i, i in (3, 25)) for i in range(40)] + [(2, i, False) for i in range(40)] + [(3, i, i < 5) for i in range(19)]
    calls = spark.createDataFrame(rows, "run int, t int, bad boolean")
    got = sequence.error_rate_alarm(calls, "run", ["t"], F.floor(F.col("t") / 4), F.col("bad")).collect()
    assert [(r.run, r.t, r.errors, r.calls) for r in got] == [(1, 25, 2, 26)]


def _keep_by_hand(lines):
    """One pass in order, as the definition reads."""
    pct, sampled, progress, reward = -1, -1, set(), set()
    for i, kind, x in lines:
        if kind == "p" and (x >= pct + 5 or x in (0, 1, 5, 10, 25, 50, 75, 90, 95, 100)):
            pct = x
            progress.add(i)
        if kind == "r" and i >= sampled + 20:
            sampled = i
            reward.add(i)
    return progress, reward


@pytest.mark.parametrize("size", [24, 100, 8192])
def test_log_sampling_by_blocks(spark, size):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for run, n in ((1, 1500), (2, 40), (3, 300)):
        lines = []
        for i in range(n):
            kind = "rpo"[rng.integers(3)]
            x = int(rng.integers(0, 130)) if run != 3 else (i // 4) % 110
            text = {"r": "Combined reward: 0.1", "p": f"{x}%|##| {x}/200 [", "o": "free text"}[kind]
            lines.append((i, kind, x))
            rows.append((run, i, text))
        want[run] = _keep_by_hand(lines)
    parsed = logs.parse_log(spark.createDataFrame(rows, "run int, idx bigint, line string"))
    progress = {(r.run, r.idx) for r in logs.keep_progress(parsed, size).collect()}
    reward = {(r.run, r.idx) for r in logs.keep_reward(parsed, size).collect()}
    assert progress == {(run, i) for run, (p, _) in want.items() for i in p}
    assert reward == {(run, i) for run, (_, r) in want.items() for i in r}
    kept = logs.condense(spark.createDataFrame(rows, "run int, idx bigint, line string"), size)
    assert kept.count() == kept.select("run", "idx").distinct().count() > 0


def test_trend_sample_points(spark):
    rows = [(1, i, {"loss": float(i)}) for i in range(20)] + [(2, i * 3, {"loss": 1.0}) for i in range(100)]
    history = spark.createDataFrame(rows, "run int, idx bigint, metrics map<string,double>")
    got = logs.trend_sample(history).collect()
    assert sum(r.run == 1 for r in got) == 20
    at = sorted(r.idx // 3 for r in got if r.run == 2)
    assert at == sorted({0, 99, *range(5, 99, 5)})
