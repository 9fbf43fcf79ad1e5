"""The quality classifier against a plain tree walk, and on held-out labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumbline.llm import scorer
from plumbline.llm.q_language import remainder


def sample(n=600, seed=1):
    """Prose and junk with their labels."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgéhio") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        good = k % 3 > 0
        if not good:
            words = [rng.choice([w + "$$$", w.upper() + "!!", "|", words[0]]) for w in words]
        texts.append(" ".join(words) + ".")
        labels.append(int(good))
    return texts, labels


def walk(forest, row):
    total = forest.base
    for node in forest.roots:
        while forest.statistic[node] >= 0:
            low = row[forest.statistic[node]] <= forest.threshold[node]
            node = forest.left[node] if low else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + np.exp(-total))


def test_arrays_equal_a_tree_walk_and_labels_are_learned():
    texts, labels = sample()
    x, y = scorer.measure(pa.array(texts)), np.array(labels, float)
    forest = scorer.grow(x[:400], y[:400], trees=30)
    found = forest.score(x)
    assert np.allclose(found, [walk(forest, row) for row in x])
    assert ((found[400:] >= 0.7) == (y[400:] == 1)).mean() > 0.97
    assert np.array_equal(forest.score(x), scorer.grow(x[:400], y[:400], trees=30).score(x))


def test_best_split_of_one_tree_is_the_plain_one():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(80) < 0.1)).astype(float)
    forest = scorer.grow(x, y, trees=1, leaves=2, rate=1.0, ridge=1.0, least=5)
    p = y.mean()
    grad, hess = p - y, np.full(80, p * (1 - p))

    def gain(f, cut):
        low = x[:, f] <= cut
        if min(low.sum(), (~low).sum()) < 5:
            return -np.inf
        return sum(grad[s].sum()**2 / (hess[s].sum() + 1.0) for s in (low, ~low))

    want = max(((f, cut) for f in range(3) for cut in np.arange(0.5, 5)), key=lambda s: gain(*s))
    assert (forest.statistic[0], forest.threshold[0]) == want
    for node, side in ((forest.left[0], x[:, want[0]] <= want[1]), (forest.right[0], x[:, want[0]] > want[1])):
        assert forest.value[node] == pytest.approx(-grad[side].sum() / (hess[side].sum() + 1.0))


def test_statistics_do_not_depend_on_the_batch():
    texts = [*sample(40)[0], "", None, " \n\t", "a", "é" * 5000, "x y\n" * 3000, "A! B!\nA! B!", "日本 😀"]
    together = scorer.measure(pa.array(texts))
    assert np.isfinite(together).all()
    for k, t in enumerate(texts):
        assert np.allclose(scorer.measure(pa.array([t], pa.string()))[0], together[k])
    assert not together[40].any() and not together[41].any()
    at = dict(zip(scorer.STATISTICS, scorer.measure(pa.array(["Ab cd cd #x\n\nAB| 12"]))[0]))
    assert at["words"] == pytest.approx(np.log1p(6)) and at["lines"] == pytest.approx(np.log1p(2))
    assert at["distinct_words"] == pytest.approx(5 / 6) and at["signed_words"] == pytest.approx(2 / 6)
    assert at["shouted_words"] == pytest.approx(1 / 6) and at["longest_word"] == 3


def test_tables(spark):
    texts, labels = sample(300)
    rows = [(k, t, 0.0) for k, t in enumerate(texts)] + [(None, "null id", 1.0), (5, None, 1.0), (7, "", 1.0), (7, "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double").withColumn("predicted", F.lit("x"))
    marks = [(k, v, 1) for k, v in enumerate(labels)] + [(3, None, 0), (None, 1, 0), (4, 9, 0), (9, 1 - labels[9], 1)]
    known = spark.createDataFrame(marks, "doc_id bigint, quality int, x int").withColumn("score", F.lit(2))
    forest = scorer.fit(docs.repartition(3), known, remainder("doc_id", 4) != 2, trees=20)
    again = scorer.fit(docs.repartition(5), known, remainder("doc_id", 4) != 2, trees=20)
    found = scorer.score(docs, forest).collect()
    assert sorted((r.doc_id, r.score) for r in found if r.doc_id is not None) == sorted(
        (r.doc_id, r.score) for r in scorer.score(docs, again).collect() if r.doc_id is not None)
    assert len(found) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.doc_id is not None and 10 < r.doc_id < 300]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert scorer.score(docs.where("false"), forest).count() == 0
    for marked, share in ((known.where("false"), 0.5), (known.where("quality = 1 AND doc_id <> 9"), 0.999)):
        constant = scorer.fit(docs, marked, F.lit(True))
        assert {round(r.score, 3) for r in scorer.score(docs, constant).collect()} == {share}


def test_held_out_labels_of_the_query(spark):
    found = queries()["op11_scorer"](spark, "/root/testdata/sf0.01").toPandas()
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(marks, on="doc_id")
    assert len(found) == 1000 and len(both) > 50
    assert ((both["predicted"] == both["quality"]).mean()) > 0.95
