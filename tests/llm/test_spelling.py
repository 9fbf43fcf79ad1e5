"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, modulus=97, shortest=5, least=3):
    count = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            low = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % modulus == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= shortest:
                count[low] += 1
    return {w: n for w, n in count.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(count):
    near = {w: [v for v in count if one_edit(v, w)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def texts():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    out = []
    for _ in range(300):
        words = []
        for _ in range(12):
            w = list(rng.choice(base[:1 + int(60 * rng.random() ** 2)]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "É", "ÿ"])
            words.append("".join(w))
        out.append(rng.choice([" ", ", ", "\n", "1"]).join(words))
    return out + ["", None, " 12 ", "aaaaa AAAAA aaaab aaaab aaaab aaaab", "÷×÷×÷ ÷×÷×÷ ÷×÷×÷", "z" * 3000 + " " + "z" * 2999 + "y"] * 4


@pytest.mark.parametrize("parts", [3, 4])
def test_variants(spark, parts):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())] + [(5, "hotty hotly")] * 400
    # A chain of two links.
    rows += [(900 + k, w * n) for k, (w, n) in enumerate([("planet ", 20), ("planet ", 20), ("planot ", 8), ("planot ", 8), ("plamot ", 5)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("q")).repartition(5)
    count = plain_words(rows)
    words = spelling.count_words(docs)
    assert {r.word: r.n for r in words.collect()} == count
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words, parts).collect()}
    assert found == plain_variants(count)
    assert any(v[0] and v[0] != v[1] for v in found.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert spelling.variants(spelling.count_words(docs)).count() == 0
    assert spelling.variants(spelling.count_words(docs.where("false"))).count() == 0
    for options in ({"parts": 2}, {"parts": 5}, {"factor": 1}):
        with pytest.raises(ValueError):
            spelling.variants(spelling.count_words(docs), **options)


def test_pieces_cut_between_runs():
    text = "ab1cdé " * 50 + "x" * 100 + "1y"
    for size in (1, 7, 20):
        cut = list(spelling.pieces(text, size))
        assert "".join(cut) == text
        assert [r for c in cut for r in RUN.findall(c)] == RUN.findall(text)


def test_one_edit_changes_at_most_two_partitions():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for word in words:
        k, c = rng.randrange(len(word)), rng.choice("abz")
        for other in (word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]):
            if other:
                a, b = spelling.partition_values([word, other], 4).view(np.uint64)
                assert sum(int(a) >> 16 * p & 0xFFFF != int(b) >> 16 * p & 0xFFFF for p in range(4)) <= 2


def test_tables_of_words_are_not_broadcast(spark):
    """Spark leaves out that a word has 24 signatures, and takes their table for a small one."""
    words = spark.createDataFrame([("letter", 9), ("leter", 3), ("later", 1)], "word string, n bigint")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = spelling.variants(words)
        plans = [spelling.near_pairs(words), spelling.roots(words.where("word = 'leter'").select("word", F.lit("letter").alias("form"))), out]
        assert {r.word: (r.form, r.root) for r in out.collect()} == {
            "letter": (None, "letter"), "leter": ("letter", "letter"), "later": ("leter", "letter")}
        for df in plans:
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
