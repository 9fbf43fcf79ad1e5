"""The filter interaction audit against counting row by row."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import diagrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_plain_changes_visit_all_orders_once():
    for n in range(1, 7):
        now, seen = list(range(n)), [tuple(range(n))]
        for at in diagrams.plain_changes(n):
            now[at], now[at + 1] = now[at + 1], now[at]
            seen.append(tuple(now))
        assert sorted(seen) == sorted(permutations(range(n)))


def plain_steps(rows, names):
    """Counts of every order and step from (mask, facts ...) rows."""
    out, share = {}, Counter()
    for order in permutations(range(len(names))):
        left = rows
        for k, f in enumerate(order, 1):
            gone = [r for r in left if r[0] >> f & 1]
            left = [r for r in left if not r[0] >> f & 1]
            fails = [r for r in rows if r[0] >> f & 1]
            out["".join(names[x] for x in order), k] = [
                len(left), len(gone), len(fails) - len(gone), sum(r[0] == 1 << f for r in rows), *(sum(c) for c in zip(*(r[1:] for r in gone)))]
            out["".join(names[x] for x in order), k] += [0] * (4 + len(rows[0]) - 1 - len(out["".join(names[x] for x in order), k]))
            share[f] += len(gone)
    return {key: (*value, share[names.index(key[0][key[1] - 1])]) for key, value in out.items()}


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_orders(k):
    rng = random.Random(k)
    names = "ABCDE"[:k]
    for n in (1, 5, 200):
        rows = [(rng.randrange(1 << k) & rng.randrange(1 << k), rng.randrange(2), rng.randrange(2)) for _ in range(n)]
        counts = {m: (sum(r[0] == m for r in rows), sum(r[1] for r in rows if r[0] == m), sum(r[2] for r in rows if r[0] == m))
                  for m in {r[0] for r in rows}}
        found = {(r[0], r[1]): tuple(r[2:]) for r in diagrams.orders(counts, list(names))}
        assert found == plain_steps(rows, names)


def test_equal_parts_of_a_diagram_are_shared():
    counts = {m: (7,) for m in range(32)}
    diagram = diagrams.Diagram(counts, 5)
    assert [len(level) for level in diagram.known] == [1, 1, 1, 1, 1, 1]
    for at in diagrams.plain_changes(5):
        diagram.exchange(at)
        assert [len(level) for level in diagram.known] == [1, 1, 1, 1, 1, 1]
    assert diagram.weight[diagram.root] == (7 * 32,)


def failing(text):
    words = WORD.findall(text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


def test_documents(spark):
    rng = random.Random(8)
    long = " ".join(f"w{k}é" for k in range(70))
    texts = [long, long.upper(), "a " * 80, "#" + long, "", None, "x", " \n", "B" * 9000, "w1 " * 60 + "|", long[:300]]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["s", "t", "", None]), "z") for _ in range(400)]
    rows += [(7, long, "hot", "z")] * 300 + [(None, "", "hot", "z")] * 200
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, part string").withColumn("mask", F.lit(1)).repartition(4)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit("x"))
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {k for k, q, _ in marks if q == 1 and k is not None}
    toxic = {k for k, _, x in marks if x == 1 and k is not None}
    want = {}
    for part in {s or "" for _, _, s, _ in rows}:
        mine = [(failing(t or "") | (i is not None and i > first[t or ""]) << 4, int(i in good), int(i in toxic))
                for i, t, s, _ in rows if (s or "") == part]
        want |= {(part, *key): value for key, value in plain_steps(mine, "ABCDE").items()}
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
             for r in diagrams.audit_documents(docs, labels).collect()}
    assert found == want and len(found) == 4 * 600
    assert diagrams.audit_documents(docs.where("false"), labels).count() == 0
    assert diagrams.audit_documents(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_any_filters_and_too_many(spark):
    counts = spark.createDataFrame([("p", 1, 4, 2), (None, 3, 1, 0), ("p", 1, 1, 0)], "part string, mask int, n bigint, seen bigint")
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.seen_lost) for r in diagrams.audit(counts, ["x", "y"], ["seen"]).collect()}
    assert found[("p", "xy", 1)] == (0, 5, 2) and found[("p", "yx", 1)] == (5, 0, 0) and found[("", "yx", 2)] == (0, 0, 0)
    with pytest.raises(ValueError):
        diagrams.audit(counts, list("ABCDEFGHI"), [])
