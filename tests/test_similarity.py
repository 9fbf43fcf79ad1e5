"""Near-duplicates and TF-IDF closeness against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pivot_tree, similarity as S
from plumbline.plans import tables as D


def vectors(seed, n, dim=16, clusters=12, spread=0.25, hot=0.35):
    """Clustered unit-free vectors; a share of all rows sits in one tight ball, some are equal or zero."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    which = rng.integers(clusters, size=n)
    v = centres[which] + rng.normal(size=(n, dim)) * spread
    ball = rng.random(n) < hot
    v[ball] = centres[0] + rng.normal(size=(ball.sum(), dim)) * 0.02
    v[5] = v[4]
    v[7] = 0.0
    return v.astype("float32")


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>")


def cosines(a, b):
    a, b = a.astype("float64"), b.astype("float64")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return unit(a) @ unit(b).T


@pytest.mark.parametrize("threshold", [0.8, 0.95])
@pytest.mark.parametrize("pivots,block", [(4, 40), (32, 64), (1, 4096)])
def test_near_dup_is_exact(spark, threshold, pivots, block):
    new, old = vectors(1, 400), vectors(2, 300, hot=0.2)
    s = cosines(new, new)
    np.fill_diagonal(s, -1)
    within = S.near_dup_within(frame(spark, new), threshold, pivots=pivots, block=block)
    assert {r.vec_id for r in within.collect()} == set(np.nonzero(s.max(axis=1) < threshold)[0])
    free = np.nonzero(cosines(new, old).max(axis=1) < threshold)[0]
    against = S.near_dup_existing(frame(spark, new), frame(spark, old, 1000), threshold, pivots=pivots, block=block)
    assert {r.vec_id for r in against.collect()} == set(free)
    left = cosines(new[free], new[free])
    np.fill_diagonal(left, -1)
    both = S.near_dup(frame(spark, new), frame(spark, old, 1000), threshold, pivots=pivots, block=block)
    assert {r.vec_id for r in both.collect()} == set(free[left.max(axis=1) < threshold])


def test_hot_ball_needs_no_comparisons(spark):
    """Rows that surely have a partner are decided by the cell statistics alone."""
    rng = np.random.default_rng(3)
    v = (np.ones(8) + rng.normal(size=(2000, 8)) * 0.01).astype("float32")
    assert S.near_dup_within(frame(spark, v), 0.9, pivots=4, block=100).count() == 0


def visits_per_query(spark, clusters):
    """Leaves searched per query in a table of tight clusters, each of 20 vectors."""
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 4))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 20, 0) + rng.normal(size=(clusters * 20, 4)) * 0.002
    rows = frame(spark, v.astype("float32")).selectExpr("vec_id AS rep", "embedding AS v")
    tree = pivot_tree.build(rows, 8, 64)
    queries = rows.where("rep % 20 = 0")
    search = pivot_tree.Search(math.acos(0.9999), True, True)
    _, visits = pivot_tree.descend(tree, queries, search, 64, nearest=False)
    assert tree.ends.agg({"n": "sum"}).first()[0] == clusters * 20 and len(tree.levels) >= 2
    return visits.count() / clusters


def test_copies_of_a_query_stay_few_as_the_table_doubles(spark):
    few, more = visits_per_query(spark, 60), visits_per_query(spark, 120)
    assert few <= 4 and more <= 1.3 * few + 0.5


def test_vectors_without_a_direction_stay(spark):
    v = [[1.0, 0.0], [0.0, 0.0], None, [None, 1.0], [1.0, 0.001], [float("nan"), 1.0], None, [float("inf"), 0.0], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")
    stay = {1, 2, 3, 5, 6, 7, 8}
    assert {r.vec_id for r in S.near_dup_within(df, 0.9).collect()} == stay
    assert {r.vec_id for r in S.near_dup_within(df, 0.9, mode="keep_first").collect()} == stay | {0}
    assert {r.vec_id for r in S.near_dup_existing(df, df.where("vec_id = 0"), 0.9).collect()} == stay
    assert S.near_dup_within(df.where("vec_id IN (2, 3)"), 0.9, mode="keep_first").count() == 2


def test_equal_directions_end_the_splitting(spark):
    """Vectors of one direction and many lengths cannot be split; the first of them stays."""
    v = [[float(k), 2.0 * k, 0.0] for k in range(1, 200)] + [[0.0, 0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")
    first = S.near_dup_within(df, 0.95, mode="keep_first", pivots=4, block=16)
    assert sorted(r.vec_id for r in first.collect()) == [0, 199]
    assert [r.vec_id for r in S.near_dup_within(df, 0.95, pivots=4, block=16).collect()] == [199]


def test_empty_existing_set(spark):
    v = frame(spark, vectors(4, 50, hot=0.0))
    assert S.near_dup_existing(v, v.limit(0), 0.8).count() == 50


def test_tfidf_by_hand(spark):
    core = spark.createDataFrame([(0, "red apple pie"), (1, "green apple the tart"), (2, "blue sky")], "core bigint, c string")
    docs = spark.createDataFrame([(0, "Apple apple pie!"), (1, "nothing in common"), (2, "the blue sky"), (3, "")], "id bigint, t string")
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in {"apple": 2, "red": 1, "pie": 1}.items()}
    doc = np.array([2 * idf["apple"], idf["pie"]])
    first = np.array([idf["apple"], idf["pie"], idf["red"]])
    want = doc @ first[:2] / np.linalg.norm(doc) / np.linalg.norm(first)
    for rows in (10_000, 0):
        out = S.tfidf_near_core(docs, core, 0.8, "id", "t", "core", "c", ["the"], broadcast_rows=rows)
        got = {r.id: (r.similarity, r.near_core) for r in out.collect()}
        assert got[0][0] == pytest.approx(want) and got[0][1] == (want >= 0.8)
        assert got[1] == (0.0, False) and got[3] == (0.0, False)
        assert got[2][0] == pytest.approx(1.0) and got[2][1]


def test_core_tasks_grow_with_documents(spark, monkeypatch):
    """Twice the documents, or twice their text, are twice the tasks, all of them by document; the results stay."""
    core = spark.range(50).selectExpr("id AS core", "concat_ws(' ', 'all', 'w' || (id % 7), 'x' || id) AS c")
    docs = spark.range(800).selectExpr("id", "concat_ws(' ', 'all', 'w' || (id % 5), 'x' || (id % 60), 'other') AS t")

    def exchanges(n):
        text = S.tfidf_near_core(docs.where(f"id < {n}"), core, 0.8, "id", "t", "core", "c")._jdf.queryExecution().executedPlan().toString()
        return set(re.findall(r"Exchange hashpartitioning\((?:doc|id)#.*?, (\d+)\)", text))

    def scores(rows):
        out = S.tfidf_near_core(rows, core, 0.8, "id", "t", "core", "c")
        return sorted((str(r.id), str(r.t), round(r.similarity, 9), r.near_core) for r in out.collect())

    odd = docs.union(spark.createDataFrame([(3, "x3 x4"), (None, "all x1"), (None, "all x1"), (900, None)], "id bigint, t string"))
    want = scores(odd)
    monkeypatch.setattr(S, "TASK_PAIRS", 500, raising=False)
    assert exchanges(400) == {"40"} and exchanges(800) == {"80"}
    assert scores(odd) == want
    got = {r[:2]: r[2:] for r in want}
    assert got["None", "all x1"] == got["900", "None"] == (0.0, False)
    assert got["3", "x3 x4"] == got["3", "all w3 x3 other"] != got["63", "all w3 x3 other"]
    monkeypatch.setattr(S, "TASK_PAIRS", 10 ** 9)
    monkeypatch.setattr(S, "TASK_BYTES", docs.agg(F.sum(F.octet_length("t"))).first()[0] / 30)
    assert exchanges(800) == {"30"}


def test_core_set_needs_forty_rows(spark):
    assert S.scan_core_set(spark.range(39)).count() == 0
    assert S.scan_core_set(spark.range(40)).count() == 40


def test_dense_vectors_are_settled_by_few_partners(spark, monkeypatch):
    # Without clusters a tree sends a query to every leaf; where near copies are common it must not be asked.
    v = np.random.default_rng(5).normal(size=(300, 4))
    near = cosines(v, v) >= 0.8
    np.fill_diagonal(near, False)

    def refused(*_):
        raise AssertionError("the tree was asked")

    monkeypatch.setattr(pivot_tree, "build", refused)
    first = S.near_dup_within(frame(spark, v), 0.8, mode="keep_first", pivots=4, block=30)
    assert {r.vec_id for r in first.collect()} == set(np.flatnonzero(~np.tril(near).any(1)).tolist())


def test_queries_left_are_not_copied(spark, monkeypatch):
    """Queries that visit many leaves go to all partners where those lie: in several chunks, and without an exchange of copies."""
    v = np.random.default_rng(8).normal(size=(400, 6))
    s = cosines(v, v)
    np.fill_diagonal(s, -1)

    def refused(*_):
        raise AssertionError("the tree was asked for all")

    for name, value in (("SCOUT_BLOCKS", 1), ("FLAT_BLOCKS", 1), ("MOST_VISITS", 2), ("CHUNK_BYTES", 90 * 6 * 8), ("TILE", 32), ("SHARE", 100)):
        monkeypatch.setattr(pivot_tree, name, value, raising=False)
    monkeypatch.setattr(pivot_tree, "partnered", refused)
    monkeypatch.setattr(pivot_tree, "compare", refused)
    within = S.near_dup_within(frame(spark, v), 0.9, pivots=4, block=20)
    assert {r.vec_id for r in within.collect()} == set(np.flatnonzero(s.max(axis=1) < 0.9))
    first = S.near_dup_within(frame(spark, v), 0.9, mode="keep_first", pivots=4, block=20)
    assert {r.vec_id for r in first.collect()} == set(np.flatnonzero(~np.tril(s >= 0.9).any(1)))
    against = S.near_dup_existing(frame(spark, v[:250]), frame(spark, v[250:], 1000), 0.9, pivots=4, block=20)
    assert {r.vec_id for r in against.collect()} == set(np.flatnonzero(s[:250, 250:].max(axis=1) < 0.9))


def test_tree_is_exact_where_it_is_asked(spark, monkeypatch):
    new, old = vectors(9, 300), vectors(10, 250, hot=0.2)
    for name, value in (("SCOUT_BLOCKS", 0), ("FLAT_BLOCKS", 0), ("MOST_VISITS", 10**9), ("SCOUT_ROUNDS", 0)):
        monkeypatch.setattr(pivot_tree, name, value, raising=False)
    s = cosines(new, new)
    np.fill_diagonal(s, -1)
    within = S.near_dup_within(frame(spark, new), 0.8, pivots=4, block=40)
    assert {r.vec_id for r in within.collect()} == set(np.flatnonzero(s.max(axis=1) < 0.8))
    against = S.near_dup_existing(frame(spark, new), frame(spark, old, 1000), 0.8, pivots=4, block=40)
    assert {r.vec_id for r in against.collect()} == set(np.flatnonzero(cosines(new, old).max(axis=1) < 0.8))


def test_copies_are_dropped_by_sorting(spark):
    """Vectors are not broadcast, whatever their file's size; zeros of either sign are one value."""
    v = [[0.0, 1.0, 0.0], [-0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.1, 5.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = S.near_dup_within(df, 0.9)
        assert [r.vec_id for r in out.collect()] == [2]
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        old = S.near_dup_existing(df, df.where("vec_id = 0"), 0.9)
        assert sorted(r.vec_id for r in old.collect()) == [2, 3, 4] and old.columns == df.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_text_vectors_are_read_from_the_texts_once(spark, tmp_path):
    texts = [(1, "One two, two THREE"), (2, "a b"), (3, None), (None, "red blue"), (1, "three four"), (4, "ünder_score x2")]
    docs = spark.createDataFrame([(i, t, "src1", "en") for i, t in texts], "doc_id bigint, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = D.text_vectors(spark, str(tmp_path))

    def want(i):
        words = [w for k, t in texts if k == i and t for w in re.findall(r"\w{2,}", t.lower())]
        counts = [0] * D.TEXT_DIMENSIONS
        for w in words:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % D.TEXT_DIMENSIONS] += 1
        return [math.sqrt(n) for n in counts] if words and i is not None else None

    assert sorted(map(str, ((r.doc_id, r.v) for r in out.collect()))) == sorted(str((i, want(i))) for i, _ in texts)
    assert out.columns == ["doc_id", "source", "lang", "v"]
    assert not re.search("Exchange|Generate", out._jdf.queryExecution().executedPlan().toString())
