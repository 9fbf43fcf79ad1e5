"""Operators on tables against plain Python, with hot groups, nulls, ties and empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumbline.llm import fingerprint, jaccard, kneser_ney, mixing, sharding, warc
from plumbline.llm.components import components
from plumbline.llm.groups import attach, join_bounded

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def make(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of one text, a shared passage, and odd texts."""
    rng = random.Random(7)

    def text(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n)]

    passage, base = text(30), text(120)
    out = [" ".join(text(rng.randint(1, 80))) for _ in range(40)]
    out += [" ".join(text(20) + passage + text(20)) for _ in range(20)]
    out += [" ".join(base)] * 30
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = rng.choice("xyz")
        out.append(" ".join(near))
    chain = list(base)
    for k in range(12):
        chain = chain[3:] + text(3)
        out.append(" ".join(chain))
    return out + ["", None, "a", "A", "a b", "a b c d", "A B c\nD", " \n", "long " * 3000, "one two three four five six"]


# --- joins and components --------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(200, k) for k in range(100, 180)] + [(5, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert found == {v: root(v) for v in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_attach_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None) for i in range(2000)], "id bigint, key string")
    groups = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    want = {r.id: r.first_id for r in rows.join(groups.withColumnRenamed("first", "first_id"), "key", "left").collect()}
    assert {r.id: r["first"] for r in attach(rows, groups, "key", F.col("id"), 2000).collect()} == want


def test_join_bounded_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.groups.BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(i, i % 3) for i in range(300)], "id bigint, key bigint")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "key bigint, v string")
    assert join_bounded(rows, small, "key", F.col("id")).count() == 200


# --- Jaccard join ----------------------------------------------------------------------------

def plain_join(texts, n=4, percent=85):
    sets = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = list(range(len(texts)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 95)])
def test_jaccard(spark, corpus, n, percent):
    found = jaccard.join(make(spark, corpus).repartition(5), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == plain_join(corpus, n, percent)


def test_jaccard_returns_every_row(spark):
    """Repeated ids keep their own texts; rows of a null id link with nothing."""
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (1, "a b c d e f g"), (2, "q r s t u v w"), (None, "a b c d e f g"),
            (None, "m n o p"), (0, "m n o p"), (3, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("x")).withColumn("id", F.lit(5))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert found == sorted([(1, 4, 1), (1, 4, 1), (1, 4, 1), (2, 4, 1), (None, 4, None), (None, 1, None), (0, 1, 0),
                            (3, 0, 3), (3, 0, 3)], key=str)


def test_jaccard_rows_exchanged_for_one_open_set_grow_with_the_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rows = {}
    for n in (64, 128, 256):
        members = spark.range(n).select(
            F.lit(-1).cast("bigint").alias("c"), F.lit(9).cast("bigint").alias("size_c"), F.col("id").alias("v"),
            F.lit(9).cast("bigint").alias("size"), F.when(F.col("id") == 5, 5).otherwise(-1).cast("bigint").alias("component"),
            F.array(F.lit(1).cast("bigint")).alias("more"), F.array(F.lit(2).cast("bigint")).alias("less"))
        rows[n] = jaccard._dealt_members(members).count()
    assert rows == {n: n + n // 8 for n in rows}


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "A b c d e"), (4, None)],
                                 "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    found = sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    assert found == [(1, 1), (1, 1), (3, 1), (4, 4), (None, None)]
    assert jaccard.join(docs.where("false")).count() == 0


@pytest.mark.parametrize("percent, common, more", [(85, 17, 3), (80, 8, 2)])
def test_jaccard_keeps_pairs_at_the_threshold(spark, percent, common, more):
    """A text and its copy with a few words appended: the filter may drop neither."""
    texts = []
    for k in range(600):
        words = [f"p{k}w{i}" for i in range(common + more + 3)]
        texts += [" ".join(words[:common + 3]), " ".join(words)]
    found = {r.doc_id: r.component_id for r in jaccard.join(make(spark, texts), 4, percent).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


def test_jaccard_of_tasks_that_deal_nothing(spark):
    """Texts of one shingle, a task each: most have no hash below the bound."""
    docs = make(spark, [f"t{i // 2}" for i in range(8)]).repartition(8, "doc_id")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {i: i - i % 2 for i in range(8)}


def test_pipeline_stage_removes_copies_between_80_and_85(spark):
    import corpus_pipeline

    texts = []
    for k in range(20):
        words = [f"k{k}w{i}" for i in range(125)]
        # 96 of 116 shingles of five words are shared, then 96 of 121.
        texts += [" ".join(words[:100]), " ".join(words[:120])] if k % 2 else [" ".join(words[:100]), " ".join(words)]
    docs = make(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    left = corpus_pipeline.one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(40) if i % 4 != 3]


# --- fingerprints ----------------------------------------------------------------------------

def test_next_document_and_edit(spark, corpus):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), len(corpus))
    docs = spark.createDataFrame(list(zip(ids, corpus)), "doc_id bigint, text string").repartition(4)
    order = sorted(zip(ids, corpus), reverse=True)
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    by_text = defaultdict(set)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edit = text[: len(text) - cut] + following[:cut]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        by_text[text].add(found[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    copies = [r for k, r in enumerate(found.values())]
    assert any(r.near_next == 1 for r in copies)


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(5, "abc def")], "doc_id bigint, text string")
    assert fingerprint.fingerprints(one).first().near_next == 1
    assert fingerprint.fingerprints(one.where("false")).count() == 0
    rows = spark.createDataFrame([(None, "x y z"), (None, None), (1, "x"), (1, "x")], "doc_id bigint, text string")
    assert fingerprint.fingerprints(rows).count() == 4


def test_rarer_words_are_in_the_lexicon(spark):
    """Words in 0.1 to 0.5 percent of documents: texts of these alone keep a likeness after an edit."""
    texts = [" ".join(f"g{i % 250}w{k}" for k in range(30)) + f" once{i}" for i in range(1000)]
    docs = make(spark, texts)
    found, size = fingerprint.lexicon(docs)
    assert size == 250 * 30 and found.where("term like 'once%'").count() == 0
    rows = fingerprint.fingerprints(docs).collect()
    assert not any(r.fingerprint.startswith("t") for r in rows)
    assert sum(r.near_edited > 0 for r in rows) > 500


# --- WARC ------------------------------------------------------------------------------------

def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_warc_round_trip(spark, chunk):
    magic = warc.MAGIC
    pages = ["x" * 50 + magic + "é" * 40 + magic + magic, None, "", "\r\n\r\n" + magic + "\r\n\r\nWARC/1.1\r", "y" * 1000, "WARC/1.1\r\n"]
    rows = [(i, "u\r\nv" if i % 2 else None, pages[i % len(pages)]) for i in range(30)] + [(None, "n", "zz"), (0, "u", pages[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    found = warc.records(warc.read(spark, warc.archive(df, chunk_bytes=chunk))).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        again = i is not None and first[h or ""] != i
        want.append((i, len((h or "").encode()), b32(h or ""), "revisit" if again else "response", first[h or ""] if again else None))
    got = [(r.page, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_small_payloads_are_responses_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 30), (4, "u", "a" * 30)], "page_id bigint, url string, html string")
    found = {r.page: r.type for r in warc.records(warc.read(spark, warc.archive(df, revisit_bytes=10))).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.records(warc.read(spark, warc.archive(df.where("false")))).count() == 0


@pytest.mark.parametrize("chunk", [9, 13, 1000])
def test_warc_of_version_texts_anywhere(spark, chunk):
    """Payloads, urls and ids that end in the version text, or in pieces of the version line."""
    rng = random.Random(chunk)
    bits = ["WARC/1.1", "\r\n", "WARC/", "1.1", "\r", "\n", "x", "é", "WARC/1.1\r\n", "%2E", "%0D"]
    pages = ["ends in WARC/1.1", "WARC/1.1", "y" * 10 + "WARC/1.1" + "z" * 10]
    pages += ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(60)]
    rows = [(f"{k}-{h}", f"u{k}{'WARC/1.1' if k % 2 else ''}", h) for k, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    found = warc.records(warc.read(spark, warc.archive(df, chunk_bytes=chunk), "string")).collect()
    first = {h: min(p for p, _, g in rows if g == h) for _, _, h in rows}
    want = [(p, len(h.encode()), b32(h), "response" if first[h] == p else "revisit", None if first[h] == p else first[h]) for p, _, h in rows]
    assert sorted((r.page, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in found) == sorted(want)


def test_warc_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 20)], "page_id bigint, url string, html string")
    for size in (9, 1000):
        chunks = warc.read(spark, warc.archive(df, chunk_bytes=size)).withColumn("body", F.replace("body", F.lit("b"), F.lit("B")))
        with pytest.raises(Exception, match="does not fit"):
            warc.records(chunks).collect()


# --- Kneser-Ney ------------------------------------------------------------------------------

def test_kneser_ney(spark, corpus, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PACK_TOKENS", 2000)
    texts = [t for t in corpus if t is None or len(t) < 5000]
    docs = make(spark, texts).repartition(4)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    tokens = {i: words_of(t) + ["</s>\0"] for i, t in enumerate(texts)}
    c, b = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            b.update(zip(["<s>\0", *w], w))
    total, types = sum(c.values()), len(c)
    context, followed = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (v, w), n in b.items():
        context[v][min(n, 3) - 1] += 1
        context[v][3] += n
        followed[w] += 1

    def levels(values):
        return [sum(x == k for x in values) for k in (1, 2, 3, 4)]

    d, dw = kneser_ney.discounts(levels(b.values())), kneser_ney.discounts(levels(followed.values()))
    ones = levels(followed.values())
    spare = (dw[1] * ones[0] + dw[2] * ones[1] + dw[3] * (types - ones[0] - ones[1])) / len(b)

    def lower(w):
        return max(followed[w] - dw[min(followed[w], 3)], 0) / len(b) + spare / (types + 1)

    def p(v, w):
        if v not in context:
            return lower(w)
        n = b.get((v, w), 0)
        one, two, more, count = context[v]
        return (max(n - d[min(n, 3)], 0) + (d[1] * one + d[2] * two + d[3] * more) * lower(w)) / count

    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    found = kneser_ney.score(docs.withColumn("score", F.lit("clash")), train).collect()
    assert len(found) == len(texts)
    for r in found:
        w = tokens[r.doc_id]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (not held[r.doc_id], len(w), sum(x in c for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(v, x)) for v, x in zip(["<s>\0", *w], w)), rel=1e-6)
    v = max(context, key=lambda k: context[k][3])
    rest = (d[1] * context[v][0] + d[2] * context[v][1] + d[3] * context[v][2]) / context[v][3] * spare / (types + 1)
    assert sum(p(v, w) for w in c) + rest == pytest.approx(1)


def test_kneser_ney_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, "")], "doc_id bigint, text string")
    found = sorted((str(r.doc_id), r.n_tokens) for r in kneser_ney.score(docs, F.lit(True)).collect())
    assert found == [("1", 3), ("1", 3), ("3", 1), ("None", 1)]
    untrained = kneser_ney.score(docs, F.lit(False)).collect()
    assert len(untrained) == 4 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in untrained)
    assert kneser_ney.score(docs.where("false"), F.lit(True)).count() == 0


# --- mixing ----------------------------------------------------------------------------------

def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full


def test_mixing(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{rng.randrange(6)}"
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))) if i % 50 else None, source))
    rows += [(5000, "", "empty"), (5001, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    found = {r.doc_id: r for r in mixing.plan(docs).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    target = plain_targets(sizes)
    taken = Counter()
    for i, t, s in rows:
        r = found[i]
        assert r.size == len(words_of(t)) and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.copies <= 2
        taken[s] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= 0.1 * max(target[s], 1) for s in sizes)
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({i: r.copies for i, r in found.items() if r.copies})
    assert mixing.mix(docs.where("false")).count() == 0


# --- sharding --------------------------------------------------------------------------------

def plain_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("prefix, shards", [(4, 16), (1, 16), (1, 3)])
def test_sharding(spark, corpus, monkeypatch, prefix, shards):
    monkeypatch.setattr(sharding, "PREFIX", prefix)
    monkeypatch.setattr(sharding, "STEP", 1)
    texts = [t if t is None or len(t) < 5000 else t[:700] for t in corpus]
    found = sharding.assign(make(spark, texts).repartition(3), shards).collect()
    size, by_text = Counter(), defaultdict(set)
    groups = Counter()
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        size[r.shard] += r.size
        by_text[text].add(r.shard)
        groups[hashlib.md5(text.encode()).hexdigest()] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert max(size.values()) == plain_capacity([groups[k] for k in sorted(groups)], shards)
    for k in range(shards):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))


def test_sharding_edges(spark):
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "")], "doc_id bigint, text string").withColumn("shard", F.lit("x"))
    found = sharding.assign(rows).collect()
    assert len(found) == 4 and len({r.shard for r in found if r.size == 1}) == 1
    assert sharding.assign(rows.where("false")).count() == 0


def test_all_are_registered():
    names = [q for q in queries() if re.match("op[0-9]+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in queries()
