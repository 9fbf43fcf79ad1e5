"""The corpus pipeline and its stages against plain Python, with clashing names, nulls and repeated ids."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from plumbline.llm import language, mixing, secrets
from plumbline.llm.q_language import remainder
from plumbline.llm.q_pieces import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def kept_of_groups(rows):
    """Positions of the rows that stay: the first of each component of near duplicates."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return [min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for g in groups.values()]


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in found if len(r.text or "") < 4000]
    base = out[3][1]
    words = base.split()
    near = " ".join(words[:len(words) // 2] + ["other"] + words[len(words) // 2 + 1:])
    out += [(10_000, base, "en", "src1", 1), (10_001, near, "en", None, 1), (out[5][0], "of the and in that is to be or not of it " * 3, "en", "src2", 1),
            (None, base, "en", "src3", 1), (None, "the and of in with it that", "en", "src3", 1), (10_002, None, "en", "src3", None),
            (10_003, "", None, "", 0), *((10_010 + k, f"{' '.join(reversed(out[k][1].split()))} token = \"{k:040x}\" the end of it", "en", "src2", 1) for k in range(20, 26)), (10_004, "123 !!", "en", "src1", 6), (10_004, "123 !!", "en", "src1", 6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def extra(docs):
    names = ["score", "lang_pred", "ambiguous", "row", "place", "component_id", "size", "copies", "spans", "ids", "id", "v", "n"]
    return docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names}), names


@pytest.mark.parametrize("stage", pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_carry_extra_columns_and_empty_tables(spark, docs, sf, stage):
    wide, names = extra(docs)
    out = stage[1](spark, wide, sf)
    assert out.columns == wide.columns
    held = out.collect()
    assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in held for c in names)
    plain = stage[1](spark, docs, sf)
    assert Counter(tuple(r) for r in plain.collect()) == Counter(tuple(r[c] for c in docs.columns) for r in held)
    assert plain.schema == docs.schema
    assert stage[1](spark, docs.where("false"), sf).count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark, docs, rows):
    found = Counter(tuple(r) for r in pipeline.one_of_each(spark, docs, "").collect())
    kept = Counter(rows[k] for k in kept_of_groups(rows))
    assert found == kept
    assert any(r[0] == rows[5][0] and r[1] != rows[5][1] for r in found)


def test_run_against_plain_python(spark, rows, docs, sf, tmp_path):
    """Each stage is repeated on the rows of the one before it."""
    import sentencepiece

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = pipeline.run(spark, str(tmp_path))
    model = language.fit(docs, remainder("doc_id", 3) != 1)
    told = language.predict(docs, model, keep=["doc_id", "text", "lang", "source", "n_chars"]).collect()
    known = [tuple(r)[:5] for r in told if any(c.isalpha() for c in r.text or "") and r.score >= pipeline.LEAST_SCORE]
    assert len(known) > 0.9 * sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    single = [known[k] for k in kept_of_groups(known)]
    field = secrets.train(spark.createDataFrame(single, SCHEMA))
    masked = []
    for row, (_, spans) in zip(single, secrets.scan([r[1] for r in single], field)):
        text, at = "", 0
        for s in sorted(spans, key=lambda s: s[3]):
            if s[3] >= at:
                text += row[1][at:s[3]] + "[SECRET]"
            at = max(at, s[2])
        masked.append((row[0], text + row[1][at:], *row[2:]))
    assert any("[SECRET]" in r[1] for r in masked)
    copies = mixing.plan(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(masked)], SCHEMA).withColumn("k", F.col("doc_id")))
    assert copies.count() == len(masked)
    tool = sentencepiece.SentencePieceProcessor(model_file=model_path(), add_eos=True)
    ids = {r[0]: [tool.encode(m[1]) for m in masked if m[0] == r[0]] for r in masked}
    taken = Counter(r.doc_id for r in found.collect())
    plan = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(masked, SCHEMA)).collect()}
    assert {k for k, n in plan.items() if n} == set(taken)
    for r in found.collect():
        assert list(r.ids) in ids[r.doc_id] and r.n_tokens == len(r.ids)
