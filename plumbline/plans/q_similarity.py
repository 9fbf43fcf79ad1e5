"""Queries over near-duplicate removal and closeness to a core set.

The given vectors are nearly random, so their threshold is far lower than the
0.8 to 0.95 used on real prompts; it is a parameter. Vectors made of the words of
`documents` are compared at 0.9.
"""

from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.operators import similarity as S
from plumbline.plans import tables as D
from plumbline.plans.registry import query

T = 0.437

_COS = "(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark, d):
    return D.load(spark, d, "embeddings")


@query("near_dup_existing", f"WITH {_V} SELECT vec_id FROM v a WHERE label >= 5 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.label < 5 AND {_COS} >= {T})")
def near_dup_existing(spark, d):
    v = _vectors(spark, d)
    return S.near_dup_existing(v.where("label >= 5"), v.where("label < 5"), T).select("vec_id")


@query("near_dup_within", f"WITH {_V} SELECT vec_id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.vec_id <> b.vec_id AND {_COS} >= {T})")
def near_dup_within(spark, d):
    return S.near_dup_within(_vectors(spark, d), T).select("vec_id")


@query("near_dup_keep_first", f"WITH {_V} SELECT vec_id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.vec_id < a.vec_id AND {_COS} >= {T})")
def near_dup_keep_first(spark, d):
    return S.near_dup_within(_vectors(spark, d), T, mode="keep_first").select("vec_id")


@query("exclude_previous", f"""WITH {_V}, s AS (SELECT * FROM v a WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.label = 0 AND {_COS} >= {T}))
 SELECT vec_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.vec_id <> b.vec_id AND {_COS} >= {T})""")
def exclude_previous(spark, d):
    """Survivors against an earlier output (label 0), then among themselves."""
    v = _vectors(spark, d)
    return S.near_dup(v.where("label <> 0"), v.where("label = 0"), T).select("vec_id")


#: Threshold of the text vectors.
T_TEXT = 0.9
_TV = "WITH " + D.TEXT_VECTORS
_OLD = "CAST(substr(source, 4) AS INT) < 10"
_KEPT = f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE {{}} AND {_COS} >= {T_TEXT}))"


@query("near_dup_texts", f"{_TV} {_KEPT.format('a.doc_id <> b.doc_id')}")
def near_dup_texts(spark, d):
    """Documents whose words are not those of another one; documents without a word stay."""
    return S.near_dup_within(D.text_vectors(spark, d), T_TEXT, "doc_id", "v").select("doc_id")


@query("near_dup_texts_keep_first", f"{_TV} {_KEPT.format('b.doc_id < a.doc_id')}")
def near_dup_texts_keep_first(spark, d):
    return S.near_dup_within(D.text_vectors(spark, d), T_TEXT, "doc_id", "v", mode="keep_first").select("doc_id")


@query("near_dup_texts_existing", f"{_TV} {_KEPT.format(_OLD.replace('source', 'b.source'))} AND NOT ({_OLD})")
def near_dup_texts_existing(spark, d):
    """Documents of the later sources against those of the first ten."""
    v = D.text_vectors(spark, d)
    return S.near_dup_existing(v.where(f"NOT ({_OLD})"), v.where(_OLD), T_TEXT, "doc_id", "v").select("doc_id")


_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_TFIDF = f"""words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark),
 tf AS (SELECT item_id, term, count(*) AS tf FROM words WHERE term NOT IN ({_STOP}) GROUP BY ALL),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 core AS (SELECT item_id, term, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM tf JOIN idf USING (term)),
 dw AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents) GROUP BY ALL),
 docs AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM dw JOIN idf USING (term)),
 dots AS (SELECT doc_id, item_id, sum(docs.w * core.w) AS dot FROM docs JOIN core USING (term) GROUP BY ALL),
 best AS (SELECT doc_id, max(dot) AS similarity FROM dots GROUP BY 1)"""
_NEAR = f"WITH {_TFIDF} SELECT doc_id, round(coalesce(similarity, 0), 6) AS similarity, coalesce(similarity, 0) >= 0.7 AS near_core FROM documents LEFT JOIN best USING (doc_id)"


def _near(spark, d, broadcast_rows):
    docs = D.load(spark, d, "documents")
    core = S.scan_core_set(D.load(spark, d, "benchmark"))
    out = S.tfidf_near_core(docs, core, 0.7, "doc_id", "text", "item_id", "text", broadcast_rows=broadcast_rows)
    return out.select("doc_id", F.round("similarity", 6).alias("similarity"), "near_core")


@query("tfidf_near_core", _NEAR)
def tfidf_near_core(spark, d):
    return _near(spark, d, 200_000)


@query("tfidf_near_core_joined", _NEAR)
def tfidf_near_core_joined(spark, d):
    """The joins of a core set too large to broadcast."""
    return _near(spark, d, 0)


@query("scan_core_set", "SELECT item_id, text FROM benchmark WHERE (SELECT count(*) FROM benchmark) >= 40")
def scan_core_set(spark, d):
    return S.scan_core_set(D.load(spark, d, "benchmark")).select("item_id", "text")
