"""Queries over the whole curation chain."""

from pyspark.sql import functions as F

from plumbline.operators import curation, sampling, similarity
from plumbline.plans import tables as D
from plumbline.plans.q_similarity import _COS, _TFIDF, T
from plumbline.plans.q_text import _REASON, _SPACE
from plumbline.plans.registry import query

_QUOTA, _RATIOS = 60, {"A": 0.2, "B": 0.4, "C": 0.4}
_CHAIN = f"""WITH {D.TIERS}, {_TFIDF},
 m AS (SELECT doc_id, coalesce(tier, 'C') AS tier, p, CASE WHEN {_REASON} IS NOT NULL THEN 'invalid' WHEN NOT contains(p, 'th') THEN 'non_lexicon' END AS stage
  FROM (SELECT doc_id, tier, trim(prompt, {_SPACE}) AS p FROM tiers)),
 u AS (SELECT * FROM m WHERE stage IS NULL), d1 AS (SELECT min(doc_id) AS doc_id FROM u GROUP BY p),
 d2 AS (SELECT doc_id FROM d1 WHERE doc_id NOT IN (SELECT doc_id FROM best WHERE similarity >= 0.7)),
 d3 AS (SELECT doc_id FROM d2 WHERE doc_id % 4 <> 0),
 v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM d3)),
 d4 AS (SELECT doc_id FROM d3 WHERE doc_id NOT IN (SELECT a.doc_id FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE a.doc_id <> b.doc_id AND {_COS} >= {T}))),
 staged AS (SELECT m.doc_id, m.tier, coalesce(stage, CASE WHEN doc_id NOT IN (SELECT * FROM d1) THEN 'duplicate' WHEN doc_id NOT IN (SELECT * FROM d2) THEN 'core_similar'
  WHEN doc_id NOT IN (SELECT * FROM d3) THEN 'not_challenging' WHEN doc_id NOT IN (SELECT * FROM d4) THEN 'near_duplicate' ELSE 'accepted' END) AS stage FROM m)"""


def _staged(spark, d, accepted=None):
    """`accepted`: a condition on the vectors that tells those of prompts accepted before."""
    prompts = D.tiers(spark, d)
    core = similarity.scan_core_set(D.load(spark, d, "benchmark"))
    vectors = D.load(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    stages = curation.curate_prompts(
        prompts, "doc_id", F.contains("prompt", F.lit("th")), core, "item_id", "text", F.col("doc_id") % 4 != 0,
        vectors, "embedding", 0.7, T, existing=vectors.where(accepted) if accepted else None)
    return prompts, stages


@query("curate_funnel", _CHAIN + " SELECT stage, count(*) AS n FROM staged GROUP BY stage")
def curate_funnel(spark, d):
    """How many documents each of the six stages stops."""
    return curation.funnel(_staged(spark, d)[1])


# Vectors of label 0 are those of prompts accepted before, whatever their own stage.
_AGAINST = _CHAIN.replace(" d4 AS (", f""" old AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0),
 gone AS (SELECT doc_id FROM v a WHERE EXISTS (SELECT 1 FROM old b WHERE {_COS} >= {T})),
 v4 AS (SELECT * FROM v WHERE doc_id NOT IN (SELECT * FROM gone)),
 d4 AS (""", 1).replace("(SELECT a.doc_id FROM v a WHERE EXISTS (SELECT 1 FROM v b", "(SELECT a.doc_id FROM v4 a WHERE EXISTS (SELECT 1 FROM v4 b").replace(
    "WHEN doc_id NOT IN (SELECT * FROM d4)", "WHEN doc_id IN (SELECT * FROM gone) THEN 'near_existing' WHEN doc_id NOT IN (SELECT * FROM d4)")


@query("curate_against_existing", _AGAINST + " SELECT doc_id, stage FROM staged")
def curate_against_existing(spark, d):
    """The stage of every document when a set accepted before is compared first."""
    return _staged(spark, d, "label = 0")[1].select("doc_id", "stage")


_T = sampling.quota_targets(_QUOTA, _RATIOS)


@query("curate_prompts", _CHAIN + f""", r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM staged WHERE stage = 'accepted'),
 chosen AS (SELECT doc_id, tier FROM r WHERE rn <= CASE tier WHEN 'A' THEN {_T['A']} WHEN 'B' THEN {_T['B']} ELSE {_T['C']} END),
 rest AS (SELECT doc_id, tier, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM r WHERE doc_id NOT IN (SELECT doc_id FROM chosen))
 SELECT * FROM chosen UNION ALL SELECT doc_id, tier FROM rest WHERE rn <= {_QUOTA} - (SELECT count(*) FROM chosen)""")
def curate_prompts(spark, d):
    """The accepted documents, sampled to tier quotas."""
    prompts, stages = _staged(spark, d)
    return curation.accepted_quota(prompts, stages, "doc_id", "tier", _QUOTA, _RATIOS).select("doc_id", "tier")
