"""Queries over labels, hashes, curation steps, sampling and sets."""

from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import labels as L
from plumbline.operators import filters, integrity, ordering, sampling
from plumbline.plans import tables as D
from plumbline.plans.registry import query, rounded
from plumbline.plans.q_text import _pick
from plumbline.sources import readers

# documents with tier and scope labels in every state: plain, hashed, wrong hash, without colon
_LABELLED = """labelled AS (SELECT doc_id, prompt, CASE WHEN tier IS NULL THEN NULL
 WHEN doc_id % 4 = 0 THEN tier || ':' || sha1(prompt) WHEN doc_id % 4 = 1 THEN tier || ':' || sha1(prompt || '!')
 ELSE tier END AS tier, CASE doc_id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2:' || sha1(prompt) END AS scope FROM tiers)"""


def labelled(spark, d):
    t = D.tiers(spark, d)
    good, bad = F.sha1("prompt"), F.sha1(F.concat("prompt", F.lit("!")))
    tier = F.when(F.col("tier").isNull(), None).when(F.col("doc_id") % 4 == 0, F.concat_ws(":", "tier", good)).when(
        F.col("doc_id") % 4 == 1, F.concat_ws(":", "tier", bad)).otherwise(F.col("tier"))
    scope = F.when(F.col("doc_id") % 3 == 0, "S1").when(F.col("doc_id") % 3 == 1, F.concat_ws(":", F.lit("S2"), good))
    return t.select("doc_id", "prompt", tier.alias("tier"), scope.alias("scope"))


_L = "WITH " + D.TIERS + ", " + _LABELLED


@query("prompt_hash", "SELECT doc_id, sha1(text) AS prompt_hash FROM documents")
def prompt_hash(spark, d):
    return D.documents(spark, d).select("doc_id", L.prompt_hash(F.col("prompt")).alias("prompt_hash"))


@query("compound_label", "WITH " + D.TIERS + " SELECT doc_id, tier || ':' || sha1(prompt) AS label FROM tiers")
def compound_label(spark, d):
    t = D.tiers(spark, d)
    return t.select("doc_id", L.compound_label(F.col("tier"), L.prompt_hash(F.col("prompt"))).alias("label"))


@query("split_label", _L + """ SELECT doc_id, CASE WHEN contains(tier, ':') THEN split_part(tier, ':', 1) END AS label,
 CASE WHEN contains(tier, ':') THEN split_part(tier, ':', 2) END AS digest FROM labelled""")
def split_label(spark, d):
    out = labelled(spark, d).withColumn("p", L.split_label(F.col("tier")))
    return out.select("doc_id", F.col("p.label").alias("label"), F.col("p.digest").alias("digest"))


@query("verify_hash", _L + " SELECT doc_id, CASE WHEN contains(coalesce(tier, ''), ':') THEN split_part(tier, ':', 2) = sha1(prompt) ELSE true END AS hash_ok FROM labelled")
def verify_hash(spark, d):
    return integrity.verify(labelled(spark, d)).select("doc_id", "hash_ok")


@query("extract_label", _L + """ SELECT doc_id, CASE WHEN contains(tier, ':') THEN split_part(tier, ':', 1) WHEN length(tier) = 1 THEN tier ELSE 'C' END AS tier_label,
 CASE WHEN contains(scope, ':') THEN split_part(scope, ':', 1) ELSE 'C' END AS scope_as_tier FROM labelled""")
def extract_label(spark, d):
    return labelled(spark, d).select("doc_id", L.extract_label(F.col("tier")).alias("tier_label"), L.extract_label(F.col("scope")).alias("scope_as_tier"))


@query("add_prompt_hash", _L + """ SELECT doc_id, CASE WHEN contains(tier, ':') THEN tier ELSE tier || ':' || sha1(prompt) END AS tier,
 CASE WHEN scope IS NULL OR contains(scope, ':') THEN scope ELSE scope || ':' || sha1(prompt) END AS scope,
 CASE WHEN contains(tier, ':') AND (scope IS NULL OR contains(scope, ':')) THEN 'kept' ELSE 'hashed' END AS hash_status FROM labelled WHERE tier IS NOT NULL""")
def add_prompt_hash(spark, d):
    return integrity.add_prompt_hash(labelled(spark, d)).select("doc_id", "tier", "scope", "hash_status")


@query("add_prompt_hash_counts", _L + """, m AS (SELECT tier IS NULL AS missing, contains(tier, ':') AS t, scope IS NULL OR contains(scope, ':') AS s FROM labelled)
 SELECT count_if(NOT missing AND NOT (t AND s))::BIGINT AS processed, count_if(NOT missing AND NOT s)::BIGINT AS scope_processed, count_if(missing OR (t AND s))::BIGINT AS skipped FROM m""")
def add_prompt_hash_counts(spark, d):
    return integrity.hash_counts(labelled(spark, d))


@query("sampled_verify", _L + """, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM labelled)
 SELECT doc_id, CASE WHEN contains(coalesce(tier, ''), ':') THEN split_part(tier, ':', 2) = sha1(prompt) ELSE true END AS hash_ok FROM r WHERE rn <= greatest(1, floor(n * 0.1))""")
def sampled_verify(spark, d):
    t = labelled(spark, d)
    return integrity.sampled_verify(t, "doc_id", t.count()).select("doc_id", "hash_ok")


@query("verify_or_fail", _L + """, v AS (SELECT *, CASE WHEN contains(coalesce(tier, ''), ':') THEN split_part(tier, ':', 2) = sha1(prompt) ELSE true END AS ok FROM labelled)
 SELECT doc_id, CASE WHEN contains(tier, ':') THEN split_part(tier, ':', 1) WHEN length(tier) = 1 THEN tier ELSE 'C' END AS tier, ok AS hash_ok,
 CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS factor FROM v""")
def verify_or_fail(spark, d):
    out = integrity.verified_label(labelled(spark, d), "tier", "plain")
    return out.select("doc_id", F.col("plain").alias("tier"), "hash_ok", F.when(F.col("hash_ok"), 1.0).otherwise(0.0).alias("factor"))


_JOB = "WITH " + D.TIERS + """, c AS (SELECT doc_id, trim(replace(prompt, '’', ''''), ' ' || chr(9) || chr(10) || chr(13)) AS prompt,
 coalesce(tier, 'C') AS tier, 'S' || (length(prompt) % 4) AS scope FROM tiers)
 SELECT doc_id, tier || ':' || sha1(prompt) AS tier, scope || ':' || sha1(prompt) AS scope FROM c"""


@query("label_pipeline", _JOB)
@query("label_job", _JOB)
def label_job(spark, d):
    """Tier, scope and hash labels in one plan."""
    from plumbline.functions import text as T

    raw = D.tiers(spark, d)
    labelled_rows = raw.select(
        "doc_id", T.clean_tier_suffix(F.col("prompt")).alias("prompt"), L.parse_tier(F.col("tier")).alias("tier"),
        L.parse_scope(F.concat(F.lit('{"scope": "S'), F.length("prompt") % 4, F.lit('"}'))).alias("scope"),
    )
    return integrity.add_prompt_hash(labelled_rows).select("doc_id", "tier", "scope")


@query("group_complete", "SELECT l_orderkey AS group_key, count(*) AS n, count(*) % 6 = 0 AS complete FROM lineitem GROUP BY 1")
def group_complete(spark, d):
    return integrity.group_complete(D.load(spark, d, "lineitem"), F.col("l_orderkey"))


@query("batch_id", """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, sha256(concat_ws(chr(31), event_type, props)) AS d FROM events),
 b AS (SELECT user_id, floor((rn - 1) / 1024) AS part, sha256(string_agg(d, '' ORDER BY rn)) AS d, count(*) AS n FROM r GROUP BY ALL)
 SELECT user_id, 'batch_' || left(sha256(string_agg(d, '' ORDER BY part)), 16) AS batch_id, CAST(sum(n) AS BIGINT) AS n_rows FROM b GROUP BY 1""")
def batch_id(spark, d):
    e = D.events(spark, d)
    return integrity.batch_digest(e, "user_id", "event_id", ordering.key_blocks(e, "event_id"), ["event_type", "props"])


@query("evaluate_once", "SELECT l_orderkey, l_linenumber, count(*) AS n_requests FROM lineitem GROUP BY ALL")
def evaluate_once(spark, d):
    return integrity.evaluate_once(D.load(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("exact_dedupe", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def exact_dedupe(spark, d):
    return filters.exact_dedupe(D.documents(spark, d), "doc_id").select("doc_id", F.md5("prompt").alias("digest"))


@query("anti_join_seen", "SELECT doc_id FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en') AND text NOT IN (SELECT text FROM benchmark)")
def anti_join_seen(spark, d):
    docs = D.documents(spark, d)
    seen = docs.where("lang = 'en'").select("prompt").unionByName(D.load(spark, d, "benchmark").select(F.col("text").alias("prompt")))
    return filters.anti_join_seen(docs.where("lang <> 'en'"), seen).select("doc_id")


@query("filter_funnel", """WITH f AS (SELECT count(*) OVER (PARTITION BY text ORDER BY doc_id ROWS UNBOUNDED PRECEDING) > 1 AS dup, text, lang FROM documents)
 SELECT CASE WHEN length(text) < 15 THEN 'invalid' WHEN contains(text, '<') THEN 'markup' WHEN lang <> 'en' THEN 'non_lexicon' WHEN dup THEN 'duplicate' ELSE 'accepted' END AS stage, count(*) AS n FROM f GROUP BY 1""")
def filter_funnel(spark, d):
    docs = D.documents(spark, d)
    first = filters.exact_dedupe(docs, "doc_id").select("doc_id", F.lit(True).alias("first"))
    marked = docs.join(first, "doc_id", "left")
    return filters.filter_funnel(marked, {
        "invalid": F.length("prompt") < 15, "markup": F.contains("prompt", F.lit("<")),
        "non_lexicon": F.col("lang") != "en", "duplicate": F.col("first").isNull(),
    })


_RATIOS = {"A": 0.2, "B": 0.4, "C": 0.4}


def _quota_sql(n):
    t = sampling.quota_targets(n, _RATIOS)
    return f"""WITH {D.TIERS}, q AS (SELECT doc_id, coalesce(tier, 'C') AS tier, md5('42:' || doc_id) AS h FROM tiers),
 r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY h, doc_id) AS rn FROM q),
 chosen AS (SELECT doc_id, tier FROM r WHERE rn <= CASE tier WHEN 'A' THEN {t['A']} WHEN 'B' THEN {t['B']} ELSE {t['C']} END),
 rest AS (SELECT doc_id, tier, row_number() OVER (ORDER BY h, doc_id) AS rn FROM q WHERE doc_id NOT IN (SELECT doc_id FROM chosen))
 SELECT * FROM chosen UNION ALL SELECT doc_id, tier FROM rest WHERE rn <= {n} - (SELECT count(*) FROM chosen)"""


@query("quota_sample", _quota_sql(150))
def quota_sample(spark, d):
    return sampling.quota_sample(D.tiers(spark, d), "doc_id", "tier", 150, _RATIOS).select("doc_id", "tier")


@query("split_dataset", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
 SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_dataset(spark, d):
    return sampling.split_dataset(D.load(spark, d, "documents"), "doc_id").select("doc_id", "split")


@query("oversample_pool", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 160")
def oversample_pool(spark, d):
    return sampling.oversample_pool(D.load(spark, d, "documents"), "doc_id", 40).select("doc_id")


@query("first_k_examples", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS example FROM documents QUALIFY example <= 3")
def first_k_examples(spark, d):
    out = sampling.first_examples(D.load(spark, d, "documents"), "source", "doc_id")
    return out.select("source", "doc_id", F.col("example").cast("bigint").alias("example"))


@query("shuffle_seeded", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position FROM documents")
def shuffle_seeded(spark, d):
    return sampling.shuffle_seeded(D.load(spark, d, "documents"), "doc_id").select("doc_id", "position")


@query("project_minimal", "SELECT row_number() OVER (ORDER BY doc_id) AS id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def project_minimal(spark, d):
    docs = D.documents(spark, d).where("prompt IS NOT NULL")
    ranked = ordering.add_rank(docs, ["doc_id"], ordering.key_blocks(docs, "doc_id"), out="id")
    return ranked.select("id", F.md5("prompt").alias("digest"))


@query("chunk_items", "SELECT doc_id, floor((rn - 1) / 10)::BIGINT AS chunk_id, CAST((rn - 1) % 10 AS INT) AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def chunk_items(spark, d):
    from plumbline.operators.sequence import chunk_items as chunks

    docs = D.load(spark, d, "documents").select("doc_id")
    return chunks(docs, ["doc_id"], ordering.key_blocks(docs, "doc_id"), 10).select("doc_id", "chunk_id", "pos")


@query("union_batches", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT 'page' FROM pages) GROUP BY 1")
def union_batches(spark, d):
    """Batches of each language and of the pages; two calls have failed."""
    docs = D.load(spark, d, "documents").select("lang", "doc_id")
    known = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    results = [docs.where(F.col("lang").eqNullSafe(lang)) for lang in known]
    pages = D.load(spark, d, "pages").select(F.lit("page").alias("lang"), "url")
    out, n_failed = filters.union_batches([*results, RuntimeError("call failed"), pages, None])
    assert n_failed == 2
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_SEED_SQL = ", ".join(f"('{t}')" for t in C.SEED_TERMS)


@query("union_terms", f"SELECT DISTINCT term FROM (SELECT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) UNION ALL SELECT * FROM (VALUES {_SEED_SQL}))")
def union_terms(spark, d):
    words = D.load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return readers.union_terms(words.select(F.lower("w").alias("term")), C.SEED_TERMS)


@query("except_required", """SELECT event_id, list_sort(list_filter(['k', 'score', 'severity'], lambda x: x <> 'k' AND NOT (x = 'score' AND event_type = 'click')))::VARCHAR AS missing FROM events""")
def except_required(spark, d):
    have = F.when(F.col("event_type") == "click", F.array(F.lit("k"), F.lit("score"))).otherwise(F.array(F.lit("k")))
    missing = F.array_sort(F.array_except(F.array(F.lit("k"), F.lit("score"), F.lit("severity")), have))
    return D.events(spark, d).select("event_id", F.concat(F.lit("["), F.array_join(missing, ", "), F.lit("]")).alias("missing"))
