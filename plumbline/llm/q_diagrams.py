"""Query over the filter interaction audit, and the same in SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import diagrams
from plumbline.llm.registry import query, table

_STEPS = ", ".join(
    f"('{''.join(p)}', {k + 1}, {1 << 'ABCDE'.index(p[k])}, {sum(1 << 'ABCDE'.index(c) for c in p[:k])})"
    for p in permutations("ABCDE") for k in range(5))

SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY 1),
m AS (
  SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * upper > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o(filter_order, step, bit, before) AS (VALUES {_STEPS}),
s AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c CROSS JOIN o GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM s
"""


@query("op13_diagrams", SQL)
def op13_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
