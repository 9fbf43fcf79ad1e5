"""Query over the mix, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import mixing
from plumbline.llm.registry import query, table

SQL = """
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sums),
levelled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER ()
      - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    AS level FROM weighed),
chosen AS (SELECT arg_min(level, cap / w) FILTER (WHERE cap >= level * w) AS level FROM levelled),
rates AS (
  SELECT l.source, l.source_size, least(l.cap::DOUBLE, coalesce(c.level * l.w, l.cap::DOUBLE)) AS target
  FROM levelled l, chosen c),
drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""


@query("op6_mixing", SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"),
                          (F.col("size") * F.col("copies")).alias("taken"))
