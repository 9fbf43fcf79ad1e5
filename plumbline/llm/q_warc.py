"""Query over the WARC archive, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import warc
from plumbline.llm.registry import query, table

SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, (5 * i + 1)::INT, 5))::INT + 1, 1)), '') AS payload_digest
  FROM (SELECT *, array_to_string(list_transform(range(40), lambda i:
      ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
        strpos('0123456789abcdef', substr(sha1(h), (i + 1)::INT, 1))]), '') AS bits FROM p)),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op3_warc", SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = warc.records(warc.read(spark, warc.archive(pages)))
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest",
                        F.col("type").alias("record_type"), "refers_to")
